"""Operator 5, token ids in ORC.

Token ids are written as ORC stripes: integers are run-length encoded, every ``row_index_stride`` rows get
a row index, and document ids get a Bloom filter, so a reader can take stripes in parallel and skip those
that cannot hold a document. Files are in ascending document order: texts are range-partitioned and sorted
by id and text before they are encoded, so the files, read by name, are one sorted sequence. ``row`` is a
document's place in its file, so readers of single stripes know the order too.

Defined cases: a null or empty text has just the end id; a null document id sorts first; rows that share an id
are all written, in order of a fingerprint of their texts; a text of any length is one row, encoded whole; an
empty table gives a readable, empty folder; other input columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .bytehash import blocks
from .common import materialise, shuffle_width, work_path
from .tokens import encoder

SCHEMA = "doc_id long, row long, ids array<int>"


def encode_sorted(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id, row, ids``, range-partitioned and sorted by document; ids are kept as the integers' 32 bits."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, row = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text"):
                raw = data.tobytes()
                packed = [p + end for p in own.packed([raw[starts[r] : starts[r + 1]] for r in range(j - i)])]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.arange(row, row + j - i)), ids], names=["doc_id", "row", "ids"])
                row += j - i

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    by_id = plain.repartitionByRange(shuffle_width(docs), *order).sortWithinPartitions(*order)
    return by_id.mapInArrow(encode, SCHEMA)


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, row_index_stride: int = 1000) -> None:
    (
        encode_sorted(docs, vocabulary, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("compression", "snappy")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def digests(tokens: DataFrame) -> DataFrame:
    """What the files hold, a row for each document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it: a running sum inside each file, plus the sums of
    the files before it (one row a file)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "row", "ids", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"))
    rows = materialise(rows.mapInArrow(sums, "doc_id long, row long, file long, n_tokens long, ids_crc32 long"), "digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    start = (F.col("inside") + F.coalesce(F.col("before"), F.lit(0))).alias("start")
    return rows.join(F.broadcast(before), "file").select("doc_id", start, "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of ``docs(doc_id, text)`` to the shared folder and reads their digests back."""
    path = work_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, vocabulary, end_id)
    return digests(read_token_ids(docs.sparkSession, path))
