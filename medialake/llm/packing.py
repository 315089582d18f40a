"""Operator 2, packing: best-fit decreasing.

Documents become token ids with an end id each. Whole windows are cut from the front of overlong
documents; what is left of each document is one piece, and the pieces are packed into windows in order
of decreasing length, each into the open window with the tightest room. A segment tree over remaining
capacities finds that window.

Only lengths matter to the decision, and they are at most ``window``. The driver therefore packs the
*histogram* of lengths: the tree's leaves count open windows by capacity, equal pieces move together,
and a run of windows stays an interval of ids. Its work and the plan it broadcasts are bounded by the
window size and not by the corpus. Executors then look up each piece by (length, rank among the pieces of
that length); ranks come from one range sort on (length, document), which splits even a single hot length.

Defined cases: a null or empty text is a document of just the end id; repeated rows are packed each on
their own; ties in length are placed in document order; an empty table packs to no rows; other columns
of the input are ignored, whatever their names. A null id sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .bytehash import blocks
from .common import materialise, shuffle_width
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


class CapacityTree:
    """Counts of open windows by remaining capacity, with "least capacity of at least x" in O(log window)."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, capacity: int) -> int | None:
        i = capacity + self.size
        if self.count[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``first ..`` of one length go to windows ``window ..`` at ``offset``, one each."""

    first: int
    window: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], window: int) -> tuple[dict[int, list[Run]], int]:
    """Places ``histogram[length]`` pieces of each length; returns the runs by length and the number of windows."""
    tree, opened, runs = CapacityTree(window), 0, {}
    held: dict[int, list[tuple[int, int]]] = {}  # capacity -> [(first window, how many)]
    for length in sorted(histogram, reverse=True):
        left, placed, out = histogram[length], 0, []
        while left:
            capacity = tree.at_least(length)
            # the tightest open windows, or fresh ones. What is left of a window that takes a piece is tighter
            # still, so each window takes as many of the equal pieces as fit before the next one gets any
            if capacity is None:
                capacity, first, n = window, opened, -(-left // (window // length))
                opened += n
            else:
                first, n = held[capacity].pop()
                tree.add(capacity, -n)
            deep = capacity // length
            filled = min(n, left // deep)
            last = min(n - filled, 1) * (left - filled * deep)  # pieces of one more window
            for pieces, windows in ((deep, filled), (last, 1)):
                if not pieces or not windows:
                    continue
                for level in range(pieces):
                    out.append(Run(placed, first, window - capacity + level * length))
                    placed += windows
                if capacity - pieces * length:
                    _hold(tree, held, capacity - pieces * length, first, windows)
                first, n, left = first + windows, n - windows, left - pieces * windows
            if n:
                _hold(tree, held, capacity, first, n)
        runs[length] = out
    return runs, opened


def _hold(tree: CapacityTree, held: dict[int, list[tuple[int, int]]], capacity: int, first: int, n: int) -> None:
    tree.add(capacity, n)
    held.setdefault(capacity, []).append((first, n))


def pieces_of(docs: DataFrame, vocabulary: str, window: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece: a full window, or the rest of a document; with its ids as bytes if ``with_ids``."""
    schema = PIECE_ARROW.append(pa.field("ids", pa.binary())) if with_ids else PIECE_ARROW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, starts in blocks(batch, "text"):
                raw = data.tobytes()
                texts = [raw[starts[r] : starts[r + 1]] for r in range(j - i)]
                rows: tuple[list, ...] = tuple([] for _ in schema)
                for doc_id, packed in zip(ids[i:j], encode.packed(texts)):
                    packed += end
                    total = len(packed) // 4
                    for start in range(0, total, window):
                        part = packed[4 * start : 4 * (start + window)]
                        for column, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), total, part)):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs ``docs(doc_id, text)``: a row for each piece with its sequence and its offset there."""
    pieces = materialise(pieces_of(docs, vocabulary, window, end_id, with_ids), "pieces")
    # a range sort by (length, document) numbers the pieces of a length without gathering them in one task
    ordered = materialise(
        pieces.repartitionByRange(shuffle_width(pieces), F.col("length"), F.col("doc_id"), F.col("start"), F.xxhash64("ids_crc32", "doc_tokens"))
        .sortWithinPartitions("length", "doc_id", "start")
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "pieces-by-length",
    )
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row for each partition
    before, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        before[part] = at
        at += n
    histogram = {r["length"]: r["n"] for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    runs, _ = best_fit_decreasing(histogram, window)
    smaller, at = {}, 0
    for length in sorted([*histogram, window]):
        smaller[length] = at
        at += histogram.get(length, 0)
    # by length: rank of the first piece of each run, its window and its offset
    found = {length: np.array([(r.first, full + r.window, r.offset) for r in rs], np.int64).T for length, rs in runs.items()}
    found[window] = np.zeros((3, 1), np.int64)
    plan = docs.sparkSession.sparkContext.broadcast((before, smaller, found))  # bounded by the window and the partitions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, smaller, found = plan.value
        for batch in batches:
            length, part, row = (batch.column(c).to_numpy() for c in ("length", "part", "row"))
            sequence, offset = np.zeros((2, len(length)), np.int64)
            cuts = np.flatnonzero(np.diff(length, prepend=-1, append=-1))  # rows are sorted by length
            for a, b in zip(cuts[:-1], cuts[1:]):
                first, to, at = found[int(length[a])]
                parts, where = np.unique(part[a:b], return_inverse=True)
                rank = np.array([before[int(p)] for p in parts])[where] + row[a:b] - smaller[int(length[a])]
                k = np.searchsorted(first, rank, "right") - 1
                sequence[a:b], offset[a:b] = to[k] + rank - first[k], at[k]
            columns = [c for c in batch.schema.names if c not in ("part", "row")]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ordered.mapInArrow(place, PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long")


def token_sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences of ``packed``, a plan made with ``with_ids``: ``sequence_id, ids array<int>`` padded to ``window``.

    Each piece brings the ids that were made when its document was cut, so document ids may be repeated or null."""

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.full(window, pad_id, "<i4")
        for offset, own in zip(rows.column("offset").to_pylist(), rows.column("ids").to_pylist()):
            out[offset : offset + len(own) // 4] = np.frombuffer(own, "<i4")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [out.astype(np.int32)]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(fill, "sequence_id long, ids array<int>")
