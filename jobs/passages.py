"""Keeps a corpus of passages up to date with harvested texts: takes the files that are new since the last run.

    python -m jobs.passages --documents IN --output OUT --checkpoint CHECKPOINT --config jobs/passages.json

Reads ``documents(doc_id, text, lang, source)``, a folder or a pattern, as a stream of Parquet files; the stream's checkpoint knows which files were
taken, and a run ends when none is left. Each text is cut into sentences and these into passages by the library's rule. A
micro-batch writes, by overwriting the partitions of its own number:

* ``OUT/passages/batch=N/shelf=K``: ``doc_id, source, lang, ord, n_words, text``; a source's passages lie on one shelf;
* ``OUT/documents/batch=N``: ``doc_id, source, n_passages, n_words``, a row for each text that came, also an empty one;
* ``OUT/log/batch=N``: what was read and written, as JSON.

A batch that is run again after a failure has the same files and the same number, so it writes the same partitions. A text
that comes again under its id replaces the older one: ``current`` reads the passages of each id's newest batch.

Defined cases: a null or empty text has no passages, and takes away those of an older text; rows without an id cannot be
replaced later, so they are logged and not taken; of several rows of one id in a batch the one of the newest file counts,
then of the last path, then the greatest text; a null source is a source of its own; other columns are ignored.
"""

from __future__ import annotations

import json
import logging

import pyspark.sql.functions as F
from medialake.operators.transcript import cut_passages
from pyspark.sql import Column, DataFrame, SparkSession

from jobs import common

log = logging.getLogger("jobs.passages")

SETTINGS: dict[str, object] = {"files_per_batch": 256, "shelves": 16}
INPUT = "doc_id long, text string, lang string, source string"
PASSAGES = "doc_id long, source string, lang string, ord int, n_words int, text string, batch long, shelf int"
DOCUMENTS = "doc_id long, source string, n_passages int, n_words int, batch long"


def shelf_of(source: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(shelves)).cast("int")


def newest(rows: DataFrame) -> DataFrame:
    """One row an id. Ids that come once, nearly all, are not shuffled with their texts."""
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once = rows.join(repeated, "doc_id", "left_anti")
    last = F.max_by(F.struct("text", "lang", "source"), F.struct("_time", "_path", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    several = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(last.alias("r")).select("doc_id", "r.*")
    return once.select(several.columns).unionByName(several)


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``passages``; a sentence ends at a line end or behind ``. ! ?`` and a blank."""
    ended = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\r\n]+", "$1\n")
    sentences = F.filter(F.split(ended, "\n"), lambda x: x != "")
    at = lambda i: i.cast("double")
    segs = F.transform(sentences, lambda x, i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), x.alias("text")))
    found = cut_passages(rows.withColumns({"segs": segs, "_starts": F.array().cast("array<double>")}))
    kept = F.filter("passages", lambda p: p["text"] != "")
    return found.withColumn("passages", F.transform(kept, lambda p: F.struct(F.size(F.split(p["text"], " ")).alias("n_words"), p["text"].alias("text"))))


def placed(own: DataFrame) -> DataFrame:
    """A row a passage of ``own``, with its place. An inner posexplode would have "has passages" pushed below the shuffles as
    a filter, which cuts every text several times more."""
    rows = own.select("doc_id", "source", "lang", "batch", F.posexplode_outer("passages").alias("ord", "p")).filter("p IS NOT NULL")
    return rows.select("doc_id", "source", "lang", "ord", "p.n_words", "p.text", "batch")


def take(batch: DataFrame, number: int, output: str, shelves: int) -> dict[str, int]:
    """Writes the partitions of one micro-batch."""
    spark = batch.sparkSession
    into = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{output}/{name}")
    own = cut(newest(batch.filter("doc_id IS NOT NULL"))).withColumn("batch", F.lit(number).cast("long"))
    total = F.aggregate("passages", F.lit(0), lambda a, p: a + p["n_words"])
    # one shuffle puts a shelf's rows into few files; tasks of a large shelf are split
    into(placed(own).withColumn("shelf", shelf_of(F.col("source"), shelves)).hint("rebalance", "shelf"), "passages", "shelf")
    into(own.select("doc_id", "source", F.size("passages").alias("n_passages"), total.alias("n_words"), "batch"), "documents")
    read = batch.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"), F.countDistinct("_path").alias("files")).first()
    mine = spark.read.schema(DOCUMENTS).parquet(f"{output}/documents").filter(F.col("batch") == number)
    wrote = mine.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_passages"), F.lit(0)).alias("passages")).first()
    return read.asDict() | wrote.asDict()


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, files_per_batch: int = 256, shelves: int = 16) -> int:
    """Takes all files of ``documents`` that no run with this checkpoint has taken; returns the number of micro-batches."""
    output, batches = output.rstrip("/"), []

    def each(batch: DataFrame, number: int) -> None:
        found = take(batch, number, output, shelves)
        log.info("batch %d: %s", number, json.dumps(found, sort_keys=True))
        line = batch.sparkSession.createDataFrame([(number, json.dumps(found, sort_keys=True))], "batch long, line string").coalesce(1)
        line.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(f"{output}/log")
        batches.append(number)

    log.info("reading new files of %s", documents)
    rows = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_path"))
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches written to %s", len(batches), output)
    return len(batches)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The passages of each id's newest text: ``doc_id, source, lang, ord, n_words, text``."""
    last = spark.read.schema(DOCUMENTS).parquet(f"{output.rstrip('/')}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(PASSAGES).parquet(f"{output.rstrip('/')}/passages")
    return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch", "shelf")


def main() -> None:
    given = common.arguments(__doc__, "documents", "output", "checkpoint", "config")
    spark = common.session("passages")
    try:
        refresh(spark, given.documents, given.output, given.checkpoint, **common.config(spark, given.config, SETTINGS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
