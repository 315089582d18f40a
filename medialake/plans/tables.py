"""The driver's tables in the roles of the store's: orders are videos, lineitems comments, customers channels,
conversations threaded comments, documents passages, events a log."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.fts import search_tokens
from ..operators.index import Index, build
from ..work import work_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("upload_date"),
        F.col("o_totalprice").alias("view_count"), F.col("o_orderstatus").alias("availability"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("detail_at"), F.col("o_orderkey").alias("catalog_rank"), (F.col("o_orderkey") % 3600).alias("duration_s"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("like_count"), F.col("l_shipdate").alias("published_at"),
        F.col("l_partkey").alias("author_id"), F.col("l_suppkey").alias("author_part"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tab"))


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: turn 0 is a thread's root."""
    c = read(spark, sf_dir, "conversations")
    cid = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit(".0")))
    return c.select(cid.alias("comment_id"), parent.alias("parent_id"), "conv_id", "turn", F.col("role").alias("author"), "text", F.timestamp_seconds(F.col("turn")).alias("published_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment harvest for each order: what it holds, what was expected, and every fifth one capped."""
    have = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("have"))
    o = read(spark, sf_dir, "orders").join(have, F.col("o_orderkey") == F.col("k"), "left")
    key = F.col("o_orderkey")
    exhausted = key % 3 == 1
    return o.select(
        F.lit("comments").alias("scope"), key.alias("target_id"), F.coalesce("have", F.lit(0)).alias("have"), F.when(key % 3 != 2, F.when(exhausted, F.coalesce("have", F.lit(0))).otherwise(F.lit(4))).cast("long").alias("expected"),
        F.when(exhausted, "source-exhausted").when(key % 3 == 0, "comment_count").alias("expected_source"), F.when(exhausted, key % 4 != 0).alias("ran_to_exhaustion"),
        F.when(key % 5 == 0, F.lit(3)).cast("long").alias("limit_applied"), F.when(key % 7 == 0, F.lit("TIMEOUT")).alias("reason"), F.lit(None).cast("string").alias("resume_token"), F.col("o_orderdate").alias("harvested_at"),
    )


_indexes: dict[tuple[str, str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str, kind: str) -> Index:
    """The index of the documents, built when a session first asks for it: ``ranked`` for BM25, ``by_source`` with each
    source as a corpus, ``boolean`` with positions."""
    name = (spark.sparkContext.applicationId, sf_dir, kind)
    if name not in _indexes:
        path, rows = work_path(spark, f"index-{kind}"), read(spark, sf_dir, "documents")
        if kind == "boolean":
            _indexes[name] = build(rows, path, search_tokens("text"), positions=True)
        else:
            _indexes[name] = build(rows, path, corpus="source" if kind == "by_source" else None)
    return _indexes[name]
