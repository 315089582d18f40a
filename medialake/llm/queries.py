"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, licenses, lm_scoring, mixing, near_dedup, packing, quality, repeats, sharding, token_output, url_filters
from .common import table
from .sql import oracles


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SHARD_BYTES = 8 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


# Dated entries of two lists.
LIST_ENTRIES = [
    ("adult-gambling", "casino-win.example.com", "2023-06-01", "add"),
    ("adult-gambling", "casino-win.example.com", "2024-05-01", "remove"),
    ("adult-gambling", "casino-win.example.com", "2024-08-15", "add"),
    ("opt-out", "tionsh.example.net", "2024-03-10", "add"),
    ("opt-out", "tionsh.example.net/en", "2024-01-15", "add"),
    ("opt-out", "tionsh.example.net/en", "2024-07-01", "remove"),
    ("opt-out", "ththan.example.net", "2024-09-01", "add"),
    ("opt-out", "ththan.example.net", "2024-09-01", "remove"),
    ("opt-out", "example.org/de", "2024-02-01", "add"),
    ("spam", "example.org", "2024-11-01", "add"),
    ("spam", "example.org", "2024-11-20", "remove"),
    ("spam", "m.tiontion.example.com", "2024-02-02", "add"),
    ("spam", "blog.ththth.example.org/fr", "2024-04-01", "add"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; a minute of 2024 follows from the page's id."""
    entries = spark.createDataFrame(LIST_ENTRIES, "list string, pattern string, day string, action string")
    entries = entries.select("list", "pattern", F.to_timestamp("day").alias("at"), "action")
    minute = (F.col("page_id") * 7919) % 525600
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))
    return url_filters.evaluate(captures, entries)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "probability"]
    return found.select(columns)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), vocabulary())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), mixing.by_weight())
    own = F.col("takes")[0]
    return mixed.select("doc_id", own["source"].alias("source"), "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken", "copies", "rest")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op3_repeats": op3_repeats,
    "op4_licenses": op4_licenses,
    "op8_url_filters": op8_url_filters,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op2_packing": op2_packing,
    "op5_token_output": op5_token_output,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
}

ORACLES: dict[str, str] = oracles(SHARD_BYTES, LIST_ENTRIES)
