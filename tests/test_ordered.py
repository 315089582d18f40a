"""Ordered scans by ranges give the rows that a window over each key gives."""

import random

import pyspark.sql.functions as F
import pytest

from medialake.operators import intervals, ordered, stats, transcript


@pytest.fixture(scope="module")
def one_hot(spark):
    """600 rows, two thirds of them of one key, some of the null key, with ties in time and null ends."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        key = rng.choice(["hot"] * 8 + ["a", "b", None])
        begin = rng.randrange(200) if i % 3 else rng.randrange(20)
        rows.append((key, i, float(begin), None if rng.random() < 0.05 else begin + rng.choice([0.0, 1.0, 3.0, 40.0]), rng.choice(["x", "y", " x ", "", "  "])))
    return spark.createDataFrame(rows, "k string, i int, start double, end double, text string").repartition(5)


def taken(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ranges_carry_the_edges(spark, one_hot):
    parts = ordered.ranges(one_hot, "k", "start", "i")
    assert parts.filter("k = 'hot'").select("_part").distinct().count() > 1
    assert ordered.hot(one_hot, "k", 100) and not ordered.hot(one_hot, "k", 600) and not ordered.hot(one_hot.limit(0), "k", 0)


@pytest.mark.parametrize("empty", [False, True])
def test_forms_agree(one_hot, empty):
    rows = one_hot.limit(0) if empty else one_hot
    assert taken(intervals.covered_length(rows, "k", one_task=0)) == taken(intervals.covered_length(rows, "k"))
    marks = rows.filter("i % 7 = 0").select("k", F.col("start").alias("m"), F.when(F.col("i") % 2 == 0, F.col("i")).alias("v"))
    asof = lambda **k: taken(intervals.as_of(rows, marks, "k", "start", "m", "v", **k))
    assert asof(one_task=0) == asof() and (empty or any(r[-1] is not None for r in asof()))
    lines = rows.withColumn("start", F.when(F.col("i") % 50 != 0, F.floor(F.col("i") / 6).cast("double")))
    dedupe = lambda **k: taken(transcript.rolling_dedupe(lines, "k", "i", **k).select("k", "i", "start", "end", "text"))
    assert dedupe(one_task=0) == dedupe()


def test_a_run_and_a_repeat_across_all_ranges(spark):
    same = spark.range(400).select(F.lit("v").alias("video_id"), F.col("id").alias("ord"), F.lit(1.0).alias("start"), F.col("id").cast("double").alias("end"), F.lit("again").alias("text"))
    assert [(r.ord, r.text) for r in transcript.rolling_dedupe(same, one_task=0).collect()] == [(0, "again")]
    run = same.withColumn("text", F.col("ord").cast("string"))
    assert [(r.ord, r.end, r.text) for r in transcript.rolling_dedupe(run, one_task=0).collect()] == [(0, 399.0, " ".join(map(str, range(400))))]


def test_as_of_reaches_over_empty_ranges(spark):
    rows = spark.range(500).select(F.lit("v").alias("k"), F.col("id").alias("at"))
    marks = spark.createDataFrame([("v", 3, "a"), ("v", 3, "b"), ("v", 400, None), ("w", 1, "c")], "k string, m long, v string")
    got = {r["at"]: r.v for r in intervals.as_of(rows, marks, "k", "at", "m", "v", one_task=0).collect()}
    assert got == {at: "b" if at >= 3 else None for at in range(500)}


def test_medians(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 7.0, rng.random()])) for _ in range(2001)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    table = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: r.m for r in table.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).filter("m IS NOT NULL").collect()}
    assert {r.k: r.median for r in ordered.medians(table, "k", "v").collect()} == pytest.approx(want)
    assert ordered.medians(table.limit(0), "k", "v").count() == 0
    videos = table.select(F.col("k").alias("channel_id"), F.expr("cast(v * 1000 as int)").alias("word_count"), F.lit(60).alias("duration_s"), F.lit("indexed").alias("state"), F.lit(None).cast("date").alias("upload_date"))
    assert taken(stats.corpus_stats(videos, one_task=0)) == taken(stats.corpus_stats(videos))
