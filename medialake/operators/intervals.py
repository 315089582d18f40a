"""Intervals: covered length, overlap, as-of assignment, context joins and peaks."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from . import ordered


def covered_length(rows: DataFrame, key: str, begin: str = "start", end: str = "end", one_task: int = ordered.ONE_TASK) -> DataFrame:
    """Length of the union of each key's intervals. Where a key has more than ``one_task`` of them, each range of its
    intervals starts from the furthest end of those before."""
    if ordered.hot(rows, key, one_task):
        parts = ordered.carry(ordered.ranges(rows.select(key, begin, end), key, begin, end), key, F.max(end), F.max)
        inside = F.max(end).over(ordered.inside(key, begin, end).rowsBetween(W.unboundedPreceding, -1))
        reached = parts.withColumn("_reached", F.greatest(inside, "_carried"))
    else:
        before = W.partitionBy(key).orderBy(begin, end).rowsBetween(W.unboundedPreceding, -1)
        reached = rows.withColumn("_reached", F.max(end).over(before))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(begin), F.coalesce("_reached", F.col(begin))))
    return reached.groupBy(key).agg(F.sum(fresh).alias("covered"))


def overlapping(rows: DataFrame, low, high, begin: str = "start", end: str = "end") -> DataFrame:
    """Intervals that share a point with ``[low, high)``; either bound may be None."""
    out = rows if low is None else rows.filter(F.col(end) > low)
    return out if high is None else out.filter(F.col(begin) < high)


def context(hits: DataFrame, rows: DataFrame, key: str, around: float, row_id: str, begin: str = "start", end: str = "end", bucket: float = 60.0) -> DataFrame:
    """``hit_id`` with the rows of the same key that overlap the hit widened by ``around`` at both ends, itself left out.

    Both sides are dealt to the time buckets that they touch, so a hit meets the rows near it by equality; a pair is
    taken in the first bucket that both touch."""
    width = max(bucket, 2.0 * around)
    touched = lambda a, b: F.sequence(F.floor(a / width), F.floor(F.greatest(a, b) / width))
    left = hits.select(F.col(row_id).alias("hit_id"), F.col(key).alias("_key"), (F.col(begin) - around).alias("_low"), (F.col(end) + around).alias("_high"))
    left = left.withColumn("_bucket", F.explode(touched(F.col("_low"), F.col("_high"))))
    right = rows.withColumn("_own", F.explode(touched(F.col(begin), F.col(end))))
    near = (right[key] == left["_key"]) & (right["_own"] == left["_bucket"]) & (right[end] > left["_low"]) & (right[begin] < left["_high"]) & (right[row_id] != left["hit_id"])
    met = left.join(right, near).filter(F.col("_bucket") == F.greatest(F.floor(F.col("_low") / width), F.floor(F.col(begin) / width)))
    return met.drop("_key", "_low", "_high", "_bucket", "_own")


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str, one_task: int = ordered.ONE_TASK) -> DataFrame:
    """Each row with ``value`` of the latest mark of its key at or before it, by one sorted pass over both; of marks at one
    time the largest counts. Where a key has more than ``one_task`` rows and marks, each range of them starts from the
    last mark before it."""
    left = rows.select("*", F.lit(1).alias("_side"), F.col(at).alias("_at"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
    right = marks.select(key, F.col(mark_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both, order = left.unionByName(right, allowMissingColumns=True), ("_at", "_side", "_value")
    if ordered.hot(both, key, one_task):
        latest = F.max_by(F.struct("_value"), F.when(F.col("_value").isNotNull(), F.struct(*order)))["_value"]
        parts = ordered.carry(ordered.ranges(both, key, *order), key, latest, lambda edge: F.last(edge, ignorenulls=True))
        by = ordered.inside(key, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
        found = parts.withColumn(value, F.coalesce(F.last("_value", ignorenulls=True).over(by), "_carried")).drop("_part", "_carried")
    else:
        by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        found = both.withColumn(value, F.last("_value", ignorenulls=True).over(by))
    return found.filter("_side = 1").drop("_side", "_at", "_value")


def peaks(heatmap: str, n: int, spacing: int = 3):
    """Up to ``n`` strongest slices of an array of ``(start, end, value)``, each ``spacing`` slice widths from those before."""
    strongest = f"array_sort({heatmap}, (a, b) -> CASE WHEN a.value > b.value THEN -1 WHEN a.value < b.value THEN 1 WHEN a.start < b.start THEN -1 ELSE 1 END)"
    return F.expr(
        f"""aggregate({strongest}, slice({heatmap}, 1, 0), (chosen, s) ->
            CASE WHEN size(chosen) < {n} AND forall(chosen, p -> abs(s.start - p.start) >= {spacing} * (s.end - s.start)) THEN concat(chosen, array(s)) ELSE chosen END)"""
    )
