"""Ordered scans over keys that no single task could sort.

A window over ``partitionBy(key)`` sorts each key in one task. Where a key holds more rows than ``ONE_TASK``, the rows
are range-partitioned by key and order and written once, so that each range has a number that stays. A scan then runs
within ranges; what it has to know from before its range is a state that each range gives for each key in it. A range
but for the first key in it begins every key it holds, so at most one row a range is carried over, and the carried
rows are broadcast: their number is that of the ranges."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..work import materialise

#: Rows of a key that one task sorts.
ONE_TASK = 1_000_000


def hot(rows: DataFrame, key: str, one_task: int = ONE_TASK) -> bool:
    """Whether a key, null included, has more rows than a task sorts: one count, combined before its shuffle."""
    return (rows.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > one_task


def ranges(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``_part``, the number of the range of ``(key, *order)`` that holds it. Rows equal in all of these are
    in one range. Ranges hold some ``ONE_TASK`` rows, and there are as many as cores at least."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ONE_TASK)
    return materialise(rows.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def inside(key: str, *order: str | Column) -> W:
    """The rows of a key within a range, in order."""
    return W.partitionBy("_part", key).orderBy(*order)


def earlier(key: str) -> W:
    """The ranges of a key before a range."""
    return W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def attach(parts: DataFrame, edges: DataFrame, key: str, carried: dict[str, Column]) -> DataFrame:
    """``parts`` with columns ``carried`` from ``edges(_part, key, ..)``, null in ranges in which their key begins.

    Only keys that go on from an earlier range are kept, at most one a range, which bounds the broadcast."""
    first = W.partitionBy(key).orderBy("_part")
    going_on = edges.withColumn("_nth", F.row_number().over(first)).select(F.col("_part").alias("_p"), F.col(key).alias("_k"), "_nth", *(c.alias(name) for name, c in carried.items())).filter("_nth > 1")
    return parts.join(F.broadcast(going_on), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_p", "_k", "_nth")


def carry(parts: DataFrame, key: str, edge: Column, over: Callable[[str], Column]) -> DataFrame:
    """``parts`` with ``_carried``: the aggregate ``over`` of the states ``edge`` of the key's earlier ranges."""
    edges = parts.groupBy("_part", key).agg(edge.alias("_edge"))
    return attach(parts, edges, key, {"_carried": over("_edge").over(earlier(key))})


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, median``: each key's exact median by selection, nulls left out; the mean of the two middle values where
    ``n`` is even.

    Equal values are counted before anything is ordered. Ranges of the distinct values give their totals, the totals
    say which ranges hold the middle ranks, and only these ranges are ranked: no buffer holds a key's values. A key with
    nulls only has no row."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = ranges(counted, key, "_v")
    totals = parts.groupBy("_part", key).agg(F.sum("_c").alias("_sum"))
    whole = W.partitionBy(key)
    placed = totals.select("_part", key, F.coalesce(F.sum("_sum").over(earlier(key)), F.lit(0)).alias("_before"), "_sum", F.sum("_sum").over(whole).alias("n"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = lambda rank, a, b: (rank >= a) & (rank < b)
    after = F.col("_before") + F.col("_sum")
    middle = placed.filter(holds(low, F.col("_before"), after) | holds(high, F.col("_before"), after)).select(F.col("_part").alias("_p"), F.col(key).alias("_k"), "_before", "n")
    chosen = parts.join(middle, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    upto = F.col("_before") + F.sum("_c").over(inside(key, "_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = chosen.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    of = lambda rank: F.max(F.when(holds(rank, F.col("_from"), F.col("_to")), F.col("_v").cast("double")))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), ((of(low) + of(high)) / 2).alias("median"))
