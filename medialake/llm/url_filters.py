"""Operator 8, URL filters: a temporal list join.

List entries are dated: a pattern (a host, or a host with a path prefix) is added to or removed from a list at
a time. A pattern's entries in order become validity intervals ``[added, removed)``, and each capture is
joined as of its fetch time with the intervals that were active then: on its host, its parent domains and its
path prefixes. The join is an equality on the pattern with the interval as a further condition; intervals
of one list and pattern are disjoint, so a capture meets at most one of each.

The interval table is broadcast only while it has at most ``broadcast_rows`` rows; beyond that the same join
shuffles, where a hot host is split by adaptive execution. Each distinct capture is looked up once, and the
captures that some interval blocks go back to their rows. Rows that cannot be blocked get a join key of their
own, so rows without a URL, however many, do not meet in one task.

Defined cases: a null or unparseable URL has no host and is never blocked; a null fetch time meets no
interval; entries with a null pattern, time or action are ignored; entries of one list, pattern and time that
disagree count as a removal; repeated entries count once; an add while active and a remove while inactive
change nothing; repeated captures each get their row; hosts and paths are compared in lower case, in patterns and
URLs alike; a host that is an IP address is split at its dots like any other, so a pattern ``2.10`` covers
``10.1.2.10``; a URL of any length is matched whole; empty tables block nothing or give no rows.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

BROADCAST_ROWS = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, active_from, active_to`` (null: still active) of ``entries(list, pattern, at, action)``."""
    known = entries.filter("pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    events = known.groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    by = W.partitionBy("list", "pattern").orderBy("at")
    changes = events.withColumn("was", F.lag("removed").over(by)).filter(F.coalesce(F.col("was"), F.lit(True)) != F.col("removed"))
    closed = changes.withColumn("active_to", F.lead("at").over(by))
    return closed.filter(~F.col("removed")).select("list", "pattern", F.col("at").alias("active_from"), "active_to")


def patterns_of(url: str = "url"):
    """All patterns that can match a URL: host, parent domains of two labels or more, and path prefixes of the host."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    body = rf"""
    transform(array(split(host, '\\.')), labels -> transform(sequence(1, greatest(size(labels) - 1, 1)), i -> array_join(slice(labels, i, size(labels)), '.')))[0]"""
    folders = r"""
    transform(array(filter(split(path, '/'), p -> p <> '')), parts -> CASE WHEN size(parts) = 0 THEN cast(array() as array<string>) ELSE
        transform(sequence(1, size(parts)), i -> concat(host, '/', array_join(slice(parts, 1, i), '/'))) END)[0]"""
    return host, F.lower(F.regexp_extract(url, PATH, 1)), body, folders


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, fetched_at, host, blocked, n_entries, lists, active_since`` for each row of
    ``captures(page_id, url, fetched_at)``."""
    active = intervals(entries)
    if active.limit(broadcast_rows + 1).count() <= broadcast_rows:
        active = F.broadcast(active)
    host, path, domains, folders = patterns_of()
    rows = captures.select("page_id", "url", "fetched_at", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keys = F.array_distinct(F.concat(F.expr(domains), F.expr(folders)))
    asked = rows.filter("host <> '' AND fetched_at IS NOT NULL").dropDuplicates(["url", "fetched_at"]).select("url", "fetched_at", F.explode(keys).alias("pattern"))
    as_of = (F.col("fetched_at") >= F.col("active_from")) & (F.col("active_to").isNull() | (F.col("fetched_at") < F.col("active_to")))
    hits = asked.join(active, (asked["pattern"] == active["pattern"]) & as_of)
    found = hits.groupBy(F.col("url").alias("_url"), F.col("fetched_at").alias("_at")).agg(
        F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max("active_from").alias("active_since")
    )
    own = F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))  # equal to no URL with a host
    rows = rows.withColumn("_key", F.when((F.col("host") != "") & F.col("fetched_at").isNotNull(), F.col("url")).otherwise(own))
    out = rows.join(found, (F.col("_key") == F.col("_url")) & (rows["fetched_at"] == found["_at"]), "left")
    return out.select(
        "page_id", "url", "fetched_at", "host", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), "active_since"
    )
