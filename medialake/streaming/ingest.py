"""Ingestion policies: checkpoints, and stopping when a source refuses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from ..operators import phrases
from ..operators.coverage import STOPPING
from ..operators.store import Merge, Store

# Videos between checkpoints, refusals in a row that end a run, and outcomes that end one at once.
CHECKPOINT_EVERY = 10
TOLERANCE = 3
THROTTLED = "RATE_LIMITED"
REFUSING = ["BOT_CHECK", "LOGIN_REQUIRED"]


def until_throttled(attempts: DataFrame, key: str = "channel_id", order: str = "ord", tolerance: int = TOLERANCE) -> DataFrame:
    """The attempts ``(key, order, error)`` up to the one that is the ``tolerance``-th refusal in a row; those after it are
    not made. The last ones are looked at through fixed lags, so no run is gathered."""
    by = W.partitionBy(key).orderBy(order)
    refused = F.coalesce(F.col("error") == THROTTLED, F.lit(False))
    row = attempts.withColumn("_refused", refused)
    full = F.col("_refused")
    for k in range(1, tolerance):
        full = full & F.coalesce(F.lag("_refused", k).over(by), F.lit(False))
    stops = row.withColumn("_full", full).filter("_full").groupBy(key).agg(F.min(order).alias("_stop"))
    return attempts.join(stops, key, "left").filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def detail_run(queue: DataFrame, width: int, key: str = "target_id", order: str = "ord") -> DataFrame:
    """The reads ``(key, ord, code)`` of a queue of details that are made, with ``marks_unreadable``; ``ord`` counts from 0 and
    ``code`` is null where the read succeeds.

    Videos are read ``width`` at a time. The first batch with a stopping code is read to its end and is the last. A failed
    read marks its video, but not by a stopping code, which is the session's fault. The stop of each key is one
    aggregate; nothing is sorted."""
    stopping = F.coalesce(F.col("code").isin(list(STOPPING)), F.lit(False))
    batch = F.floor(F.col(order) / width)
    stops = queue.filter(stopping).groupBy(key).agg(F.min(batch).alias("_stop"))
    made = queue.join(stops, key, "left").filter(F.col("_stop").isNull() | (batch <= F.col("_stop"))).drop("_stop")
    return made.withColumn("marks_unreadable", F.col("code").isNotNull() & ~stopping)


@dataclass(frozen=True)
class Build:
    """How a build ended: videos tried, checkpoints written, and why it stopped early, if it did."""

    attempted: int
    checkpoints: int
    stop_reason: str | None


def build(store: Store, outstanding: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]], order: str = "ord", every: int = CHECKPOINT_EVERY) -> Build:
    """Reads ``outstanding(video_id, ord)`` in order, ``every`` videos at a time, and commits after each step, so that what a
    cancelled build has read stays. ``read`` gives ``(video_id, state, error, ord)`` and passages ``(video_id, ord, text)``.
    Phrases are mined once, at the end of a build that was not cut short by an error."""
    numbered = outstanding.withColumn("_n", F.row_number().over(W.orderBy(order)) - 1)  # a build's queue, not a corpus
    total = numbered.count()
    attempted = checkpoints = in_a_row = 0
    reason: str | None = None
    while attempted < total and reason is None:
        step = numbered.filter((F.col("_n") >= attempted) & (F.col("_n") < attempted + every)).drop("_n")
        states, passages = read(step)
        states = states.persist()  # read for its errors and for the commit
        errors = [r["error"] for r in states.orderBy(order).collect()]  # at most `every` rows
        done = 0
        for error in errors:
            done += 1
            in_a_row = in_a_row + 1 if error == THROTTLED else 0
            if error in REFUSING:
                reason = f"the source refused this client: {error}"
            elif in_a_row >= TOLERANCE:
                reason = "the source is throttling this client"
            if reason:
                break
        kept = states.withColumn("_k", F.row_number().over(W.orderBy(order))).filter(F.col("_k") <= done).drop("_k")
        merges = {"state": Merge(kept, "video_id", order, ["state", "error"])}
        store.commit(merges=merges, appends={"passage": passages.join(kept.select("video_id"), "video_id", "left_semi")}, based_on=store.manifest()["snapshot"])
        states.unpersist()
        attempted, checkpoints = attempted + done, checkpoints + 1
        if not errors:
            break
    if store.has("passage"):
        found = phrases.ranked(phrases.recurring(store.read("passage")))
        store.commit({"phrase": found}, based_on=store.manifest()["snapshot"])
    return Build(attempted, checkpoints, reason)
