"""Streams: event log, upserts by micro-batch, item states, and two analogues of a server's windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import store as st

STATES_FINAL = {"indexed", "no-captions", "excluded"}


def event_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends events to a log, each once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, store: st.Store, table: str, key: str, seq: str, updated: list[str], checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the buckets of a table that it touches. A batch that runs again changes nothing,
    since an upsert of the same rows is the same."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        kept = batch.persist()  # read for its buckets and for its rows
        store.commit(merges={table: st.Merge(kept, key, seq, updated)}, based_on=store.manifest()["snapshot"])
        kept.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def item_states(attempts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last state of each item of ``attempts(video_id, outcome, at)``: pending and failed items may be tried again,
    and a final state stays."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now, tries = state.get if state.exists else ("pending", 0)
        for frame in frames:
            for outcome in frame.sort_values("at")["outcome"]:
                if now not in STATES_FINAL:
                    now, tries = outcome, tries + 1
        state.update((now, tries))
        yield pd.DataFrame({"video_id": [key[0]], "state": [now], "tries": [tries]})

    out = attempts.groupBy("video_id").applyInPandasWithState(step, "video_id string, state string, tries int", "state string, tries int", "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark, path: str) -> DataFrame:  # noqa: ANN001
    rows = spark.read.parquet(path)
    return rows.groupBy("video_id").agg(F.max_by("state", "batch").alias("state"), F.max_by("tries", "batch").alias("tries"))


def request_rate(events: DataFrame, width: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Events a key and fixed window; ``late`` is how long a stream waits for stragglers."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a key's events with no pause of ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
