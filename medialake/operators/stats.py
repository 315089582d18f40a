"""Corpus statistics: states, words a minute, monthly uploads, grouped tallies."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import ordered
from .store import Store

STATES = ["indexed", "no-captions", "failed", "excluded", "pending"]


def corpus_stats(videos: DataFrame, corpus: str = "channel_id", one_task: int = ordered.ONE_TASK) -> DataFrame:
    """One row a corpus of ``videos(state, word_count, duration_s, upload_date)``. The median rate is exact; where a corpus
    has more than ``one_task`` videos it is selected by ranks, and no task holds a corpus' rates."""
    states = [F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in STATES]
    rate = F.when((F.col("word_count") > 0) & (F.col("duration_s") > 0), F.col("word_count") / (F.col("duration_s") / 60))
    counts = [F.count("*").alias("videos"), *states, F.sum("word_count").alias("words"), F.min("upload_date").alias("first_upload"), F.max("upload_date").alias("last_upload")]
    rounded = lambda median: F.coalesce(F.floor(median + 0.5), F.lit(0)).alias("words_per_minute")
    if not ordered.hot(videos, corpus, one_task):
        return videos.groupBy(corpus).agg(*counts, rounded(F.percentile(rate, 0.5)))
    middle = ordered.medians(videos.select(corpus, rate.alias("_rate")), corpus, "_rate").select(F.col(corpus).alias("_corpus"), "median")
    found = videos.groupBy(corpus).agg(*counts).join(middle, F.col(corpus).eqNullSafe(F.col("_corpus")), "left")
    return found.withColumn("words_per_minute", rounded(F.col("median"))).drop("_corpus", "median")


def uploads_per_month(videos: DataFrame, date: str = "upload_date") -> DataFrame:
    known = videos.filter(F.col(date).isNotNull())
    return known.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("uploads"))


def state_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with the count of each named value; other values are not counted."""
    return rows.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def image_stats(images: DataFrame) -> DataFrame:
    """Per tab: all, saved, failed and pending images, and the bytes of the saved."""
    saved, failed = F.col("state") == "saved", F.col("state") == "failed"
    pending = F.count_if(~F.coalesce(saved | failed, F.lit(False)))
    return images.groupBy("tab").agg(
        F.count("*").alias("images"), F.count_if(saved).alias("saved"), F.count_if(failed).alias("failed"), pending.alias("pending"), F.coalesce(F.sum(F.when(saved, F.col("bytes"))), F.lit(0)).alias("bytes")
    )


def image_entries(recorded: DataFrame, files: DataFrame, listed: DataFrame) -> DataFrame:
    """``video_id, tab, state, bytes``: recorded entries, of which a saved one without an intact file is pending again,
    and a pending entry for each video of the listings that has none; a video listed in several tabs is of the first.

    ``files(video_id, size)`` are the files that exist, ``listed(video_id, tab, tab_order)`` the listings."""
    first = listed.groupBy("video_id").agg(F.min_by("tab", "tab_order").alias("_tab"))
    both = recorded.join(files.select("video_id", F.col("size").alias("_size")), "video_id", "left").join(first, "video_id", "full_outer")
    intact = F.coalesce(F.col("_size") == F.col("bytes"), F.lit(False))
    state = F.when(F.col("state").isNull() | ~intact, "pending").otherwise(F.col("state"))
    return both.select("video_id", F.coalesce("tab", "_tab").alias("tab"), state.alias("state"), "bytes")


def save_images(store: Store, channel_id: str, entries: DataFrame) -> int:
    """Publishes a channel's image entries and their statistics in one commit."""
    tagged = lambda rows: rows.withColumn("channel_id", F.lit(channel_id))
    changes = {"image": tagged(entries), "image_stats": tagged(image_stats(entries))}
    if store.has("image"):
        changes = {name: store.read(name).filter(F.col("channel_id") != channel_id).unionByName(rows) for name, rows in changes.items()}
    return store.commit(changes, based_on=store.manifest()["snapshot"])


def image_page(images: DataFrame, tab: str | None = None, state: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a channel's images, of a tab and in a state if these are given."""
    rows = images if tab is None else images.filter(F.col("tab") == tab)
    rows = rows if state is None else rows.filter(F.col("state") == state)
    return rows.orderBy("video_id").offset(offset).limit(limit)


def store_totals(channel: DataFrame, video: DataFrame, comment: DataFrame) -> DataFrame:
    """One row with the numbers of channels, videos and comments."""
    parts = [rows.agg(F.count("*").alias(name)) for name, rows in (("channels", channel), ("videos", video), ("comments", comment))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def largest_image(images: str = "thumbnails"):
    """The image of the largest area, then width, of an array of structs."""
    area = "coalesce(i.width, 0) * coalesce(i.height, 0)"
    return F.expr(f"array_max(transform({images}, i -> named_struct('area', {area}, 'width', coalesce(i.width, 0), 'image', i))).image")
