"""Filtered, sorted and paged reads of the video and comment tables.

A query is a dataclass; present fields become predicates, which Catalyst pushes to the scan. A page and its
total share the predicates and nothing else."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# Sort keys; unknown values come last in either direction, and an id breaks ties.
VIDEO_ORDERS = {
    "newest": [F.desc_nulls_last, "upload_date"], "oldest": [F.asc_nulls_last, "upload_date"], "views": [F.desc_nulls_last, "view_count"],
    "comments": [F.desc_nulls_last, "comment_count"], "catalog": [F.asc_nulls_last, "catalog_rank"],
}
COMMENT_ORDERS = {
    "likes": [F.desc_nulls_last, "like_count"], "newest": [F.desc_nulls_last, "published_at"], "oldest": [F.asc_nulls_first, "published_at"],
    "relevance": [F.desc_nulls_last, "like_count"],
}


#: Videos of a page whose ids are broadcast.
MOST = 10_000


@dataclass(frozen=True)
class VideoQuery:
    channel_id: object = None
    match: str | None = None
    since: str | None = None
    until: str | None = None
    min_duration: float = 0
    with_comments: bool = False
    detailed_only: bool = False
    order: str = "newest"
    limit: int = 25
    offset: int = 0

    def conditions(self) -> list[Column]:
        out = []
        if self.channel_id is not None:
            out.append(F.col("channel_id") == self.channel_id)
        if self.match:
            out.append(F.lower("title").contains(self.match.lower()))
        if self.since:
            out.append(F.col("upload_date") >= F.to_date(F.lit(self.since)))
        if self.until:
            out.append(F.col("upload_date") <= F.to_date(F.lit(self.until)))
        if self.min_duration:
            out.append(F.col("duration_s") >= self.min_duration)
        if self.detailed_only:
            out.append(F.col("detail_at").isNotNull())
        return out


def videos(video: DataFrame, comment: DataFrame, query: VideoQuery) -> DataFrame:
    """All videos that match, before paging."""
    rows = video.filter(all_of(query.conditions()))
    return rows.join(comment.select("video_id"), "video_id", "left_semi") if query.with_comments else rows


def ordered(rows: DataFrame, orders: dict[str, list], order: str, key: str) -> DataFrame:
    direction, column = orders[order]
    return rows.orderBy(direction(column), F.asc(key))


def video_page(video: DataFrame, comment: DataFrame, query: VideoQuery) -> DataFrame:
    """One page of videos with the number of their stored comments.

    The page is cut before comments are counted, so only the comments of its videos are aggregated. Pages of up to
    ``MOST`` videos are broadcast to the comments' scan."""
    page = ordered(videos(video, comment, query), VIDEO_ORDERS, query.order, "video_id").offset(query.offset).limit(query.limit)
    ids = page.select("video_id")
    ids = F.broadcast(ids) if query.limit <= MOST else ids
    stored = comment.select("video_id").join(ids, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("stored_comments"))
    out = page.join(stored, "video_id", "left").withColumn("stored_comments", F.coalesce("stored_comments", F.lit(0)))
    return ordered(out, VIDEO_ORDERS, query.order, "video_id")


def stored_comment_counts(video: DataFrame, comment: DataFrame) -> DataFrame:
    stored = comment.groupBy("video_id").agg(F.count("*").alias("stored_comments"))
    return video.join(stored, "video_id", "left").withColumn("stored_comments", F.coalesce("stored_comments", F.lit(0)))


@dataclass(frozen=True)
class CommentQuery:
    video_id: object = None
    channel_id: object = None
    author: str | None = None
    thread: object = None
    top_level_only: bool = False
    min_likes: float = 0
    order: str = "likes"
    limit: int = 25
    offset: int = 0

    def conditions(self) -> list[Column]:
        out = []
        if self.video_id is not None:
            out.append(F.col("video_id") == self.video_id)
        if self.author:
            out.append((F.col("author_id") == self.author) | (F.col("author") == self.author))
        if self.thread is not None:
            out.append((F.col("comment_id") == self.thread) | (F.col("parent_id") == self.thread))
        if self.top_level_only:
            out.append(F.col("parent_id").isNull())
        if self.min_likes:
            out.append(F.col("like_count") >= self.min_likes)
        return out


def comments(comment: DataFrame, video: DataFrame, query: CommentQuery, matching: DataFrame | None = None) -> DataFrame:
    """All comments that match; ``matching(comment_id)`` holds the result of a text search."""
    rows = comment.filter(all_of(query.conditions()))
    if query.channel_id is not None:
        rows = rows.join(video.filter(F.col("channel_id") == query.channel_id).select("video_id"), "video_id", "left_semi")
    return rows if matching is None else rows.join(matching.select("comment_id"), "comment_id", "left_semi")


def comment_page(comment: DataFrame, video: DataFrame, query: CommentQuery, matching: DataFrame | None = None) -> DataFrame:
    rows = comments(comment, video, query, matching)
    if query.thread is not None:
        rows = rows.orderBy(F.asc_nulls_first("parent_id"), F.asc_nulls_first("published_at"), "comment_id")
    else:
        rows = ordered(rows, COMMENT_ORDERS, query.order, "comment_id")
    return rows.offset(query.offset).limit(query.limit)


def page_envelope(total: int | None, count: int, offset: int, limit: int) -> dict[str, object]:
    """Where a page stands; without a known total a full page means that there may be more."""
    more = offset + count < total if total is not None else count >= limit
    return {"total": total, "count": count, "offset": offset, "has_more": more} | ({"next_offset": offset + count} if more else {})


def with_receipts(page: DataFrame, receipts: DataFrame, target: str, scope: str, most: int = 100) -> DataFrame:
    """The receipts of a page's first ``most`` distinct targets, in one join."""
    ids = page.select(F.col(target).cast("string").alias("target_id")).distinct().orderBy("target_id").limit(most)
    return receipts.filter(F.col("scope") == scope).join(F.broadcast(ids), "target_id")


def targets_of(page: DataFrame, target: str, asked: str | None = None) -> DataFrame:
    """``target_id``: the target that was asked for, and those that the page shows, each once."""
    seen = page.select(F.col(target).cast("string").alias("target_id")).filter("target_id IS NOT NULL")
    if asked is not None:
        seen = seen.unionByName(page.sparkSession.createDataFrame([(asked,)], "target_id string"))
    return seen.distinct()


def receipts_page(receipts: DataFrame, scope: str | None = None, incomplete_only: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of receipts, newest first. The page is cut from the scope, and then shows the incomplete ones only, if
    these are asked for."""
    rows = receipts if scope is None else receipts.filter(F.col("scope") == scope)
    page = rows.orderBy(F.desc_nulls_last("finished_at"), "target_id").offset(offset).limit(limit)
    return page.filter(~F.col("complete")) if incomplete_only else page


def pending_details(video: DataFrame, unreadable: list[str], limit: int | None = None) -> DataFrame:
    """Videos without details that are not known to be unreadable, in catalogue order."""
    waiting = F.col("detail_at").isNull() & (F.col("availability").isNull() | ~F.col("availability").isin(unreadable))
    rows = video.filter(waiting).orderBy(F.asc_nulls_last("catalog_rank"), "video_id")
    return rows if limit is None else rows.limit(limit)


def unreadable_counts(video: DataFrame, unreadable: list[str]) -> DataFrame:
    """Of each channel, the videos without details that are known to be unreadable."""
    known = F.col("detail_at").isNull() & F.coalesce(F.col("availability").isin(unreadable), F.lit(False))
    return video.groupBy("channel_id").agg(F.count_if(known).alias("unreadable"))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` as they are read, failing on the first that breaks a rule: a row that does not fit was written wrong."""
    bad = F.concat_ws(", ", *(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))
    shown = F.raise_error(F.concat(F.lit("a stored row has an unexpected shape: "), bad))
    return rows.filter(F.when(bad == "", True).otherwise(shown))


VIDEO_RULES = lambda: {"video_id": F.col("video_id").isNotNull(), "duration_s": F.col("duration_s").isNull() | (F.col("duration_s") >= 0), "channel_id": F.col("channel_id").isNotNull()}


def catalogue_counts(video: DataFrame) -> DataFrame:
    return video.groupBy("channel_id").agg(F.count("*").alias("videos"), F.count("detail_at").alias("detailed"))


def excluded(min_duration: float | None, since: str | None) -> Column:
    """Whether a video is left out: true, false, or null while its duration or date is unknown.

    An unknown date is null and an unknown duration is null or not positive."""
    known = F.when(F.col("duration_s") > 0, F.col("duration_s"))
    short = known < min_duration if min_duration else F.lit(False)
    old = F.col("upload_date") < F.to_date(F.lit(since)) if since else F.lit(False)
    return short | old


def row_number_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
