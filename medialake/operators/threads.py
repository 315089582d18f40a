"""Comment threads: replies with their parents, orphans, order and counts."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def normalised(raw: DataFrame) -> DataFrame:
    """Raw comments ``(id, parent, text, like_count, author, ...)`` with their defaults; ``root`` means top level. A
    comment without an id keeps its row, under an id made of its fields, so that reading it again gives no other
    comment; rows without an id that are equal in every field share one."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    made_up = F.concat(F.lit("unknown-"), F.substring(F.sha2(F.to_json(F.struct(*sorted(raw.columns))), 256), 1, 32))
    return raw.select(
        F.coalesce("id", made_up).alias("comment_id"), F.nullif(F.col("parent"), F.lit("root")).alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("like_count", F.lit(0)).alias("like_count"), F.coalesce("author", F.lit("Unknown")).alias("author"), "author_id", "author_url", F.col("author_thumbnail").alias("author_thumbnail_url"),
        flag("author_is_uploader"), flag("author_is_verified"), flag("is_pinned"), flag("is_favorited"), F.timestamp_seconds("timestamp").alias("published_at"), F.col("_time_text").alias("time_text"),
    )


def with_roots(comment: DataFrame) -> DataFrame:
    """Each comment with its thread's root. A reply whose parent is missing, or is a reply itself, is an orphan and its
    own root."""
    parents = comment.filter("parent_id IS NULL").select(F.col("comment_id").alias("_parent")).distinct()
    joined = comment.join(parents, comment["parent_id"] == parents["_parent"], "left")
    orphan = F.col("parent_id").isNotNull() & F.col("_parent").isNull()
    root = F.when(F.col("parent_id").isNull() | orphan, F.col("comment_id")).otherwise(F.col("parent_id"))
    return joined.withColumn("is_orphan", orphan).withColumn("root_id", root).drop("_parent")


def assemble(comment: DataFrame) -> DataFrame:
    """``root_id, replies``: a thread for each root, its replies by time; an unknown time counts as the earliest."""
    rooted = with_roots(comment)
    reply = F.when(F.col("root_id") != F.col("comment_id"), F.struct(F.coalesce(F.col("published_at").cast("double"), F.lit(0.0)).alias("at"), "comment_id", "text"))
    return rooted.groupBy("root_id").agg(F.array_sort(F.collect_list(reply)).alias("replies"), F.bool_or("is_orphan").alias("is_orphan"))


def counts(comment: DataFrame) -> DataFrame:
    rooted = with_roots(comment)
    top = F.col("root_id") == F.col("comment_id")
    return rooted.agg(F.count_if(top).alias("threads"), F.count_if("is_orphan").alias("orphans"), F.count_if(top & ~F.col("is_orphan")).alias("roots"), F.count_if(~top).alias("replies"))
