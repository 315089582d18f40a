"""The library: saved items, their tags and their documents."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.scalars import merge_tags, remove_tags
from ..functions.text import excerpt, weighted_tokens
from . import retrieval


def save(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with new ones; a known video is replaced."""
    return items.join(new.select("video_id"), "video_id", "left_anti").unionByName(new.select(items.columns))


def delete(items: DataFrame, documents: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    return items.filter(~F.col("video_id").isin(ids)), documents.filter(~F.col("video_id").isin(ids))


def retag(items: DataFrame, video_id: str, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    added = F.array(*map(F.lit, add)).cast("array<string>")
    tags = remove_tags(merge_tags("tags", added), list(remove))
    return items.withColumn("tags", F.when(F.col("video_id") == video_id, tags).otherwise(F.col("tags")))


def listing(items: DataFrame, tag: str | None = None) -> DataFrame:
    """Newest first; with a tag, those of which a tag holds it."""
    rows = items if not tag else items.filter(F.exists("tags", lambda t: F.lower(t).contains(tag.lower())))
    return rows.orderBy(F.desc("date_saved"), "video_id")


def all_tags(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def documents_of(rows: DataFrame) -> DataFrame:
    """Documents ``(id, video_id, title, kind, text)`` without malformed ones; of one id the last stays."""
    known = rows.filter("id IS NOT NULL AND text IS NOT NULL AND kind IN ('summary', 'skill', 'transcript')")
    return known.groupBy("id").agg(*(F.max_by(c, "doc_order").alias(c) for c in known.columns if c != "id"))


def search(documents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    found = retrieval.search(documents, query, weighted_tokens("title", "text"), key="id")
    best = retrieval.top(found, limit, key="id")
    return best.join(documents.select("id", "video_id", "title", "kind", excerpt("text", retrieval.query_terms(query)).alias("excerpt")), "id").orderBy(F.desc("score"), "id")
