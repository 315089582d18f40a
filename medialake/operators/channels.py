"""Channel listings: tabs, ranks, new uploads, aliases, chapters by name, reconciliation."""

from __future__ import annotations

import base64
import json

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.scalars import channel_key

# A channel id, and a handle, anywhere in a text.
ID_IN_TEXT, HANDLE_IN_TEXT = r"UC[A-Za-z0-9_-]{22}", r"@[\w.-]+"


def union_tabs(listings: DataFrame, max_videos: int | None = None, step: int = 4096) -> DataFrame:
    """One row a video of ``listings(channel_id, tab, tab_order, position, video_id, ...)``: the first tab owns it, the
    others are listed, and ``catalog_rank`` is its place in the walk. A place is counted in two steps, over ranges of
    ``step`` positions of a tab and within each, so no task sorts a whole channel."""
    walk = F.struct("tab_order", "position")
    owned = listings.groupBy("channel_id", "video_id").agg(F.min(walk).alias("_walk"), F.min_by("tab", walk).alias("tab"), F.collect_set("tab").alias("_tabs"))
    owned = owned.withColumn("_range", F.struct(F.col("_walk.tab_order").alias("t"), F.floor(F.col("_walk.position") / step).alias("r")))
    ranges = owned.groupBy("channel_id", "_range").agg(F.count("*").alias("_n"))
    before = ranges.select("channel_id", "_range", F.coalesce(F.sum("_n").over(W.partitionBy("channel_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("channel_id", "_range").orderBy("_walk", "video_id")) - 1
    out = owned.withColumn("_inside", inside).join(before, ["channel_id", "_range"]).withColumn("catalog_rank", F.col("_before") + F.col("_inside"))
    out = out.select("channel_id", "video_id", "tab", F.array_sort(F.array_remove("_tabs", F.col("tab"))).alias("also_in_tabs"), "catalog_rank")
    return out if max_videos is None else out.filter(F.col("catalog_rank") < max_videos)


def new_uploads(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Videos listed but not known; one listed in several tabs is of the first."""
    once = listed.groupBy("video_id").agg(F.min_by("tab", F.struct("tab_order", "position")).alias("tab"), F.min("tab_order").alias("tab_order"))
    return once.join(known.select("video_id"), "video_id", "left_anti")


def resolve_channel(channel: DataFrame, name: str) -> DataFrame:
    """Channels that go by a name: id, handle with or without ``@``, name in any case, URL, or a text that holds one of
    these. More than one row means that the name is ambiguous."""
    asked = channel_key(F.lit(name))
    handle = F.regexp_replace(channel_key("handle"), "^@", "")
    names = F.array_compact(F.array(channel_key("channel_id"), handle, F.concat(F.lit("@"), handle), channel_key("name"), channel_key("channel_url")))
    inside = F.exists(F.array_compact(F.array(F.concat(F.lit("/"), channel_key("channel_id")), F.concat(F.lit("/@"), handle))), lambda k: asked.endswith(k) | asked.contains(F.concat(k, F.lit("/"))))
    return channel.filter(F.array_contains(names, asked) | inside)


def resolve_channels(channel: DataFrame, asked: DataFrame, name: str = "name") -> DataFrame:
    """Every row of ``asked`` with ``status`` found, ambiguous or unknown, and ``channel_id`` where exactly one channel goes by
    the name: an id, a handle with or without ``@``, a name in any case, a URL, or a text that holds an id or a handle.

    Both sides are exploded to alias keys and joined by equality. Of the channels of one alias only the least and the
    greatest id travel, which tells one from many, so an alias that half of the channels share is no hot pair. Each
    spelling is looked up once. A null or blank name is unknown; a channel of null id is no match; rows that repeat are answered each."""
    low = lambda c: F.when(channel_key(c) != "", channel_key(c))
    known = channel.filter(F.col("channel_id").isNotNull())
    names = F.array_compact(F.array(low("channel_id"), low("handle"), low(F.regexp_replace(F.trim("handle"), "^@", "")), low("name"), low("channel_url")))
    aliases = known.select("channel_id", F.explode(F.array_distinct(names)).alias("_key"))
    aliases = aliases.groupBy("_key").agg(F.min("channel_id").alias("_low"), F.max("channel_id").alias("_high"))
    text = F.col("_text")
    held = [F.lower(F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))) for pattern in (ID_IN_TEXT, HANDLE_IN_TEXT)]
    wanted = F.array_compact(F.array(low("_text"), held[0], held[1], F.regexp_replace(held[1], "^@", "")))
    spelt = asked.select(F.col(name).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    keys = spelt.select("_text", F.explode(F.array_distinct(wanted)).alias("_key"))
    met = keys.join(aliases, "_key").groupBy("_text").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    one = F.col("_low") == F.col("_high")
    met = met.select("_text", F.when(one, "found").otherwise("ambiguous").alias("_status"), F.when(one, F.col("_low")).alias("_found"))
    out = asked.join(met, F.col(name) == F.col("_text"), "left")
    return out.select(*asked.columns, F.coalesce("_status", F.lit("unknown")).alias("status"), F.col("_found").alias("channel_id"))


def chapter_by_name(chapters: DataFrame, name: str, key: str = "video_id") -> DataFrame:
    """The chapter of each video that has the name, or else the first that holds it."""
    low = F.lower("title")
    rank = F.when(low == name.lower(), 0).when(low.contains(name.lower()), 1)
    by = W.partitionBy(key).orderBy("_rank", "start")
    return chapters.withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", "_rank")


def reconcile(states: DataFrame, passages: DataFrame, listed: DataFrame) -> DataFrame:
    """``video_id, state``: a video marked indexed without passages is pending again, and so is one newly listed."""
    held = passages.select("video_id").distinct().withColumn("_held", F.lit(True))
    all_ = states.select("video_id", "state").join(listed.select("video_id").distinct(), "video_id", "full_outer").join(held, "video_id", "left")
    state = F.when(F.col("state").isNull(), "pending").when((F.col("state") == "indexed") & F.col("_held").isNull(), "pending").otherwise(F.col("state"))
    return all_.select("video_id", state.alias("state"))


def refilter(states: DataFrame, left_out: Column) -> DataFrame:
    """States after a change of the filters, without reading anything again: what is now excluded is so, what no longer
    is goes back to pending, and what cannot be told keeps its state."""
    state = F.when(left_out, "excluded").when(~left_out & (F.col("state") == "excluded"), "pending").otherwise(F.col("state"))
    return states.withColumn("state", state)


def encode_cursor(start: int, anchor: str) -> str:
    """An opaque place in a listing: the number of the next entry, from 1, and the id of the last one handed out."""
    raw = json.dumps({"v": 1, "start": start, "anchor": anchor}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, str]:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        start, anchor = found["start"], found["anchor"]
        if found["v"] != 1 or type(start) is not int or start < 1 or not isinstance(anchor, str):
            raise ValueError
        return start, anchor
    except (ValueError, KeyError, TypeError) as bad:
        raise ValueError("not a cursor of this listing") from bad


def listing_page(listing: DataFrame, limit: int, cursor: str | None = None, order: str = "position", key: str = "video_id") -> DataFrame:
    """The page of a listing, whose ``position`` counts from 0, that a cursor stands at. New entries move the others on,
    so the entry handed out last may come again: it is left out."""
    start, anchor = (1, "") if cursor is None else decode_cursor(cursor)
    page = listing.filter((F.col(order) >= start - 1) & (F.col(order) < start - 1 + limit))
    return (page.filter(F.col(key) != anchor) if anchor else page).orderBy(order)


def page_state(listing: DataFrame, limit: int, cursor: str | None = None, total: int | None = None, order: str = "position", key: str = "video_id") -> dict[str, object]:
    """Whether the page moved, whether there is more, and the cursor of the next one. Without a total a full page means
    that there may be more."""
    start, anchor = (1, "") if cursor is None else decode_cursor(cursor)
    on_page = (F.col(order) >= start - 1) & (F.col(order) < start - 1 + limit)
    last = F.max_by(F.when(F.col(key) != anchor, F.col(key)), F.when(F.col(key) != anchor, F.col(order)))
    found = listing.filter(on_page).agg(F.count("*").alias("n"), F.count_if(F.col(key) == anchor).alias("again"), last.alias("last")).first()
    after = start + found["n"]
    more = found["n"] == limit if total is None else after <= total and found["n"] > 0
    out = {"drift_detected": bool(anchor) and found["again"] > 0, "has_more": more}
    return out | ({"next_cursor": encode_cursor(after, found["last"])} if more and found["last"] is not None else {})
