"""Permissive readers of raw records: bad lines are skipped, bad documents are absent or an error, as asked."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.scalars import format_duration, playability, upload_date, watch_url

RAW_VIDEO = (
    "id string, title string, channel string, channel_id string, channel_url string, channel_follower_count long, upload_date string, duration double, view_count long, "
    "like_count long, comment_count long, categories array<string>, tags array<string>, age_limit int, availability string, live_status string, was_live boolean, description string, "
    "thumbnail string, chapters array<struct<title:string,start_time:double,end_time:double>>, heatmap array<struct<start_time:double,end_time:double,value:double>>, "
    "automatic_captions map<string,variant>, subtitles map<string,variant>, track string, artist string, album string, release_year int, width int, height int, fps double"
)
RAW_LISTING = "id string, title string, duration double, upload_date string, view_count long, live_status string, thumbnails array<struct<id:string,url:string,width:int,height:int>>"
RAW_COMMENT = (
    "id string, parent string, author string, author_id string, author_url string, author_thumbnail string, author_is_uploader boolean, author_is_verified boolean, text string, "
    "like_count long, is_pinned boolean, is_favorited boolean, timestamp long, _time_text string"
)
RAW_SPONSOR = "videoID string, segments array<struct<category:string,segment:array<double>,votes:int>>"
RAW_SEARCHED_VIDEO = "id string, title string, duration double, channel string, view_count long, url string"
RAW_SEARCHED_CHANNEL = "id string, channel string, title string, channel_id string, uploader_id string, channel_follower_count long, channel_url string, description string"
RAW_PLAYLIST = "id string, title string, url string"
RAW_IMAGE = "struct<id:string,url:string,width:int,height:int>"
RAW_LISTING_META = (
    "id string, title string, channel string, channel_id string, uploader_id string, channel_url string, channel_follower_count long, channel_is_verified boolean, description string, "
    f"tags array<string>, playlist_count long, modified_date string, webpage_url string, thumbnails array<{RAW_IMAGE}>"
)
RAW_ASR = "transcription array<struct<offsets:struct<`from`:long,`to`:long>,text:string>>"
RAW_FORMATS = "formats array<struct<format_id:string,ext:string,resolution:string,width:int,height:int,fps:double,filesize:long,filesize_approx:double,vcodec:string,acodec:string,format_note:string>>"
# Keys of a raw record that are not stored, and how much of the description is.
STRIPPED = ["formats", "requested_formats", "automatic_captions", "subtitles", "thumbnails", "comments", "heatmap"]
PREVIEW_CHARS = 500
# Hosts of a channel's images.
IMAGE_HOSTS = ["i.ytimg.com", "yt3.googleusercontent.com", "yt3.ggpht.com"]
#: What a speech recogniser writes where nobody speaks (a fixed value).
SILENCE = "[BLANK_AUDIO]"


def ndjson_lines(lines: DataFrame, schema: str, required: str = "id", line: str = "value", keep: list[str] = ()) -> DataFrame:
    """Records of JSON lines, with the columns to ``keep``; a line that is not one, or lacks the required field, is
    skipped."""
    parsed = lines.select(*keep, F.from_json(line, schema, {"mode": "PERMISSIVE"}).alias("r")).select(*keep, "r.*")
    return parsed.filter(F.col(required).isNotNull())


def ndjson(spark: SparkSession, path: str, schema: str, required: str = "id") -> DataFrame:
    return ndjson_lines(spark.read.text(path), schema, required)


def json_documents(texts: DataFrame, schema: str, column: str = "value", strict: bool = False) -> DataFrame:
    """Documents of a text column. A bad one is an error if ``strict``, and absent otherwise."""
    # the schema gets a field of its own in which the parser leaves what it cannot read
    fields = T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = texts.select(F.from_json(column, wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    if strict:
        checked = parsed.withColumn("_bad", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("not a valid document: "), F.substring("_bad", 1, 64)))))
        return checked.filter(F.col("_bad").isNull()).drop("_bad")
    return parsed.filter(F.col("_bad").isNull()).drop("_bad")


def document_files(spark: SparkSession, path: str, schema: str, order: str | None = None) -> DataFrame:
    """One row for each JSON file of a folder that fits the schema, with its path; newest first by ``order``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    fields = T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = files.select("path", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r IS NOT NULL AND r._bad IS NULL")
    out = parsed.select("path", *(f"r.{f.name}" for f in fields.fields))
    return out.orderBy(F.desc_nulls_last(order), "path") if order else out


def records_of_map(documents: DataFrame, column: str, kind: str) -> DataFrame:
    """``key, value`` of a JSON object's entries that fit the type; others are dropped one by one."""
    entries = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "raw"))
    parsed = entries.select("key", F.from_json("raw", kind, {"mode": "PERMISSIVE"}).alias("value"))
    return parsed.filter("value IS NOT NULL")


def listing_rows(raw: DataFrame) -> DataFrame:
    """Rows of a flat listing with typed date and the largest image."""
    from ..operators.stats import largest_image

    return raw.filter("id IS NOT NULL").select(
        F.col("id").alias("video_id"), F.coalesce("title", F.lit("Unknown title")).alias("title"), F.coalesce("duration", F.lit(0.0)).alias("duration_s"),
        upload_date("upload_date").alias("upload_date"), "view_count", "live_status", largest_image("thumbnails")["url"].alias("thumbnail_url"),
    )


def _or(column: str, default: object) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def searched_videos(raw: DataFrame) -> DataFrame:
    """Videos of a search's answer, ``raw`` in ``RAW_SEARCHED_VIDEO``, with defaults for what it leaves out."""
    duration = _or("duration", 0.0)
    return raw.filter("id IS NOT NULL").select(
        F.col("id").alias("video_id"), _or("title", "Unknown").alias("title"), duration.alias("duration_s"), format_duration(duration).alias("duration_formatted"), _or("channel", "Unknown").alias("channel"),
        _or("view_count", 0).alias("view_count"), F.coalesce("url", watch_url(F.col("id"))).alias("url"),
    )


def searched_channels(raw: DataFrame) -> DataFrame:
    """Channels of a search's answer, ``raw`` in ``RAW_SEARCHED_CHANNEL``."""
    return raw.select(
        F.coalesce("channel_id", "id", F.lit("")).alias("channel_id"), F.coalesce("channel", "title", F.lit("Unknown")).alias("name"), _or("uploader_id", "").alias("handle"),
        _or("channel_follower_count", 0).alias("subscriber_count"), _or("channel_url", "").alias("channel_url"), _or("description", "").alias("description"),
    )


def playlists(raw: DataFrame, limit: int, key: str = "channel_id") -> DataFrame:
    """One row a channel with its first ``limit`` playlists, from listed entries ``(key, position, id, title, url)``. As
    many as were asked for mean that there may be more; a channel without entries has no row."""
    link = F.concat(F.lit("https://www.youtube.com/playlist?list="), F.col("id"))
    entry = F.struct("position", F.col("id").alias("playlist_id"), _or("title", "Untitled").alias("title"), F.coalesce("url", link).alias("url"))
    first = raw.filter((F.col("position") < limit) & F.col("id").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("playlists"))
    return first.withColumn("may_have_more", F.size("playlists") >= limit)


def listing_total(raw: DataFrame) -> DataFrame:
    """How many entries a listing says it has; null where it says nothing."""
    return raw.select(F.col("playlist_count").alias("total"))


def playlist_info(raw: DataFrame, asked: Column) -> DataFrame:
    """A playlist's own record, ``raw`` in ``RAW_LISTING_META``; ``asked`` is the URL that was asked for."""
    return raw.select(
        _or("id", "").alias("playlist_id"), _or("title", "Unknown").alias("title"), _or("channel", "").alias("channel"), _or("uploader_id", "").alias("handle"), _or("channel_url", "").alias("channel_url"),
        _or("playlist_count", 0).alias("video_count"), upload_date("modified_date").alias("last_modified"), F.coalesce("webpage_url", asked).alias("url"), _or("description", "").alias("description"),
    )


def channel_info(raw: DataFrame, asked: Column) -> DataFrame:
    """A channel's own record. Its avatar is the image named so, or else the largest square one; its banner the one
    named so, or else the largest of more than twice its height in width. Images on other hosts do not count."""
    from ..operators.stats import largest_image

    hosts = ", ".join(f"'{h}'" for h in IMAGE_HOSTS)
    own = f"filter(thumbnails, i -> lower(regexp_extract(i.url, '^https://([^/?#:@]+)', 1)) IN ({hosts}))"

    def image(name: str, shape: str) -> Column:
        return F.coalesce(F.expr(f"get(filter({own}, i -> i.id = '{name}'), 0).url"), largest_image(f"filter({own}, i -> {shape})")["url"])

    return raw.select(
        _or("channel_id", "").alias("channel_id"), _or("channel", "Unknown").alias("name"), _or("uploader_id", "").alias("handle"), _or("channel_follower_count", 0).alias("subscriber_count"),
        F.coalesce("channel_url", asked).alias("channel_url"), _or("description", "").alias("description"), F.col("channel_is_verified").alias("is_verified"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), image("avatar_uncropped", "i.width = i.height").alias("avatar_url"),
        image("banner_uncropped", "i.width > 2 * i.height").alias("banner_url"),
    )


def stripped(record: Column) -> Column:
    """A raw record, a map of its fields as JSON texts, as it is stored: without the bulk, and with a preview of its
    description."""
    kept = F.map_filter(record, lambda k, _: ~k.isin(STRIPPED))
    text = F.from_json(F.concat(F.lit('{"d":'), F.element_at(kept, "description"), F.lit("}")), "d string")["d"]
    quoted = F.regexp_extract(F.to_json(F.struct(F.substring(text, 1, PREVIEW_CHARS).alias("d"))), r'(?s)^\{"d":(.*)\}$', 1)
    cut = F.map_concat(F.map_filter(kept, lambda k, _: ~k.isin("description", "description_truncated")), F.create_map(F.lit("description"), quoted, F.lit("description_truncated"), F.lit("true")))
    return F.when(F.length(text) > PREVIEW_CHARS, cut).otherwise(kept)


def video_stats(raw: DataFrame) -> DataFrame:
    """Full video rows with defaults. Caption maps become lists of their languages, in the record's order; ``unplayable``
    is the code of why a video cannot be read, null if it can."""
    none = F.array().cast("array<string>")
    langs = lambda c: F.coalesce(F.map_keys(c), none)
    duration, text = _or("duration", 0.0), _or("description", "")
    return raw.filter("id IS NOT NULL").select(
        F.col("id").alias("video_id"), _or("title", "Unknown").alias("title"), watch_url(F.col("id")).alias("url"), _or("channel", "Unknown").alias("channel"), "channel_id", "channel_url", "channel_follower_count",
        upload_date("upload_date").alias("upload_date"), duration.alias("duration_s"), format_duration(F.floor(duration)).alias("duration_formatted"), "view_count", "like_count", "comment_count",
        F.coalesce("tags", none).alias("tags"), F.coalesce("categories", none).alias("categories"), _or("age_limit", 0).alias("age_limit"), "availability", "live_status", _or("was_live", False).alias("was_live"),
        F.substring(text, 1, PREVIEW_CHARS).alias("description_preview"), (F.length(text) > PREVIEW_CHARS).alias("description_cut"), F.length(text).alias("description_chars"), "chapters", "heatmap",
        (F.coalesce(F.size("heatmap"), F.lit(0)) > 0).alias("has_heatmap"), langs("subtitles").alias("subtitle_languages"), langs("automatic_captions").alias("caption_languages"), F.col("thumbnail").alias("thumbnail_url"),
        playability("availability", "live_status").alias("unplayable"),
    )


def caption_inventory(languages: Column) -> Column:
    """Caption languages, each once and sorted; ``-orig`` variants are left out."""
    return F.array_sort(F.array_distinct(F.filter(languages, lambda k: ~k.endswith("-orig"))))


def formats(raw: DataFrame) -> DataFrame:
    """Download formats without storyboards. A missing resolution is made of width and height, and without these the
    format is audio only; a missing codec is ``none``, and a missing size the approximate one."""
    f = raw.select(F.explode("formats").alias("f")).select("f.*").filter(~F.coalesce(F.col("format_id"), F.lit("")).startswith("sb"))
    size = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    return f.select(
        "format_id", "ext", F.coalesce("resolution", size, F.lit("audio only")).alias("resolution"), "fps", _or("vcodec", "none").alias("vcodec"), _or("acodec", "none").alias("acodec"),
        F.coalesce("filesize", F.col("filesize_approx").cast("long")).alias("filesize"), _or("format_note", "").alias("note"),
    )


#: Hexadecimal digits of an id's SHA-256 by which segments are asked for.
PREFIX_DIGITS = 4


def segments_by_prefix(videos: DataFrame, answers: DataFrame, key: str = "video_id") -> DataFrame:
    """``key, category, start, end, duration, votes`` for the videos asked for, from ``answers(prefix, videoID, segments)``.

    A prefix is the hash prefix that was asked for, and its answer also holds other videos of that bucket; the join is
    on prefix and id together, so a bucket of any size spreads over its ids. An answer filed under a prefix that is not
    its id's is not taken. Ids asked for or answered twice: each once asked for, each answer's segments; a null id, or one
    without an answer, has no rows."""
    prefix = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, PREFIX_DIGITS)
    asked = videos.select(F.col(key).cast("string").alias("videoID"), prefix.alias("prefix")).filter("videoID IS NOT NULL").distinct()
    mine = answers.select(F.lower("prefix").alias("prefix"), "videoID", "segments").join(asked, ["prefix", "videoID"])
    return sponsor_segments(mine).withColumnRenamed("video_id", key)


def sponsor_segments(raw: DataFrame, video_id: str | None = None) -> DataFrame:
    """``video_id, category, start, end, duration, votes`` of hash-prefix answers, for one video or all, in order."""
    rows = raw.select(F.col("videoID").alias("video_id"), F.explode("segments").alias("s")).filter(F.size("s.segment") == 2)
    rows = rows.select("video_id", "s.category", F.get("s.segment", F.lit(0)).alias("start"), F.get("s.segment", F.lit(1)).alias("end"), F.coalesce("s.votes", F.lit(0)).alias("votes"))
    rows = rows.select("video_id", "category", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "votes")
    return (rows if video_id is None else rows.filter(F.col("video_id") == video_id)).orderBy("video_id", "start", "end")


def asr_segments(raw: DataFrame, *keys: str) -> DataFrame:
    """Speech-to-text segments in seconds, without empty ones and the marker of silence, with the record's ``keys``. What a
    recogniser says of other sounds stays."""
    rows = raw.select(*keys, F.posexplode("transcription").alias("ord", "t"))
    text = F.trim("t.text")
    return rows.filter((text != "") & (text != SILENCE)).select(*keys, "ord", (F.col("t.offsets.from") / 1000).alias("start"), (F.col("t.offsets.to") / 1000).alias("end"), text.alias("text"))


def scene_cuts(log: Column) -> Column:
    """Times of scene cuts in a detector's log, each once and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:(\d+(?:\.\d+)?)"), 1), lambda t: t.cast("double"))))


def fresh(rows: DataFrame, now: Column, seconds: int, fetched: str = "fetched_at") -> DataFrame:
    """Cached rows that are younger than ``seconds``."""
    return rows.filter(F.col(fetched) > now - F.make_interval(secs=F.lit(seconds)))
