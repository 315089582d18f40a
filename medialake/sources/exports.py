"""Sinks: CSV, Markdown, JSON and subtitle files."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.scalars import subtitle_timestamp

# Characters with which a spreadsheet begins a formula, and the export's columns.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]
VERBATIM = {"videoId", "channelId", "commentId", "parentId", "authorId"}
VIDEO_COLUMNS = {
    "videoId": "video_id", "channelId": "channel_id", "title": "title", "durationSeconds": "duration_s", "uploadDate": "upload_date", "viewCount": "view_count",
    "commentCount": "comment_count", "tab": "tab", "alsoInTabs": "also_in_tabs", "detailed": "detail_at", "storedComments": "stored_comments",
}
COMMENT_COLUMNS = {
    "commentId": "comment_id", "videoId": "video_id", "parentId": "parent_id", "author": "author", "authorId": "author_id", "likeCount": "like_count", "isPinned": "is_pinned",
    "isUploader": "author_is_uploader", "isVerified": "author_is_verified", "publishedAt": "published_at", "text": "text",
}
DEFAULT_LIMIT, MOST = 10_000, 100_000


def video_rows(videos: DataFrame) -> DataFrame:
    special = {"alsoInTabs": F.array_join("also_in_tabs", " "), "detailed": F.col("detail_at").isNotNull()}
    return videos.select(*(special.get(h, F.col(c)).alias(h) for h, c in VIDEO_COLUMNS.items()))


def comment_rows(comments: DataFrame) -> DataFrame:
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return comments.select(*((at if h == "publishedAt" else F.col(c)).alias(h) for h, c in COMMENT_COLUMNS.items()))


def defused(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe before it."""
    return F.when(F.substring(text, 1, 1).isin(FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cells(rows: DataFrame) -> DataFrame:
    """All columns as CSV cells: text defused, ids as they are, null empty."""
    kinds = dict(rows.dtypes)
    def cell(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(defused(text) if kinds[name] == "string" and name not in VERBATIM else text, F.lit("")).alias(name)
    return rows.select(*map(cell, rows.columns))


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: the RFC 4180 text of each row."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    cells = csv_cells(rows)
    return cells.select(F.concat_ws(",", *map(quoted, cells.columns)).alias("line"))


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header and CRLF line ends; ``files`` bounds the number of parts."""
    cells = csv_cells(rows)
    (cells if files is None else cells.coalesce(files)).write.csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def markdown_cell(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"([\\|`\[\]])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(out, r"\r\n|\r|\n", " ")


def markdown_lines(rows: DataFrame) -> DataFrame:
    """``line``: each row of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(c)) for c in rows.columns)), F.lit(" |")).alias("line"))


def markdown_header(columns: list[str]) -> list[str]:
    """The two lines above a table."""
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]


def write_markdown(rows: DataFrame, path: str) -> None:
    """A table over one file or several that follow each other by name: a sort puts the header before all rows."""
    head = rows.sparkSession.createDataFrame(list(enumerate(markdown_header(rows.columns), -2)), "_n long, line string")
    shown = rows.withColumn("_n", F.monotonically_increasing_id())
    lines = shown.select("_n", F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(c)) for c in rows.columns)), F.lit(" |")).alias("line"))
    head.unionByName(lines).orderBy("_n").select("line").write.text(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def write_json(rows: DataFrame, receipts: DataFrame, path: str) -> None:
    """Rows as JSON lines, and next to them the receipts that say how complete they are."""
    json_lines(rows).write.text(f"{path}/rows")
    json_lines(receipts).write.text(f"{path}/receipts")


def export(rows: DataFrame, path: str, form: str, receipts: DataFrame | None = None, limit: int = DEFAULT_LIMIT) -> dict[str, object]:
    """Writes at most ``limit`` rows and says how many there are and whether some were left out."""
    limit = min(limit, MOST)
    total = rows.count()
    out = rows.limit(limit)
    if form == "csv":
        write_csv(out, path)
    elif form == "markdown":
        write_markdown(out, path)
    elif form == "json":
        write_json(out, receipts if receipts is not None else rows.select(F.lit(None).alias("receipt")).limit(0), path)
    else:
        raise ValueError(f"unknown form {form}")
    if receipts is not None and form != "json":
        json_lines(receipts).write.text(f"{path}-receipts")  # the sidecar
    return {"rows": min(total, limit), "total": total, "truncated": total > limit}


def subtitles(segments: DataFrame, form: str = "srt", key: str = "video_id", order: str = "ord") -> DataFrame:
    """``key, text``: the SRT or WebVTT file of each video's segments."""
    if form not in ("srt", "vtt"):
        raise ValueError(f"unknown form {form}")
    at = lambda c: subtitle_timestamp(c, "," if form == "srt" else ".")
    cue = F.concat(at("start"), F.lit(" --> "), at("end"), F.lit("\n"), F.col("text"), F.lit("\n"))
    files = segments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cue.alias("c")))), lambda x: x["c"]).alias("cues"))
    numbered = F.transform("cues", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c))
    head, cues = ("", numbered) if form == "srt" else ("WEBVTT\n\n", F.col("cues"))
    return files.select(key, F.concat(F.lit(head), F.array_join(cues, "\n")).alias("text"))
