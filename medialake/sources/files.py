"""Readers of file formats that Spark has no source for: WebVTT and image headers."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.transcript import rolling_dedupe

_TIME = re.compile(r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})")
_TAG = re.compile(r"<[^>]*(?:>|$)")  # a tag that is not closed ends with its line


def vtt_cues(text: str) -> list[dict[str, object]]:
    """The cue lines of a WebVTT text, in order, without tags; notes, styles and cues out of form are skipped. A cue
    ends at an empty line, and before a line that holds an arrow."""
    out: list[dict[str, object]] = []
    for block in re.split(r"\n\n+", (text or "").replace("\r\n", "\n").replace("\r", "\n")):
        lines = block.strip("\n").split("\n")
        at = next((k for k, line in enumerate(lines[:2]) if "-->" in line), None)
        found = _TIME.search(lines[at]) if at is not None else None
        if not found:
            continue
        n = [int(x or 0) for x in found.groups()]
        begin, end = (n[k] * 3600 + n[k + 1] * 60 + n[k + 2] + n[k + 3] / 1000 for k in (0, 4))
        for line in lines[at + 1 :]:
            if "-->" in line:
                break
            shown = " ".join(html.unescape(_TAG.sub("", line)).split())
            out.append({"ord": len(out), "start": begin, "end": end, "text": shown})
    return out


def read_vtt(texts: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """Segments of WebVTT texts; cues are parsed in Python, and the rest is one window."""

    @F.pandas_udf("array<struct<ord:int,start:double,end:double,text:string>>")
    def cues(values: pd.Series) -> pd.Series:
        return values.map(vtt_cues)

    lines = texts.select(key, F.explode(cues(text)).alias("c")).select(key, "c.*")
    return rolling_dedupe(lines, key)


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of a JPEG, PNG or WebP file from its first bytes; None if it is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 ":
            return "webp", int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None


def read_image_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, format, width, height`` of image files."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [image_header(c) or (None, None, None) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "format": [f[0] for f in found], "width": pd.array([f[1] for f in found], "Int64"), "height": pd.array([f[2] for f in found], "Int64")})

    return files.mapInPandas(probe, "path string, length long, format string, width long, height long")
