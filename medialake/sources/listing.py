"""Recorded listings: a file of JSON lines in the order in which a site lists its videos.

Network access is not a Spark job's business; a fetcher writes such files. ``positions`` reads one through Spark's own
text reader, from any path that Spark reaches and in as many tasks as it has splits. The data source ``media_listing``
reads a page of a local file, and a growing one as a stream, a page a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .raw import ndjson_lines

FIELDS = "title string, duration double, view_count long"
SCHEMA = f"position long, video_id string, {FIELDS}"


def positions(spark: SparkSession, path: str) -> DataFrame:
    """The entries of one listing file with their places; lines that are no entry take none.

    Entries are numbered within each split, and the splits' sums, a row a split, are added."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    entries = ndjson_lines(lines, f"id string, {FIELDS}", keep=["_line"]).withColumn("_split", F.shiftright("_line", 33))
    sums = entries.groupBy("_split").agg(F.count("*").alias("_n"))
    before = sums.select("_split", F.coalesce(F.sum("_n").over(W.orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_split").orderBy("_line")) - 1
    return entries.withColumn("_inside", inside).join(before, "_split").select(
        (F.col("_before") + F.col("_inside")).alias("position"), F.col("id").alias("video_id"), "title", "duration", "view_count"
    )


def _rows(path: str, start: int, stop: int | None, place: int = 0, byte: int = 0) -> Iterator[tuple[tuple, int]]:
    """Entries from place ``start`` on, each with the byte behind it; reading begins at ``byte``, the place ``place``."""
    import json

    with open(path, "rb") as lines:
        lines.seek(byte)
        while stop is None or place < stop:
            line = lines.readline()
            if not line.endswith(b"\n") and not line.strip():
                return
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if not isinstance(found, dict) or not found.get("id"):
                continue
            if place >= start:
                yield (place, str(found["id"]), found.get("title"), found.get("duration"), found.get("view_count")), lines.tell()
            place += 1


class ListingSource(DataSource):
    """Options: ``path``; in batch ``start`` (0) and ``limit`` (all); as a stream ``page`` (entries a micro-batch, 1000)."""

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ListingStream(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((self.start, None if self.limit is None else self.start + self.limit))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return (row for row, _ in _rows(self.path, *partition.value))


class ListingStream(SimpleDataSourceStreamReader):
    """The listing a page at a time; what was read before a failure stays."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.page = options["path"], int(options.get("page", 1000))

    def initialOffset(self) -> dict:
        return {"position": 0, "byte": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        place, byte = start["position"], start["byte"]
        found = list(_rows(self.path, place, place + self.page, place, byte))  # a page
        return iter([row for row, _ in found]), {"position": place + len(found), "byte": found[-1][1] if found else byte}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (row for row, _ in _rows(self.path, start["position"], end["position"], start["position"], start["byte"]))
