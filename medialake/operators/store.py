"""The store: tables as Parquet snapshots behind one pointer.

A commit writes what it changes to a new snapshot folder and then renames a small manifest into place, so rows,
receipts and events become visible together and a reader sees one snapshot. A table is written whole, appended to,
or merged: a merged table is dealt into buckets by the hash of its key, and a merge reads and rewrites the buckets
that its batch touches, while the manifest goes on naming the others where they are.

There is one writer at a time; a commit on a snapshot that is no longer current is refused. Files go through
Hadoop's FileSystem. Two writers that meet are told apart by a rename that fails if its target exists, as on HDFS and
local folders; a root in an object store that cannot do that needs a single writer by other means."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

FORMAT = 2
BUCKETS = 64


class StoreError(RuntimeError):
    """The store is damaged, newer than this code, or was changed by another writer."""


@dataclass(frozen=True)
class Merge:
    """A batch for ``upsert``: rows, key, what orders rows of one key, and the columns that a known key takes."""

    batch: DataFrame
    key: str
    seq: str
    updated: list[str]
    buckets: int = BUCKETS


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The current snapshot: its number and the folder of each table."""
        known = self._manifests()
        if not known:
            return {"format": FORMAT, "snapshot": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{known[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
            version = found["format"]
        except (ValueError, KeyError, TypeError) as damage:
            raise StoreError("the store's manifest is damaged") from damage
        if version > FORMAT:
            raise StoreError(f"the store has format {version}, newer than {FORMAT}")
        return found

    def _open(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        folders = [f"{self.root}/{p}" for p in entry["parts"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        return self._open(self.manifest()["tables"][table])

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def commit(self, tables: dict[str, DataFrame] | None = None, appends: dict[str, DataFrame] | None = None, merges: dict[str, Merge] | None = None, based_on: int | None = None) -> int:
        """Publishes new contents, further rows and merged batches of some tables in one step; returns the snapshot's
        number."""
        now = self.manifest()
        if based_on is not None and based_on != now["snapshot"]:
            raise StoreError(f"snapshot {based_on} is no longer current")
        number = now["snapshot"] + 1
        places, folder = dict(now["tables"]), f"snapshots/{number}-{uuid.uuid4().hex[:8]}"
        for name, rows in (tables or {}).items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            places[name] = {"schema": rows.schema.jsonValue(), "parts": {"0": f"{folder}/{name}"}}
        for name, rows in (appends or {}).items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            before = places.get(name, {"schema": rows.schema.jsonValue(), "parts": {}})
            places[name] = {"schema": before["schema"], "parts": before["parts"] | {str(number): f"{folder}/{name}"}}
        for name, merge in (merges or {}).items():
            places[name] = self._merged(places.get(name), merge, f"{folder}/{name}")
        self._publish(number, places)
        return number

    def _merged(self, entry: dict | None, merge: Merge, folder: str) -> dict:
        """A table's entry with a batch merged into the buckets that it touches."""
        if entry is None:
            schema = merge.batch.drop(merge.seq).schema
            entry = {"schema": schema.jsonValue(), "parts": {}, "key": merge.key, "buckets": merge.buckets}
            touched_parts: dict[str, str] = {}
        elif "buckets" not in entry:  # written whole before: this merge deals all of it
            touched_parts, entry = entry["parts"], {"schema": entry["schema"], "parts": {}, "key": merge.key, "buckets": merge.buckets}
        elif entry["key"] != merge.key:
            raise StoreError(f"the table is dealt by {entry['key']}, not by {merge.key}")
        else:
            touched_parts = None
        bucket = F.pmod(F.xxhash64(merge.key), F.lit(entry["buckets"])).cast("int")
        if touched_parts is None:
            touched = {str(r["b"]) for r in merge.batch.select(bucket.alias("b")).distinct().collect()}  # at most a row a bucket
            touched_parts = {b: p for b, p in entry["parts"].items() if b in touched}
        old = self._open({"schema": entry["schema"], "parts": touched_parts})
        new = upsert(old, merge.batch, merge.key, merge.seq, merge.updated).withColumn("_bucket", bucket)
        new.repartition(entry["buckets"], "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        written = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        parts = {b: p for b, p in entry["parts"].items() if b not in touched_parts}
        return entry | {"parts": parts | {n.split("=")[1]: f"{folder}/{n}" for n in written if n.startswith("_bucket=")}}

    def _publish(self, number: int, places: dict) -> None:
        text = json.dumps({"format": FORMAT, "snapshot": number, "tables": places})
        draft = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/_manifests/{number}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise StoreError("another writer was first")

    def compact(self, table: str) -> int:
        """Rewrites an appended table's parts as one."""
        return self.commit({table: self.read(table)}, based_on=self.manifest()["snapshot"])

    def vacuum(self) -> None:
        """Deletes folders and buckets of snapshots that the current manifest does not use."""
        used = {p for entry in self.manifest()["tables"].values() for p in entry["parts"].values()}

        def sweep(folder: str) -> None:
            for status in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                own = f"{folder}/{status.getPath().getName()}"
                if own in used:
                    continue
                if any(p.startswith(own + "/") for p in used):
                    sweep(own)
                elif status.isDirectory():
                    self._fs.delete(status.getPath(), True)

        if self._fs.exists(self._path(f"{self.root}/snapshots")):
            sweep("snapshots")
        for number in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{number}.json"), False)

    def quarantine(self) -> str:
        """Moves the whole store aside and returns where it went."""
        aside = f"{self.root}.damaged-{uuid.uuid4().hex[:8]}"
        if not self._fs.rename(self._path(self.root), self._path(aside)):
            raise StoreError("the store could not be moved")
        return aside


def last_of(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: every column as the last row has it."""
    cols = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(*(F.max_by(c, seq).alias(c) for c in cols))


def upsert(old: DataFrame, batch: DataFrame, key: str, seq: str, updated: list[str]) -> DataFrame:
    """``old`` with a batch merged in: a known key takes the batch's last values of ``updated`` and keeps the rest; a
    new key takes its first row's values, and the last ones of ``updated``."""
    cols = [c for c in old.columns if c != key]
    fresh = batch.groupBy(key).agg(*((F.max_by(c, seq) if c in updated else F.min_by(c, seq)).alias(f"_{c}") for c in cols), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_{c}")).when(F.col("_new") & F.lit(c in updated), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(key, *(pick(c) for c in cols)).select(old.columns)


COMMENT_UPDATED = ["text", "like_count", "is_pinned", "is_favorited", "harvested_at"]


def upsert_comments(old: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    return upsert(old, batch, "comment_id", seq, COMMENT_UPDATED)


def upsert_channel(old: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Everything is replaced but the time at which the channel was first seen."""
    return upsert(old, batch, "channel_id", seq, [c for c in old.columns if c not in ("channel_id", "first_seen_at")])


def upsert_listing(old: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Videos from a tab's listing: tab, date and rank stay as first seen, and further tabs are added to a set."""
    merged = upsert(old, batch, "video_id", seq, [c for c in ("title", "duration_s", "view_count", "live_status", "thumbnail_url", "listed_at") if c in old.columns])
    seen = batch.groupBy("video_id").agg(F.collect_set("tab").alias("_tabs"))
    tabs = F.array_sort(F.array_remove(F.array_union(F.coalesce("also_in_tabs", F.array().cast("array<string>")), F.coalesce("_tabs", F.array().cast("array<string>"))), F.col("tab")))
    return merged.join(seen, "video_id", "left").withColumn("also_in_tabs", tabs).select(old.columns)


def update_details(old: DataFrame, details: DataFrame, columns: list[str], replaced: list[str] = ()) -> DataFrame:
    """Known videos with the details that are given; a null detail keeps what is stored, an unknown video is ignored.
    The ``replaced`` columns, when it was read and the record itself, are set even to null."""
    every = [*columns, *replaced]
    new = details.dropDuplicates(["video_id"]).select("video_id", *(F.col(c).alias(f"_{c}") for c in every), F.lit(True).alias("_read"))
    out = old.join(new, "video_id", "left")
    kept = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    return out.withColumns(kept | {c: F.when(F.col("_read"), F.col(f"_{c}")).otherwise(F.col(c)) for c in replaced}).select(old.columns)


def mark_unreadable(video: DataFrame, failures: DataFrame) -> DataFrame:
    """Videos of ``failures(video_id, availability)`` keep that as the reason why they cannot be read."""
    new = failures.dropDuplicates(["video_id"]).select("video_id", F.col("availability").alias("_why"))
    return video.join(new, "video_id", "left").withColumn("availability", F.coalesce("_why", "availability")).select(video.columns)


def capped_record(record: Column, most: int = 32_768) -> Column:
    """A detail record as JSON of at most ``most`` bytes: description, chapters, tags and categories go in turn, and
    then all but id and title. A record that lost something says so."""
    drops: list[str] = []
    cut = record.withField("detail_truncated", F.lit(True))
    out = F.to_json(F.struct(record["id"].alias("id"), record["title"].alias("title"), F.lit(True).alias("detail_truncated")))
    steps = [F.to_json(record)]
    for name in ("description", "chapters", "tags", "categories"):
        drops.append(name)
        steps.append(F.to_json(cut.dropFields(*drops)))
    for step in reversed(steps):
        out = F.when(F.octet_length(step) <= most, step).otherwise(out)
    return out


def add_parents(video: DataFrame, ids: DataFrame) -> DataFrame:
    """``video`` with a bare row for each id of ``ids(video_id)`` that it lacks."""
    return video.unionByName(ids.select("video_id").distinct().join(video.select("video_id"), "video_id", "left_anti"), allowMissingColumns=True)


def upsert_receipts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Receipts by (scope, target); ``attempts`` starts at 0 and counts the replacements, and a known receipt keeps the
    time at which it was started."""
    keys = ["scope", "target_id"]
    kept = [c for c in ("started_at",) if c in old.columns]
    before = old.select(*keys, F.col("attempts").alias("_attempts"), *(F.col(c).alias(f"_{c}") for c in kept))
    taken = new.drop("attempts").join(before, keys, "left").withColumn("attempts", F.coalesce(F.col("_attempts") + 1, F.lit(0)))
    taken = taken.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in kept}).drop("_attempts", *(f"_{c}" for c in kept))
    return old.join(new.select(keys), keys, "left_anti").unionByName(taken, allowMissingColumns=True).select(old.columns)


def receipt_events(new: DataFrame) -> DataFrame:
    """The log's row of each receipt."""
    return new.select("scope", "target_id", F.col("finished_at").alias("at"), "state", F.col("have").alias("delta"), F.col("reason").alias("note"))


def save_with_receipts(store: Store, new: DataFrame, tables: dict[str, DataFrame] | None = None, merges: dict[str, Merge] | None = None) -> int:
    """Rows, their receipts and the receipts' events, in one commit."""
    now = store.manifest()["snapshot"]
    old = store.read("receipt") if store.has("receipt") else new.withColumn("attempts", F.lit(0)).limit(0)
    return store.commit({**(tables or {}), "receipt": upsert_receipts(old, new)}, {"event": receipt_events(new)}, merges, based_on=now)


def delete_author(comment: DataFrame, author: str) -> DataFrame:
    """Comments without those of an author, named by id or exact name."""
    own = F.coalesce((F.col("author_id") == author) | (F.col("author") == author), F.lit(False))
    return comment.filter(~own)


def delete_channel(channel: DataFrame, video: DataFrame, comment: DataFrame, gone: Callable[[], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the channels that satisfy ``gone()``, and what hangs on them."""
    channels = channel.filter(gone()).select("channel_id")
    videos = video.join(channels, "channel_id", "left_semi").select("video_id")
    return (
        channel.join(channels, "channel_id", "left_anti"),
        video.join(channels, "channel_id", "left_anti"),
        comment.join(videos, "video_id", "left_anti"),
    )


def delete_comments(comment: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Comments without those of ``videos(video_id)``; without any, if no videos are named."""
    return comment.limit(0) if videos is None else comment.join(videos.select("video_id"), "video_id", "left_anti")


def prune_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    left = before.agg(F.count("*").alias("before"))
    right = after.agg(F.count("*").alias("after"))
    return left.crossJoin(right).withColumn("removed", F.col("before") - F.col("after"))  # one row each
