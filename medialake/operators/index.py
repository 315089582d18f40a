"""A persisted inverted index that takes changes, shared by BM25 and boolean search.

An index is a list of immutable *segments*. Each has ``postings``, a row for each term of each document with its count there,
its positions if they are kept, and the document's length; ``terms`` with document frequencies; ``docs`` with a row a
document; and ``dead``, the keys that its batch replaced or deleted. Postings are range-sorted by term and document, so a
term's rows lie together, a hot term's in several files, and every file knows its first and last term. A query looks its
terms up, opens only the files whose range holds one of them, and reads nothing of the documents.

``build`` writes one segment. ``Index.add`` writes a segment of the new documents alone, and ``Index.delete`` one of keys: a
key named by a segment is dead in all older ones. Queries read the live rows of every segment; document frequencies are then
counted over them, and ``corpora`` has the documents and mean length of what lives. Segments are merged by size tiers, once
``FAN`` of them have a size within the same power of ``FAN``; a merge leaves out what is dead.

A version is published by one small file, ``versions/v=N``, after all its tables are written: readers see the newest one
whole, and a crash leaves the older. Two writers of one version: the second fails. Tables that no version names any more
stay until the folder is deleted; a reader that opened an older version can go on.

Defined cases: rows that share a key within one batch are an error (``RepeatedKeysError``), since a document has one text; a
null key is an error as well; a null or empty text is a document without terms; an empty table makes an empty index."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.text import tokens
from ..work import discard, materialise, spread, width

ONE = "all"
#: Segments of one size tier that are merged, and the factor between tiers.
FAN = 4


class RepeatedKeysError(ValueError):
    """Rows of one batch that share a key, or have none."""


class Index:
    """An index at a path, as ``build`` and the changes after it left it. An object keeps to the version it was opened at."""

    def __init__(self, spark: SparkSession, path: str, meta: dict | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = meta or newest(spark, self.path)
        self.key, self.corpus, self.positions = self.meta["key"], self.meta["corpus"], self.meta["positions"]
        self.segments: list[dict] = self.meta["segments"]
        self._statistics: tuple[int, float] | None = None
        self._key_type = _types(self.meta["schemas"]["docs"])["key"]

    def _files(self, segment: dict, part: str, bounds: list[tuple[str, str]]) -> list[str]:
        """The files of a segment that may hold a term within one of the bounds, both inclusive."""
        # files are in term order: from the first whose last term is not below to the last whose first is not above
        own = segment[part]
        first, last = [x[0] for x in own], [x[1] for x in own]
        chosen = sorted({k for low, high in bounds for k in range(bisect_left(last, low), bisect_right(first, high))})
        return [f"{self.path}/{segment['name']}/{part}/{own[k][2]}" for k in chosen]

    def _read(self, part: str, bounds: list[tuple[str, str]]) -> DataFrame:
        """Rows of all segments, with the segment's number as ``segment``."""
        schema = self.meta["schemas"][part]
        out = None
        for segment in self.segments:
            if files := self._files(segment, part, bounds):
                rows = self.spark.read.schema(schema).parquet(*files).withColumn("segment", F.lit(segment["number"]))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{schema}, segment int") if out is None else out

    def _whole(self, part: str, segments: list[dict] | None = None) -> DataFrame:
        schema, out = self.meta["schemas"][part], None
        for segment in self.segments if segments is None else segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{segment['name']}/{part}").withColumn("segment", F.lit(segment["number"]))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{schema}, segment int") if out is None else out

    def dead(self) -> DataFrame | None:
        """``key, since``: keys that are dead in segments before ``since``; None where nothing was ever replaced or deleted."""
        own = [s for s in self.segments if s["dead"]]
        if not own:
            return None
        rows = self.spark.read.schema(f"key {self._key_type}, since int").parquet(*(f"{self.path}/{s['name']}/dead" for s in own))
        return rows.groupBy("key").agg(F.max("since").alias("since"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows ``(key, segment, ..)`` without those of replaced or deleted documents."""
        dead = self.dead()
        if dead is None:
            return rows.drop("segment")
        d = dead.withColumnRenamed("key", "_key")
        return rows.join(d, (F.col("key") == F.col("_key")) & (F.col("segment") < F.col("since")), "left_anti").drop("segment")

    def postings(self, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
        """The live rows of some terms, and of all terms that begin with one of the prefixes."""
        rows = self._read("postings", [(x, x) for x in terms] + [(x, x + "\U0010ffff") for x in prefixes])
        wanted = F.col("term").isin(list(terms))
        for prefix in prefixes:
            wanted = wanted | F.col("term").startswith(prefix)
        return self.live(rows.filter(wanted))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """``corpus, term, df`` of some terms: from the small tables of frequencies, or where documents have died, from the
        live postings of these terms."""
        if not any(s["dead"] for s in self.segments):
            rows = self._read("terms", [(x, x) for x in terms]).filter(F.col("term").isin(list(terms)))
            return rows.groupBy("corpus", "term").agg(F.sum("df").alias("df"))
        return self.postings(terms).groupBy("corpus", "term").agg(F.count("*").alias("df"))

    def statistics(self) -> tuple[int, float]:
        """Documents and mean length of an index of one corpus."""
        if self._statistics is None:
            row = self.corpora().first()
            self._statistics = (row["n"], row["mean"]) if row else (0, 1.0)
        return self._statistics

    def corpora(self) -> DataFrame:
        rows = self.spark.read.schema("corpus string, n long, total long").parquet(f"{self.path}/{self.meta['corpora']}")
        return rows.select("corpus", "n", (F.col("total") / F.col("n")).alias("mean"))

    def docs(self) -> DataFrame:
        """``key, corpus, n_tokens`` of the live documents."""
        return self.live(self._whole("docs"))

    def add(self, documents: DataFrame, words: Column | None = None) -> Index:
        """A new version with ``documents``, in place of older ones of the same keys. Writes a segment of these documents."""
        number = self.segments[-1]["number"] + 1 if self.segments else 1
        segment = _segment(documents, self.path, number, words, self.key, self.corpus, self.positions, mark=bool(self.segments))
        return self._with(segment)

    def delete(self, keys: DataFrame) -> Index:
        """A new version without the documents that ``keys`` has in the column of the index's key."""
        number = self.segments[-1]["number"] + 1 if self.segments else 1
        name = f"segment-{number}-{uuid.uuid4().hex}"
        gone = keys.select(F.col(self.key).cast(self._key_type).alias("key")).filter("key IS NOT NULL").distinct()
        gone.withColumn("since", F.lit(number)).write.parquet(f"{self.path}/{name}/dead")
        for part in ("postings", "terms", "docs"):
            self.spark.createDataFrame([], self.meta["schemas"][part]).write.parquet(f"{self.path}/{name}/{part}")
        return self._with({"number": number, "name": name, "docs": 0, "dead": True, "postings": [], "terms": []})

    def _with(self, segment: dict) -> Index:
        """Publishes a version with one more segment, merged where a tier is full."""
        segments = [*self.segments, segment]
        while (tier := full_tier(segments)) is not None:
            merged = Index(self.spark, self.path, self.meta | {"segments": segments})._merge(tier)
            segments = sorted([s for s in segments if s not in tier] + [merged], key=lambda s: s["number"])
        return publish(Index(self.spark, self.path, self.meta | {"segments": segments}))

    def _merge(self, chosen: list[dict]) -> dict:
        """One segment with the live rows of some. Its number is the highest of theirs: what is dead in an older one of them
        is gone, and what lives was not named by any segment since."""
        number, name = max(s["number"] for s in chosen), f"segment-{chosen[-1]['number']}-{uuid.uuid4().hex}"
        older = [s for s in self.segments if s not in chosen and s["number"] < number]
        marks = [s for s in chosen if s["dead"]]
        if older and marks:  # older segments outside the merge may still hold these keys
            rows = self.spark.read.schema(f"key {self._key_type}, since int").parquet(*(f"{self.path}/{s['name']}/dead" for s in marks))
            rows.groupBy("key").agg(F.max("since").alias("since")).write.parquet(f"{self.path}/{name}/dead")
        docs = self.live(self._whole("docs", chosen))
        docs.write.parquet(f"{self.path}/{name}/docs")
        files = _write_postings(self.live(self._whole("postings", chosen)), f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}/docs").count()
        return {"number": number, "name": name, "docs": n, "dead": bool(older and marks)} | files


def full_tier(segments: list[dict]) -> list[dict] | None:
    """``FAN`` or more segments whose documents, counted in powers of ``FAN``, are of one size; deletes are of the least."""
    tiers: dict[int, list[dict]] = {}
    for s in segments:
        tier, n = 0, s["docs"]
        while n >= FAN:
            tier, n = tier + 1, n // FAN
        tiers.setdefault(tier, []).append(s)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), None)


def newest(spark: SparkSession, path: str) -> dict:
    """The newest version's list of segments. A version is one file of one row, so there are as many rows as versions."""
    rows = spark.read.schema("value string, v int").text(f"{path}/versions")
    return json.loads(rows.orderBy(F.desc("v")).first()["value"])


def publish(made: Index) -> Index:
    """Counts what lives, then names the new version."""
    meta = made.meta | {"version": made.meta["version"] + 1}
    meta["corpora"] = f"corpora-{meta['version']}-{uuid.uuid4().hex}"
    made.docs().groupBy("corpus").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total")).coalesce(1).write.parquet(f"{made.path}/{meta['corpora']}")
    line = made.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
    line.write.mode("error").text(f"{made.path}/versions/v={meta['version']}")
    return Index(made.spark, made.path, meta)


def build(documents: DataFrame, path: str, words: Column | None = None, key: str = "doc_id", corpus: str | None = None, positions: bool = False) -> Index:
    """Writes the index of ``documents(key, text)`` as a new version at ``path``; with ``corpus``, statistics are kept for
    each. A version that is there already is replaced, and stays readable until the new one is published."""
    spark, path = documents.sparkSession, path.rstrip("/")
    try:
        version = newest(spark, path)["version"]
    except Exception as error:  # noqa: BLE001  a path that does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        version = 0
    segment = _segment(documents, path, 1, words, key, corpus, positions)
    by = documents.schema[key].dataType.simpleString()
    at = ", positions array<int>" if positions else ""
    schemas = {
        "postings": f"key {by}, corpus string, n_tokens int, term string, tf int{at}", "terms": "term string, corpus string, df long", "docs": f"key {by}, corpus string, n_tokens int",
    }
    meta = {"key": key, "corpus": corpus, "positions": positions, "version": version, "schemas": schemas, "segments": [segment]}
    return publish(Index(spark, path, meta))


def counted(words: Column, positions: bool) -> Column:
    """An array of one struct: ``n_tokens`` of a document's words and its ``postings``, the terms in order with their
    counts. A document's postings are made in its own row, from its sorted words, so nothing is grouped or shuffled."""

    def runs(s: Column) -> Column:
        term = lambda i: F.get(s, i)["term"] if positions else F.get(s, i)
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))

        def posting(b: Column, i: Column, k: Column) -> Column:
            tf = F.coalesce(F.get(b, k + 1), F.size(s)) - i
            at = [F.transform(F.slice(s, i + 1, tf), lambda x: x["at"]).alias("positions")] if positions else []
            return F.struct(term(i).alias("term"), tf.alias("tf"), *at)

        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: posting(b, i, k)))[0]

    def of(w: Column) -> Column:
        placed = F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("at"))) if positions else w
        made = F.transform(F.array(F.sort_array(placed)), runs)[0]
        return F.struct(F.greatest(F.size(w), F.lit(0)).alias("n_tokens"), F.when(F.size(w) > 0, made).alias("postings"))

    # words, sorted words and where their runs begin are each bound once, as an expression used twice is computed twice
    return F.transform(F.array(words), of)


def _segment(documents: DataFrame, path: str, number: int, words: Column | None, key: str, corpus: str | None, positions: bool, mark: bool = False) -> dict:
    """Writes a segment of ``documents``; with ``mark``, its keys are dead in older ones."""
    spark, name = documents.sparkSession, f"segment-{number}-{uuid.uuid4().hex}"
    own = F.col(corpus).cast("string") if corpus else F.lit(ONE)
    plain = documents.withColumns({"_key": F.col(key), "_corpus": own})
    bad = plain.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1 OR _key IS NULL").limit(3).collect()  # reads the keys alone
    if bad:
        raise RepeatedKeysError(f"keys that are null or stand in several rows, such as {', '.join(str(r['_key']) for r in bad)}")
    dealt = spread(plain).select(F.col("_key").alias("key"), F.col("_corpus").alias("corpus"), F.inline_outer(counted(tokens("text") if words is None else words, positions)))
    # a row a document, written before its postings are sorted, since a range sort looks at its rows twice
    every = materialise(dealt, "postings")
    every.select("key", "corpus", "n_tokens").write.parquet(f"{path}/{name}/docs")
    if mark:
        spark.read.parquet(f"{path}/{name}/docs").select("key", F.lit(number).alias("since")).write.parquet(f"{path}/{name}/dead")
    files = _write_postings(every.select("key", "corpus", "n_tokens", F.inline("postings")), f"{path}/{name}")
    discard(every)
    return {"number": number, "name": name, "docs": spark.read.parquet(f"{path}/{name}/docs").count(), "dead": mark} | files


def _write_postings(rows: DataFrame, folder: str) -> dict[str, list[list[str]]]:
    """Writes sorted postings and their frequencies; returns the first and last term of each file of either."""
    spark = rows.sparkSession
    columns = [c for c in ("key", "corpus", "n_tokens", "term", "tf", "positions") if c in rows.columns]
    tasks = width(rows)  # so that a task sorts no more when there are more documents
    order = [*([tasks] if tasks else []), "term", "corpus", "key"]
    rows.select(columns).repartitionByRange(*order).sortWithinPartitions("term", "corpus", "key").write.parquet(f"{folder}/postings")
    spark.read.schema(rows.select(columns).schema).parquet(f"{folder}/postings").groupBy("term", "corpus").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    out = {}
    for part in ("postings", "terms"):
        found = spark.read.schema("term string").parquet(f"{folder}/{part}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("term").alias("a"), F.max("term").alias("z"))
        out[part] = sorted([r["a"], r["z"], r["f"]] for r in found.collect())  # a row a file
    return out


def _types(schema: str) -> dict[str, str]:
    return dict(f.split(" ", 1) for f in schema.split(", "))
