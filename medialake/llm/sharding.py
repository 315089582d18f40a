"""Operator 1, sharding by extendible hashing (DataFrame functions only).

A document's hash is 60 bits: 32 of its id and 28 of its id and text, so rows that share an id can still be
told apart. The directory maps hash prefixes to shards. It starts with one bucket; a bucket over the byte
limit is split on its next bit, others stay, until every bucket fits.

Splitting needs only the bytes below each prefix. A histogram by the first ``bits`` bits, summed up over all
shorter prefixes, gives every bucket of every depth at once, so there is one scan of the documents and no
round for each bit; documents of buckets too large even at that depth go on with 12 more bits. The
histogram has a few rows for each shard, and it stays a DataFrame.

Defined cases: a null or empty text has 0 bytes; a null id hashes as the empty string; a document over the
limit, and equal rows together over it, cannot be split: their bucket ends when it has one hash value, with
``fits`` false; a text of any length counts by its bytes; an empty table gives no rows; other columns are ignored
by ``shard`` and kept by ``write_shards``, whose folders are named by ``shard`` or, if that is taken, ``_shard``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import discard, materialise

BITS = 60


def document_hash(key: str = "doc_id", text: str = "text") -> Column:
    own = f"coalesce(cast({key} as string), '')"
    deep = f"md5(concat({own}, '/', md5(coalesce({text}, ''))))"
    return F.expr(f"cast(conv(concat(substr(md5({own}), 1, 8), substr({deep}, 1, 7)), 16, 10) as bigint)")


def sized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key), document_hash(key).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def buckets(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """``fine, depth, shard_docs, shard_bytes, done``: for each prefix of ``high`` bits the shallowest bucket from
    depth ``low`` on that fits or has a single hash value; ``done`` is false where there is none."""
    fine = rows.groupBy(F.shiftright("hash", BITS - high).alias("fine")).agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("least"), F.max("hash").alias("most")
    )
    levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
    by_prefix = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("least").alias("least"), F.max("most").alias("most"))
    fits = by_prefix.filter((F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most"))).select("depth", "prefix", "shard_bytes", "shard_docs")
    found = levels.select("fine", "depth", "prefix").join(fits, ["depth", "prefix"])
    leaf = found.groupBy("fine").agg(F.min(F.struct("depth", "shard_docs", "shard_bytes")).alias("leaf"))
    return leaf.select("fine", "leaf.*")


def levels(docs: DataFrame, limit: int, key: str, slack_bits: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """For each round its number of bits, its rows and its leaves, the shards by ``fine``, the first bits of a hash. A
    row has its shard in the first round whose leaves know its ``fine``."""
    rows = materialise(sized(docs, key), "sized")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    low, high = 0, min(BITS, max(1, (max(1, total) // limit).bit_length() + slack_bits))
    while True:
        name = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(fine, {high} - depth)), depth, '0') END")
        leaves = materialise(buckets(rows, limit, low, high).withColumn("shard", name), "leaves")
        yield high, rows, leaves
        if high == BITS:
            return
        rest = materialise(rows.join(leaves, F.shiftright("hash", BITS - high) == F.col("fine"), "left_anti"), "sized")
        if rest.isEmpty():
            discard(rest)
            return
        rows, low, high = rest, high + 1, min(BITS, high + 12)


def shard(docs: DataFrame, limit: int, key: str = "doc_id", slack_bits: int = 4) -> DataFrame:
    """``key, n_bytes, shard, depth, shard_docs, shard_bytes, fits``; ``shard`` is the prefix as a bit string."""
    placed: DataFrame | None = None
    for high, rows, leaves in levels(docs, limit, key, slack_bits):
        here = rows.join(leaves, F.shiftright("hash", BITS - high) == F.col("fine"))
        placed = here if placed is None else placed.unionByName(here)
    return placed.select(key, "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def directory(shards: DataFrame) -> DataFrame:
    """The directory: an entry for each shard with the range of hash values that its prefix covers."""
    first = F.expr(f"shiftleft(cast(coalesce(conv(nullif(shard, ''), 2, 10), '0') as bigint), {BITS} - depth)")
    own = shards.groupBy("shard", "depth", "shard_docs", "shard_bytes").agg(F.count("*").alias("n")).drop("n")
    return own.select("*", first.alias("first_hash"), (first + F.expr(f"shiftleft(1L, {BITS} - depth) - 1")).alias("last_hash"))


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", slack_bits: int = 4) -> None:
    """Writes ``docs`` to a folder for each shard.

    A row finds its shard by the first bits of its hash in the leaves of each round, of which there is one unless
    some bucket is deeper than the histogram; leaves have a few rows a shard, and rows are never multiplied."""
    out, at = docs.select(F.struct("*").alias("row"), document_hash(key).alias("hash")), F.lit(None).cast("string")
    for high, _, leaves in levels(docs, limit, key, slack_bits):
        own = leaves.select(F.col("fine").alias(f"fine{high}"), F.col("shard").alias(f"shard{high}"))
        out = out.join(own, F.shiftright("hash", BITS - high) == own[f"fine{high}"], "left")
        at = F.coalesce(at, F.col(f"shard{high}"))
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    out.select("row.*", at.alias(name)).repartition(name).write.partitionBy(name).parquet(path)
