"""Operator 11, mixing: sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are aggregated by their set of sources, the *pattern*; a pattern
offers its words once for nothing, a second time at cost 1, a third time at cost 4 and so on (convex), and each source
asks for a quota. The min-cost flow of greatest volume through patterns and sources says how many words of a pattern go
to which source. It is solved on the driver, whose work depends on the patterns and not on the documents; more than
``MOST_PATTERNS`` patterns are an error, as a mix is planned for sources that somebody named.

Within a pattern documents stand in a seeded order, and the words of the flow are taken from its front: all documents
as often as the flow covers the whole pattern, the first documents once more, and the document at the end in part, so
that a source gets its words to the last one. Places come from one range sort of narrow rows by (pattern, seeded order),
which splits even a single hot source; texts are read once and never shuffled.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its own; a null
or empty list of sources belongs to none and nothing is taken; a name that stands twice in a list counts once; repeated
rows are documents of their own; ties in the seeded order stand in order of id; texts are counted whole; an empty table
mixes to no rows; other columns, whatever their names, are ignored. A quota that the documents cannot fill is filled as
far as they go; which of two sources that compete for the same words then gets them is not weighed.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import LongType

from .bytehash import blocks
from .common import materialise, shuffle_width, text_of

MOST_PATTERNS = 100_000
Pattern = tuple[str | None, ...]


def water_filled(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``share`` of all sizes, none above ``most`` times its size: what
    is cut off one is shared anew among the others."""
    budget, weight = share * sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    rest = sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i]))
    for n, i in enumerate(rest):
        if budget * weights[i] <= most * sizes[i] * weight:
            for j in rest[n:]:
                out[j] = float(budget * weights[j] / weight)
            return out
        out[i] = float(most * sizes[i])
        budget, weight = budget - most * sizes[i], weight - weights[i]
    return out


class Network:
    """Min-cost maximum flow by potentials: shortest paths, then a blocking flow over all of them at once."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Adds an arc and its reverse; the reverse's room is the flow."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        price = [0] * len(self.out)
        while self._reprice(price, source, sink):
            while levels := self._levels(price, source, sink):
                self._block(price, levels, source, sink)

    def _reduced(self, price: list[int], e: int) -> int:
        return self.cost[e] + price[self.to[e ^ 1]] - price[self.to[e]]

    def _reprice(self, price: list[int], source: int, sink: int) -> bool:
        far: dict[int, int] = {}
        open_ = [(0, source)]
        while open_:
            d, v = heapq.heappop(open_)
            if v in far:
                continue
            far[v] = d
            for e in self.out[v]:
                if self.room[e] and self.to[e] not in far:
                    heapq.heappush(open_, (d + self._reduced(price, e), self.to[e]))
        if sink not in far:
            return False
        for v in range(len(price)):
            price[v] += min(far.get(v, far[sink]), far[sink])
        return True

    def _levels(self, price: list[int], source: int, sink: int) -> dict[int, int]:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for e in self.out[v]:
                if self.room[e] and self.to[e] not in level and not self._reduced(price, e):
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level if sink in level else {}

    def _block(self, price: list[int], level: dict[int, int], source: int, sink: int) -> None:
        turn, path, v = [0] * len(self.out), [], source
        while True:
            if v == sink:
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if not self.room[e])
                v = self.to[path[first] ^ 1]
                del path[first:]
            while turn[v] < len(self.out[v]):
                e = self.out[v][turn[v]]
                if self.room[e] and level.get(self.to[e], -1) == level[v] + 1 and not self._reduced(price, e):
                    break
                turn[v] += 1
            else:
                if not path:
                    return
                v = self.to[path.pop() ^ 1]
                turn[v] += 1
                continue
            path.append(e)
            v = self.to[e]


def routed(patterns: list[tuple[Pattern, int]], quotas: dict[str | None, int], repeats: int, cost: Callable[[int], int]) -> list[dict[str | None, int]]:
    """For each pattern, the words that it gives to each of its sources; the k-th repeat of a word costs ``cost(k)``."""
    names = sorted(quotas, key=lambda s: (s is None, s))
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = Network(2 + len(patterns) + len(names))
    for s in names:
        net.arc(at[s], 1, quotas[s], 0)
    ways: list[dict[str | None, int]] = []
    for i, (own, size) in enumerate(patterns):
        for k in range(repeats):
            net.arc(0, 2 + i, size, cost(k))
        ways.append({s: net.arc(2 + i, at[s], repeats * size, 0) for s in own if s in at})
    net.solve(0, 1)
    return [{s: net.room[e ^ 1] for s, e in own.items() if net.room[e ^ 1]} for own in ways]


@F.arrow_udf(LongType())
def words_of(text: pa.Array) -> pa.Array:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in each text, from its bytes."""
    out = []
    for _, _, data, starts in blocks(pa.record_batch([text], names=["text"]), "text"):
        word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = starts[:-1][starts[:-1] < starts[1:]]
        first[heads] = word[heads]  # a text's first word begins it, whatever the text before ended in
        out.append(np.diff(np.concatenate(([0], np.cumsum(first)))[starts]))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def seeded(seed: int) -> Column:
    """A place in the seeded order: 60 bits of a digest of seed, id and text."""
    own = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, members: Column, quotas: Callable[[dict[str | None, int]], dict[str | None, float]], repeats: int = 2, cost: Callable[[int], int] = lambda k: k * k, seed: int = 7) -> DataFrame:
    """Mixes ``docs(doc_id, text)``, whose sources are the array of strings ``members``. ``quotas`` gets the size of each
    source and returns the words wanted of it.

    Returns ``doc_id, size, members, copies, rest, taken, takes``: the text is taken ``copies`` times whole and once more
    up to its word ``rest``; ``takes`` has an entry (source, source_size, target, taken) for each of its sources."""
    spark = docs.sparkSession
    own = F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>")))
    sized = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(own).alias("members"), words_of(text_of().cast("string")).alias("size"), seeded(seed).alias("turn")), "sizes"
    )
    found = sized.groupBy("members").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    patterns = sorted(((tuple(r["members"]), r["size"]) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict[str | None, int] = {}
    for names, size in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + size
    targets = quotas(sizes)
    flows = routed(patterns, {s: int(t) for s, t in targets.items()}, repeats, cost)

    plan, first = [], 0  # pattern, its sources and the run of words that each of them gets
    for k, ((names, size), flow) in enumerate(zip(patterns, flows)):
        runs, first = [], 0
        for s in names:
            runs.append((s, sizes[s], float(targets.get(s, 0)), first, first + flow.get(s, 0)))
            first += flow.get(s, 0)
        plan.append((k, list(names), size, first, runs))
    runs = "array<struct<source string, source_size long, target double, a long, b long>>"
    plan = spark.createDataFrame(plan, f"pattern int, members array<string>, words long, flow long, runs {runs}").alias("p")
    keyed = sized.alias("d").join(F.broadcast(plan), F.col("d.members").eqNullSafe(F.col("p.members"))).select("d.doc_id", "size", "turn", "pattern")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = 0, -1  # words of pattern ``last`` so far in this partition
        for batch in batches:
            if not batch.num_rows:
                continue
            pattern, size = batch.column("pattern").to_numpy(), batch.column("size").to_numpy()
            total = np.cumsum(size)
            heads = np.flatnonzero(np.diff(pattern, prepend=pattern[0] - 1))
            since = np.repeat(total[heads] - size[heads], np.diff(heads, append=len(pattern)))
            before = total - size - since
            if pattern[0] == last:
                before[: heads[1] if len(heads) > 1 else len(before)] += at
            at, last = int(before[-1] + size[-1]), pattern[-1]
            yield pa.record_batch([batch.column("doc_id"), batch.column("size"), batch.column("pattern"), pa.array(before)], names=["doc_id", "size", "pattern", "before"])

    ordered = materialise(
        keyed.repartitionByRange(shuffle_width(sized), "pattern", "turn", "doc_id").sortWithinPartitions("pattern", "turn", "doc_id")
        .mapInArrow(placed, "doc_id long, size long, pattern int, before long").withColumn("part", F.spark_partition_id()),
        "sizes-in-order",
    )
    sums = ordered.groupBy("part", "pattern").agg(F.sum("size").alias("n")).collect()  # a row a partition, and one more a pattern
    bases, at = [], {}
    for r in sorted(sums, key=lambda r: (r["pattern"], r["part"])):
        bases.append((r["part"], r["pattern"], at.get(r["pattern"], 0)))
        at[r["pattern"]] = at.get(r["pattern"], 0) + r["n"]
    bases = spark.createDataFrame(bases, "part int, pattern int, base long")
    rows = ordered.join(F.broadcast(bases), ["part", "pattern"]).join(F.broadcast(plan), "pattern")

    def up_to(t: Column) -> Column:
        """This document's words among the first ``t`` of the pattern, said over and over."""
        inside = F.greatest(F.lit(0), F.least(t % F.col("words") - F.col("base") - F.col("before"), F.col("size")))
        return F.when(F.col("words") == 0, F.lit(0)).otherwise(F.floor(t / F.col("words")) * F.col("size") + inside).cast("long")

    takes = F.transform("runs", lambda r: F.struct(r["source"].alias("source"), r["source_size"].alias("source_size"), r["target"].alias("target"), (up_to(r["b"]) - up_to(r["a"])).alias("taken")))
    taken, size = F.col("taken"), F.greatest("size", F.lit(1))
    return rows.withColumn("taken", up_to(F.col("flow"))).select("doc_id", "size", "members", F.floor(taken / size).alias("copies"), (taken % size).alias("rest"), "taken", takes.alias("takes"))


def by_weight(weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> Callable[[dict[str | None, int]], dict[str | None, float]]:
    """Quotas of ``share`` of all words, by ``weights`` that repeat over the sources in order of code points, null last."""

    def quotas(sizes: dict[str | None, int]) -> dict[str | None, float]:
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        own = [weights[i % len(weights)] for i in range(len(names))]
        return dict(zip(names, water_filled([sizes[s] for s in names], own, share, most)))

    return quotas
