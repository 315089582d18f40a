"""Operator 9, near-duplicate classes by BagMinHash.

A document is the multiset of its five-word shingles, and two documents are linked when the weighted Jaccard
similarity of these, sum of the smaller counts over sum of the larger, is at least 0.8.

Signatures: a weight is cut into levels (0, 1], (1, 2], (2, 4], (4, 8] and so on. Each level of each shingle has a
Poisson process whose points, drawn from the shingle's hash in order of time, fall on a register and a
weight; a point counts if its weight is within the shingle's count. A register keeps its earliest time. All
processes run up to a horizon at which a document's registers are expected to be full, so the work for a
document is its length plus about m log m points; the few documents with an empty register go on to twice the
horizon. Two documents agree on a register with the probability of their weighted Jaccard similarity.

Search: documents with equal bags are one node. Bands of registers put nodes into buckets. In each bucket
the nodes are first compared with a pivot, and only across components that are still apart; a bucket is
finished when the rest of it is in one component, so a bucket of copies costs about one comparison a node.
What is still mixed goes to the next pivot, ``PIVOT_ROUNDS`` times and more while that pays. Its nodes are then grouped
anew by a prefix filter: shingles in order of rarity, two sets that are similar share one of the first few of either, and
how many these are follows from the sizes in their buckets. So a family of texts that are alike below the threshold falls
apart, whatever buckets it shares. The groups have pivots again, and what is left of them is compared in blocks within
tasks. A task joins components as it finds similar pairs and returns a spanning forest,
fewer pairs than nodes. So no pair that shares a bucket and could still join two components goes untested. A
two-bit sketch of the registers rules out pairs five standard deviations below the threshold (3e-7 of those at
it); all other comparisons count shingles.
With 36 bands of 6 registers a pair at 0.8 shares no bucket with probability 2e-5.

Nothing here has a size bound, so no join of documents, places or shingles is told to broadcast. Those of texts and
shingles are merge joins at every size; elsewhere the planner may broadcast a side whose files it knows to be small.

Defined cases: a document of one to four words has one shingle of them all; one without words (null, empty)
is a class of its own; equal texts and repeated rows are one class; ties between representatives go to the
least id and then to the fingerprint of the text; a null id is never a class id unless its class has no
other; a text of any length is signed and compared whole; an empty table gives no rows;
``drop_near_duplicates`` keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .bytehash import MULT_A, MULT_B, SHIFT, U64, blocks, mix
from .common import discard, materialise
from .wordhash import ALNUM, roll, word_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
BLOCK = 1 << 20
#: Points that are drawn at once.
POINTS = 1 << 17
#: Pivots of each mixed bucket; further ones, up to so many in all, follow only while buckets exceed a block and the
#: last one finished a quarter of the mixed rows.
PIVOT_ROUNDS = 2
MOST_ROUNDS = 6
#: A block of a bucket has at most some this many shingles and rows (a single text may have more shingles).
BLOCK_SHINGLES = 1 << 17
BLOCK_ROWS = 512
#: Expected points a register when a document's processes stop; e ** -3 of the documents go on.
HORIZON = float(np.log(REGISTERS) + 3.0)


def shingle_bags(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block: owner, hash and count, sorted by owner and hash."""
    _, _, words, first = word_table(data, starts, ALNUM)
    number = np.diff(first)
    owner = np.repeat(np.arange(len(number)), number)
    rolled = roll(words, SHINGLE)
    inside = owner[: len(rolled)] == owner[SHINGLE - 1 :] if len(rolled) else np.zeros(0, bool)
    hashes, owners = rolled[inside], owner[: len(rolled)][inside]
    short = np.flatnonzero((number > 0) & (number < SHINGLE))
    if len(short):
        whole = [roll(words[first[r] : first[r + 1]], int(number[r]))[0] for r in short]
        hashes = np.concatenate([hashes, np.array(whole, U64) ^ number[short].astype(U64)])
        owners = np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return owners[new], hashes[new], np.diff(np.concatenate([new, [len(hashes)]]))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * MULT_A
    h = (h ^ (h >> SHIFT)) * MULT_B
    return h ^ (h >> U64(32))


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers of each document of a block, as the bits of the earliest times (documents x registers)."""
    best = np.full(n_docs * REGISTERS, np.inf)
    weight = np.bincount(owner, counts, n_docs)
    # the levels of every shingle: one for a count of 1, and for each doubling another
    top = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(hashes)), top + 1)
    level = np.arange(len(element)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    source = scramble(hashes[element] + level.astype(U64) * MULT_B)
    document, most = owner[element], counts[element].astype(float)
    pending, factor = np.flatnonzero(weight > 0), 1.0
    while len(pending):
        horizon = np.zeros(n_docs)
        horizon[pending] = factor * REGISTERS * HORIZON / weight[pending]
        chosen = np.flatnonzero(horizon[document] > 0)
        expected = horizon[document[chosen]] * rate[chosen]
        for few in (True, False):
            active = chosen[(expected <= 32) == few]
            if not len(active):
                continue
            mean = float((horizon[document[active]] * rate[active]).max())
            steps = 1 if few else min(512, int(mean + 4 * mean**0.5 + 4))
            time, done = np.zeros(len(active)), 0
            while len(active):
                per = max(1, POINTS // steps)
                ahead_active, ahead_time = [], []
                for k in range(0, len(active), per):  # bounded memory
                    own = active[k : k + per]
                    drawn = scramble(source[own][:, None] + (np.arange(done + 1, done + steps + 1, dtype=U64) * MULT_A)[None, :])
                    wait = -np.log(((drawn >> U64(11)) + 0.5) * 2.0**-53) / rate[own][:, None]
                    # the sum starts from the time so far, so it rounds the same however it is cut into steps
                    at = np.cumsum(np.concatenate([time[k : k + per][:, None], wait], 1), 1)[:, 1:]
                    within = at <= horizon[document[own]][:, None]
                    r, c = np.nonzero(within)
                    point = scramble(drawn[r, c] ^ MULT_B)
                    place = low[own[r]] + rate[own[r]] * ((point & U64(0xFFFFFFFF)).astype(float) * 2.0**-32)
                    counted = place <= most[own[r]]
                    register = ((point >> U64(32)) % U64(REGISTERS)).astype(np.int64)
                    np.minimum.at(best, (document[own[r]] * REGISTERS + register)[counted], at[r, c][counted])
                    on = within[:, -1]
                    ahead_active.append(own[on])
                    ahead_time.append(at[on, -1])
                active, time, done = np.concatenate(ahead_active), np.concatenate(ahead_time), done + steps
        empty = np.isinf(best.reshape(n_docs, REGISTERS)[pending]).any(1)
        # a register is final once the horizon passed it; documents with an empty one start over, further
        pending, factor = pending[empty], factor * 2
        best.reshape(n_docs, REGISTERS)[pending] = np.inf
    return best.reshape(n_docs, REGISTERS).view(U64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * MULT_A, parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h, parts[:, :, k])
    return h


#: Two bits a register, 32 registers a word.
SKETCH_WORDS = -(-REGISTERS // 32)
#: A pair at the threshold differs in 15 % of its registers' bit pairs; beyond that by five standard deviations it
#: is not compared further, which a linked pair meets with probability 3e-7.
SKETCH_SIGMAS = 5.0


def sketches(registers: np.ndarray) -> np.ndarray:
    """Two hashed bits of each register, packed; unequal registers differ in them three times out of four."""
    bits = (scramble(registers) & U64(3)).astype(U64)
    out = np.zeros((len(bits), SKETCH_WORDS), U64)
    for k in range(REGISTERS):
        out[:, k // 32] |= bits[:, k] << U64(2 * (k % 32))
    return out


def sketch_distance(a: str, b: str) -> str:
    """SQL for the number of registers whose bits differ."""
    parts = []
    for k in range(SKETCH_WORDS):
        x = f"({a}.w{k} ^ {b}.w{k})"
        parts.append(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x5555555555555555}L)")
    return " + ".join(parts)


def sketch_limit(similarity: float) -> int:
    p = 0.75 * (1 - similarity)
    return int(np.ceil(REGISTERS * p + SKETCH_SIGMAS * (REGISTERS * p * (1 - p)) ** 0.5))


SKETCH = "struct<" + ",".join(f"w{k}:long" for k in range(SKETCH_WORDS)) + ">"


def keyed(docs: DataFrame) -> DataFrame:
    key = [F.xxhash64("doc_id", "text").alias("key"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("check")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.col("text").cast("string").alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, key, check, bag, size, bands`` of each document; ``bag`` is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text", BLOCK):
                n = j - i
                owner, hashes, counts = shingle_bags(data, starts)
                size = np.bincount(owner, counts, n).astype(np.int64)
                bag = np.zeros(n, U64)
                np.add.at(bag, owner, mix(scramble(hashes), counts.astype(U64)))
                bag = mix(scramble(bag), size.astype(U64))
                registers = signatures(owner, hashes, counts, n)
                keys, bits = band_keys(registers), sketches(registers).view(np.int64)
                sketch = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH_WORDS)], [f"w{k}" for k in range(SKETCH_WORDS)])
                has = size > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.record_batch([*(batch.column(k).slice(i, n) for k in range(3)), pa.array(bag.view(np.int64), mask=~has), pa.array(size), bands, sketch], names=["doc_id", "key", "check", "bag", "size", "bands", "sketch"])

    return keyed(docs).mapInArrow(sign, f"doc_id long, key long, check long, bag long, size long, bands array<long>, sketch {SKETCH}")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted documents: a shingle's k-th occurrence is an element of its own, so the
    Jaccard similarity of these sets is that of the multisets. Elements keep all 64 bits: with 32, texts of a hundred
    thousand words have shingles that fall together.

    Rows that are repeated with their id give a node several times."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text", BLOCK):
                owner, hashes, counts = shingle_bags(data, starts)
                which = np.repeat(np.arange(len(hashes)), counts)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                elements = mix(hashes[which], turn.astype(U64))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, counts, j - i))]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))], names=["node", "shingles"])

    return keyed(docs).join(wanted.hint("merge"), ["key", "check"]).select("node", "text").mapInArrow(spell, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges(a, b)``: the least node that each can reach.

    Labels travel along edges and then jump to their label's label, so long chains shorten by half each round."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("other"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "other").alias("component"), F.col("component").alias("old"))
        moved = materialise(moved, "labels")
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = materialise(moved.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "old"), "labels")
        discard(labels, moved)
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            discard(both)
            return new
        labels = new


def link_components(docs: DataFrame, described: DataFrame, similarity: float) -> DataFrame | None:
    """``node, component`` for the nodes that are linked to another; None if there are none."""
    nodes = materialise(
        described.filter("bag IS NOT NULL").groupBy(F.col("bag").alias("node")).agg(F.min(F.struct("key", "check")).alias("at"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes"
    )
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    placed = materialise(rows.join(shared.hint("merge"), "bucket"), "placed")
    degree = placed.groupBy("node").agg(F.sum("n").alias("degree"))
    known = degree.join(nodes.select("node", "size", "sketch"), "node")
    members = materialise(placed.select("bucket", "node").join(known, "node").select("bucket", "node", "degree", "size", "sketch", F.col("node").alias("component")), "bucket-members")
    if members.isEmpty():
        return None
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "at.key", "at.check")
    sets = shingle_sets(docs, materialise(wanted, "wanted"))
    if not described.groupBy("key", "check").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])  # only where whole rows are repeated: it shuffles the sets
    sets = materialise(sets, "shingles")
    linked: DataFrame | None = None
    turn, by_pivot, by_prefix, rows_before = 0, True, False, members.count()
    while True:
        used = []
        if by_pivot:
            heads = materialise(pivots(members), "pivots")
            pairs = pivot_pairs(members, heads, similarity)
            with_b = materialise(pairs.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b"), "pairs-b")
            links = materialise(compared(with_b, sets, similarity), "links")
            used += [heads, pairs, with_b, links]
        else:
            links = materialise(compare_in_blocks(members, sets, similarity), "links")
            used += [links]
        renamed = None
        if not links.isEmpty():
            found = members.select("node", "component").distinct()
            known = links.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
            merged = components(known.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
            renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
            new = merged.withColumnRenamed("component", "into")
            before = linked
            if linked is None:
                linked = new.select("node", F.col("into").alias("component"))
            else:
                again = linked.join(renamed, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
                linked = again.unionByName(new.join(linked.select("node"), "node", "left_anti").select("node", F.col("into").alias("component")))
            linked = materialise(linked, "linked")
            used += [merged] + ([before] if before is not None else [])
        if not by_pivot:
            discard(*used)
            break
        # pivots were compared with all of their bucket; a bucket goes on while what is left spans components
        left = members
        if renamed is not None:
            left = left.join(renamed, "component", "left").withColumn("component", F.coalesce("into", "component"))
        left = left.select(*members.columns).join(heads.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        left = materialise(left, "bucket-members")
        mixed = materialise(
            left.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"), F.sum("size").alias("shingles")).filter("x <> y"), "buckets"
        )
        turn += 1
        large = F.count_if((F.col("rows") > BLOCK_ROWS) | (F.col("shingles") > BLOCK_SHINGLES))
        state = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), large.alias("large")).first()
        pays = state["large"] > 0 and state["rows"] <= 0.75 * rows_before
        by_pivot, done, rows_before = turn < PIVOT_ROUNDS or (turn < MOST_ROUNDS and pays), state["rows"] == 0, state["rows"]
        old, members = members, materialise(left.join(mixed.select("bucket"), "bucket"), "bucket-members")
        discard(*used, old, left, mixed)
        if done:
            break
        if not by_pivot and not by_prefix:
            old, members = members, materialise(prefix_groups(members, sets, similarity), "prefix-groups")
            discard(old)
            turn, by_pivot, by_prefix, rows_before = 0, True, True, members.count()
            if not rows_before:
                break
    discard(members, sets, nodes)
    return linked


def prefix_groups(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes of ``members`` in new buckets, one a shingle, so that two similar nodes of one old bucket share a new one.

    With shingles in any common order, two sets whose intersection has ``c`` elements share one of the first ``n - c + 1`` of
    each; rare shingles come first. ``c`` is least with the smallest partner that a node has in its buckets, and a partner
    has ``similarity`` times its size or more. Shingles of one set alone take places in the order and make no group."""
    width = 100  # sizes are classed by hundredths of their logarithm
    reach = int(np.ceil(-np.log(similarity) * width)) + 1
    sized = members.withColumn("class", F.floor(F.ln("size") * width).cast("int"))
    least = sized.groupBy("bucket", "class").agg(F.min("size").alias("least"))
    over = least.select("bucket", F.explode(F.sequence(F.col("class"), F.col("class") + reach)).alias("class"), "least").groupBy("bucket", "class").agg(F.min("least").alias("least"))
    nodes = sized.join(over, ["bucket", "class"]).groupBy("node").agg(*(F.first(c).alias(c) for c in ("degree", "size", "sketch", "component")), F.min("least").alias("least"))
    nodes = materialise(nodes, "prefix-nodes")
    partner = F.greatest(F.col("least").cast("double"), F.col("size") * similarity)
    common = F.ceil((F.col("size") + partner) * (similarity / (1 + similarity)) - 1e-6)  # a shade less, for the rounding of doubles
    places = nodes.select("node", (F.col("size") - common + 1).cast("int").alias("places"))
    tokens = materialise(sets.join(places.hint("merge"), "node").select("node", "places", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket")), "prefix-tokens")
    often = tokens.groupBy("bucket").agg(F.count("*").alias("times")).filter("times > 1")
    shared = tokens.join(often.hint("merge"), "bucket").groupBy("node", "places", "n").agg(F.array_sort(F.collect_list(F.struct("times", "bucket"))).alias("shared"))
    kept = F.slice("shared", 1, F.greatest(F.lit(0), F.col("places") - (F.col("n") - F.size("shared"))))
    placed = materialise(shared.select("node", F.explode(kept).alias("s")).select("node", "s.bucket"), "prefix-places")
    rows = placed.join(nodes, "node")
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    return rows.join(mixed.hint("merge"), "bucket").select(members.columns)


def pivots(members: DataFrame) -> DataFrame:
    """``bucket, a, a_size, a_sketch, a_component``: the node of each bucket that shares most places with others. The
    text from which others were copied meets more of them than they meet one another."""
    best = members.groupBy("bucket").agg(F.max(F.struct("degree", "node", "size", "sketch", "component")).alias("p"))
    return best.select("bucket", F.col("p.node").alias("a"), F.col("p.size").alias("a_size"), F.col("p.sketch").alias("a_sketch"), F.col("p.component").alias("a_component"))


def pivot_pairs(members: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: each node with its buckets' pivots, where they are of different components and may be similar."""
    other = members.select("bucket", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("sketch").alias("b_sketch"), F.col("component").alias("b_component"))
    near = (F.col("a") != F.col("b")) & (F.col("a_component") != F.col("b_component")) & (F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size"))
    near = near & F.expr(f"{sketch_distance('a_sketch', 'b_sketch')} <= {sketch_limit(similarity)}")
    pairs = other.join(heads, (other["bucket"] == heads["bucket"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialise(pairs.distinct(), "pairs")


def compared(with_b: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are similar, by their shingles; those of ``b`` are there already."""
    both = with_b.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(common >= similarity * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def spanning_links(sizes: np.ndarray, sketch: np.ndarray, component: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs among the rows of one task that join all components which any similar pair of them would join:
    at most a pair a row. ``sets`` are sorted; with ``side``, only pairs across its two values are looked at."""
    left, right = [], []
    limit = sketch_limit(similarity)
    component = np.unique(component, return_inverse=True)[1]
    for i in range(len(sizes) - 1):
        rest = slice(i + 1, len(sizes))
        ok = (component[rest] != component[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]))
        if side is not None:
            ok &= side[rest] != side[i]
        at = np.flatnonzero(ok) + i + 1
        x = sketch[at] ^ sketch[i]
        at = at[np.bitwise_count((x | (x >> U64(1))) & U64(0x5555555555555555)).sum(1) <= limit]
        # a run at a time: shingles of the other side are laid out for as many rows as hold some million of them
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at]), 1 << 20)))
            own, at = at[:n], at[n:]
            first = np.cumsum(np.concatenate([[0], sizes[own][:-1]]))
            other = np.concatenate([sets[j] for j in own])
            place = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == other).astype(np.int64), first)
            similar = own[common >= similarity * (sizes[own] + sizes[i] - common)]
            for j in similar.tolist():
                if component[j] != component[i]:
                    left.append(i)
                    right.append(j)
                    component[component == component[j]] = component[i]
            at = at[component[at] != component[i]]
    return np.array(left, np.int64), np.array(right, np.int64)


def compare_in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: in each bucket that is still mixed, similar pairs that join what any pair of it would join.

    A bucket is dealt into blocks by hash, and a task compares two blocks, so it holds two blocks at most,
    however large the bucket."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        node, component, size = (rows.column(c).to_numpy() for c in ("node", "component", "size"))
        sketch = np.stack([c.to_numpy().view(U64) for c in rows.column("sketch").combine_chunks().flatten()], 1)
        values = [np.sort(x.values.to_numpy()) for x in rows.column("shingles")]
        # pairs within a block belong to another task
        side = rows.column("side").to_numpy() if key[1].as_py() != key[2].as_py() else None
        a, b = spanning_links(size, sketch, component, side, values, similarity)
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    number = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    total = members.groupBy("bucket").agg(number.alias("blocks"))
    placed = members.join(total, "bucket").withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    # block k meets every block, itself included
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", "size", "sketch"
    )
    return dealt.hint("merge").join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, key, check, class, class_id, class_size``: each row's class, and the class's least id."""
    described = materialise(describe(docs), "described")
    linked = link_components(docs, described, similarity)
    rows = described.select("doc_id", "key", "check", "bag")
    if linked is not None:
        rows = rows.join(linked.withColumnRenamed("node", "bag"), "bag", "left").withColumn("bag", F.coalesce("component", "bag")).drop("component")
    # a document without words is a class of its own
    own = F.struct(F.lit(0).alias("kind"), F.col("bag").alias("number"))
    alone = F.struct(F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("number"))
    rows = materialise(rows.withColumn("class", F.when(F.col("bag").isNotNull(), own).otherwise(alone)).drop("bag"), "classed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "check")).alias("best")
    classes = materialise(rows.groupBy("class").agg(best, F.count("*").alias("class_size")), "classes")
    return rows.join(classes, "class").select("doc_id", "key", "check", "class", F.col("best.doc_id").alias("class_id"), "class_size", "best")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, the one of least id."""
    classed = near_duplicates(docs, similarity)
    chosen = classed.filter((F.col("best.key") == F.col("key")) & (F.col("best.check") == F.col("check"))).groupBy("key", "check").agg(F.count("*").alias("copies"))
    chosen = materialise(chosen, "chosen")
    key = [F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("check")]
    kept = docs.select(F.struct("*").alias("row"), *key).join(chosen, ["key", "check"])
    if chosen.filter("copies > 1").isEmpty():
        return kept.select("row.*")
    once = kept.filter("copies > 1").groupBy("key", "check").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.filter("copies = 1").select("row.*").unionByName(once.select("row.*"))
