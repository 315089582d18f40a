"""Operator 3, suffix-array dedup: sparse distributed prefix doubling.

A byte goes when a string of ``LENGTH`` bytes that covers it starts at two places or more. Prefix doubling names
prefixes of growing length by pairs of names, sorts them in Spark, and drops positions whose name is unique.
Started from every byte it would sort the corpus' bytes, with some 30 bytes a row, several times over. Here
only *anchors* enter the sort, and nothing is lost:

* The name of a 50-byte prefix comes from doubling 8, 16, 32 inside the executor. Of the 151 such prefixes in a
  200-byte window the least is the window's anchor: it depends on the window's bytes alone, so equal windows
  have equal anchors at equal offsets. Windows with one anchor are neighbours; together they are the anchor's
  context, of 200 to 350 bytes, about one for each 64 bytes of text.
* Round 50: Spark range-sorts the anchors by (50-byte name, context name, document). An anchor whose 50-byte
  name is unique leaves: none of its windows occurs twice. Where the whole context occurs twice, all its
  windows do, and the anchor is decided.
* Rounds 100 and 150: only contexts that share their anchor with a different context, the ends of repeated
  passages, go on, as up to three positions each: the anchor, and 50 and 100 bytes before it. Every window of a
  context holds the 150 bytes from one of these. A position's rank is paired with the name 50 bytes on, then the
  rank of that pair with the name 100 bytes on; in each round Spark sorts the pairs that occur in two
  contexts or more, their places in the sort are the new ranks, and unique positions leave.
* Round 200, past which nothing is sorted: the windows of the positions that are left are named by the pair of the
  128-byte names at their offsets 0 and 72, and counted within their anchor's group.

The range sort of round 50 splits a group of any size; a run cut by a partition's edge stays undecided there and is
settled in the last round. Later rounds count pairs by aggregation, combined before the shuffle, and sort each
pair once. Anchors with over ``GROUP`` contexts, which could be a third of all rows, are counted
as rows by Spark's own aggregation instead of within one task, 16 windows at a time where they agree.

Names are 64-bit fingerprints, bytes are not read back to compare them: a window is taken for repeated by mistake if
two of them, and the fingerprint of its anchor, agree by chance.

Defined cases: a null or empty text has no bytes and its digest is that of no bytes; texts shorter than
``LENGTH`` keep everything; repeated rows are copies of each other, so all of them lose their repeats;
a text of any length is read in segments, and its contexts are cut out some megabytes at a time;
an empty table gives no rows. Cutting bytes may leave incomplete UTF-8 sequences: digests are over the
bytes, and ``remove_repeats`` drops the incomplete sequences from the text. It keeps all other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .bytehash import U64, blocks, gram8, mix, shifted
from .common import discard, materialise, shuffle_width

LENGTH = 200
SEED = 50
WINDOW = LENGTH - SEED + 1
SEGMENT = 2 << 20
GROUP = 128
PLACES = 16
#: Offsets of a context's positions before its anchor, and the rounds: where the name is that joins a position's rank.
STEP = 50
BACK = (0, STEP, 2 * STEP)
GROWTH = (STEP, 2 * STEP)
#: Sorted anchors that a task holds at once.
STRETCH = 500_000
INDEX_BITS = U64(23)
INDEX = (U64(1) << INDEX_BITS) - U64(1)


def keyed() -> list[Column]:
    """What identifies a document in joins: fingerprints of its id and text."""
    return [F.xxhash64("doc_id", "text").alias("key"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("check")]



def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 50-byte and of the 128-byte prefixes at each position, by doubling."""
    h8 = mix(gram8(data), np.full(1, 1, U64))
    h16 = mix(h8, shifted(h8, 8))
    h32 = mix(h16, shifted(h16, 16))
    h64 = mix(h32, shifted(h32, 32))
    return mix(h32, shifted(h32, SEED - 32)), mix(h64, shifted(h64, 64))


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Of a block: text, first window, number of windows, offset of the anchor in the first window, name of
    the anchor and name of the context, for each anchor."""
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(LENGTH, len(data) + LENGTH) <= ends)
    if not len(at):
        return None
    h50, h128 = names(data)
    # sliding minimum by doubling; low bits carry the position, so the leftmost of equal names wins
    least = (h50 & ~INDEX) | np.arange(len(data), dtype=U64)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        if step < len(least):
            np.minimum(least[:-step], least[step:], out=least[:-step])
        span += step
    anchor = (least[at] & INDEX).astype(np.int64)
    text = np.searchsorted(starts, at, "right") - 1 if len(starts) > 2 else np.zeros(len(at), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    low, n, anchor, text = at[first], last - first + 1, anchor[first], text[first]
    size = n + LENGTH - 1
    shape = (size << 9) + anchor - low
    context = mix(mix(h128[low], h128[low + (size - 128) // 2]), h128[low + size - 128] ^ shape.astype(U64))
    return text, low - starts[text], n, anchor - low, h50[anchor], context


def segments(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A block, or a text too long for one in pieces that share ``LENGTH - 1`` bytes, with each piece's begin."""
    if len(data) <= 2 * SEGMENT:
        yield 0, data, starts
        return
    for low in range(0, len(data), SEGMENT):
        part = data[low : low + SEGMENT + LENGTH - 1]
        yield low, part, np.array([0, len(part)])


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row for each document: ``document`` (a row number), its key, and its anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("low", np.int32), ("n", np.int16), ("offset", np.int16), ("seed", np.int64), ("context", np.int64)]
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text", SEGMENT):
                found = []
                for begin, part, own in segments(data, starts):
                    rows = anchors(part, own)
                    if rows is not None:
                        found.append((rows[0], rows[1] + begin, *rows[2:]))
                text, *columns = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), *(np.zeros(0, U64) for _ in kind))
                offsets = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                structs = pa.StructArray.from_arrays([pa.array(c.astype(t) if t is not np.int64 else c.view(np.int64)) for c, (_, t) in zip(columns, kind)], [k for k, _ in kind])
                yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in (0, 1, 2)), pa.ListArray.from_arrays(offsets, structs)], names=["document", "key", "check", "anchors"])

    rows = docs.select(F.monotonically_increasing_id().alias("document"), *keyed(), F.col("text"))
    return rows.mapInArrow(find, "document long, key long, check long, anchors array<struct<low:int,n:short,offset:short,seed:long,context:long>>")


def sorted_round(found: DataFrame) -> DataFrame:
    """Round 50: ``document, low, n, offset, seed, whole, open``. ``whole``: all windows of the context occur
    elsewhere; ``open``: the context is to be compared with others of its anchor. Unique anchors are gone."""

    def decide(rows: pa.Table) -> pa.Table:
        seed, context = (rows.column(c).to_numpy() for c in ("seed", "context"))
        new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
        new_run = new_seed | np.concatenate([[True], context[1:] != context[:-1]])
        run, group = np.cumsum(new_run) - 1, np.cumsum(new_seed) - 1
        size = np.bincount(run)[run]
        runs_of = np.bincount(group[new_run])[group]
        edge = (group == 0) | (group == group[-1])
        whole = size > 1
        compared = new_run & ((runs_of > 1) | edge)
        out = rows.select(["document", "low", "n", "offset", "seed"]).append_column("whole", pa.array(whole)).append_column("open", pa.array(compared))
        return out.filter(pa.array(whole | compared))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a sorted partition in stretches of bounded size; groups at the edges of a stretch may go on beyond it
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield from decide(pa.Table.from_batches(held)).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from decide(pa.Table.from_batches(held)).combine_chunks().to_batches()

    flat = found.select("document", F.inline("anchors"))
    order = ["seed", "context", "document", "low"]
    dealt = flat.repartitionByRange(shuffle_width(found), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(runs, "document long, low int, n short, offset short, seed long, whole boolean, open boolean")


CONTEXT = "id long, document long, low int, n short, offset short, seed long, whole boolean"
POSITION = "struct<back:int,rank:long," + ",".join(f"at_{k}:long" for k in GROWTH) + ">"


def positions_of(data: np.ndarray, starts: np.ndarray, n: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of contexts laid out from ``starts`` in ``data``: context, step back from the anchor, and the names at the
    position and at the offsets of each round, for the positions that have windows."""
    h50, _ = names(data)
    # windows begin from `first` to `offset` bytes before the anchor
    first = offset - n + 1
    has = np.stack([(offset >= back) & (first <= back + STEP - (back < BACK[-1])) for back in BACK], 1)
    who, k = np.nonzero(has)
    at = starts[who] + offset[who] - np.array(BACK)[k]
    return who, np.array(BACK)[k], h50[at], *(h50[at + more] for more in GROWTH)


def context_bytes(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The bytes and the positions of each open context, from the texts of the documents that hold one."""
    names_ = [c.split()[0] for c in CONTEXT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text", SEGMENT):
                lists_ = batch.column(1).slice(i, j - i)
                every = lists_.flatten()
                number = np.diff(lists_.offsets.to_numpy())
                begins = np.repeat(starts[:-1], number) + every.field("low").to_numpy()
                sizes = every.field("n").to_numpy().astype(np.int64) + LENGTH - 1
                before = np.cumsum(sizes) - sizes
                edges = [*np.searchsorted(before, np.arange(0, int(sizes.sum()), SEGMENT)).tolist(), len(sizes)]
                for a, b in zip(edges[:-1], edges[1:]):
                    if a == b:
                        continue
                    rows, begin, size = every.slice(a, b - a), begins[a:b], sizes[a:b]
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    raw = data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
                    content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
                    who, back, rank, *more = positions_of(raw, offsets[:-1], size - LENGTH + 1, rows.field("offset").to_numpy().astype(np.int64))
                    fields = [pa.array(back.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (rank, *more))]
                    structs = pa.StructArray.from_arrays(fields, ["back", "rank", *(f"at_{k}" for k in GROWTH)])
                    positions = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(size) + 1)).astype(np.int32)), structs)
                    yield pa.record_batch([*(rows.field(k) for k in names_), content, positions], names=[*names_, "content", "positions"])

    joined = docs.select(*keyed(), "text").join(lists, ["key", "check"]).select("text", "contexts")
    return joined.mapInArrow(cut, CONTEXT + f", content binary, positions array<{POSITION}>")


def reranked(rows: DataFrame, growth: int) -> DataFrame:
    """The positions whose pair of rank and name at ``growth`` occurs in another context too, with the pair's rank."""
    pair = ["back", "rank", f"at_{growth}"]
    shared = rows.groupBy(*pair).agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select(*pair)
    order = shared.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("next", F.monotonically_increasing_id())
    ranks = materialise(order, "ranks")  # written, so that a rank stays what it is
    out = materialise(rows.join(ranks, pair).withColumn("rank", F.col("next")).drop("next", f"at_{growth}"), "positions")
    discard(ranks)
    return out


def alive(contexts: DataFrame) -> DataFrame:
    """``id, seed`` of the contexts with a position that no round found unique."""
    rows, done = contexts.select("id", "seed", F.inline("positions")), []
    for growth in GROWTH:
        rows = reranked(rows, growth)
        done.append(rows)
    left = materialise(rows.select("id", "seed").distinct(), "contexts-left")
    discard(*done)
    return left


def window_names(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Names of all windows of some contexts, each with the number of its context in ``rows``.

    A name covers the window's bytes, its place relative to the anchor, and the anchor."""
    content = rows.column("content")
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    starts = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    data = np.frombuffer(content.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    n = rows.column("n").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + within
    _, h128 = names(data)
    place = (rows.column("offset").to_numpy().astype(np.int64)[owner] - within).astype(U64)
    seed = rows.column("seed").to_numpy().view(U64)[owner]
    return mix(mix(h128[at], h128[at + LENGTH - 128]), seed ^ place), owner


def run_spans(owner: np.ndarray, repeated: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: context, first and last window."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return owner[first], within[first], within[last]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some ``SEGMENT`` bytes that hold all rows of their anchors, from rows sorted by anchor."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        seed = held.column("seed").to_numpy()
        size = np.cumsum(held.column("n").to_numpy().astype(np.int64) + LENGTH - 1)
        edges = np.flatnonzero(seed[1:] != seed[:-1]) + 1
        begin = 0
        while len(edges) and size[-1] - (size[begin - 1] if begin else 0) >= SEGMENT:
            fits = edges[(edges > begin) & (size[edges - 1] - (size[begin - 1] if begin else 0) <= SEGMENT)]
            more = edges[edges > begin]
            if not len(more):
                break
            end = int(fits[-1]) if len(fits) else int(more[0])
            yield held.slice(begin, end - begin)
            begin = end
        held = held.slice(begin)
    if held is not None and held.num_rows:
        yield held


SPAN = "document long, start long, end long"


def local_round(contexts: DataFrame) -> DataFrame:
    """Round 200 for anchors of at most ``GROUP`` contexts: windows are counted in the task that has the anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(rows: pa.Table) -> pa.RecordBatch:
            name, owner = window_names(rows)
            _, inverse, times = np.unique(name, return_inverse=True, return_counts=True)
            n = rows.column("n").to_numpy().astype(np.int64)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            repeated = (times[inverse] > 1) & ~rows.column("whole").to_numpy(zero_copy_only=False)[owner]
            who, first, last = run_spans(owner, repeated, within)
            low = rows.column("low").to_numpy().astype(np.int64)[who]
            return pa.record_batch([pa.array(rows.column("document").to_numpy()[who]), pa.array(low + first), pa.array(low + last + LENGTH)], names=["document", "start", "end"])

        for rows in whole_groups(batches):
            yield decide(rows)

    dealt = contexts.filter("NOT hot").drop("hot").repartition(shuffle_width(contexts), "seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(count, SPAN)


def block_rows(contexts: DataFrame) -> DataFrame:
    """Contexts cut into blocks of ``PLACES`` windows, at fixed places relative to the anchor: a row for each
    block with the names of the bytes that all windows of the block share (``core``), of all its bytes (``outer``) and
    of its windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                rows = batch.slice(k, 4096)
                name, owner = window_names(rows)
                if not len(name):
                    continue
                n = rows.column("n").to_numpy().astype(np.int64)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                place = rows.column("offset").to_numpy().astype(np.int64)[owner] - within
                block = place // PLACES
                first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]))
                size = np.diff(np.concatenate([first, [len(block)]]))
                who, at = owner[first], within[first]
                content = rows.column("content")
                starts = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
                data = np.frombuffer(content.buffers()[2], np.uint8)[starts[0] : starts[-1]]
                _, h128 = names(data)
                base = starts[who] - starts[0]
                seed = rows.column("seed").to_numpy().view(U64)[who]
                # the core lies between the begin of the block's last place and the end of its first, so it has
                # the same extent in every context, also where a context holds part of the block only
                core_at = base + rows.column("offset").to_numpy().astype(np.int64)[who] - block[first] * PLACES
                core = mix(mix(h128[core_at], h128[core_at + LENGTH - PLACES + 1 - 128]), seed ^ block[first].astype(U64))
                end = base + at + size + LENGTH - 1
                outer = mix(mix(h128[base + at], h128[end - 128]), core ^ (place[first] * 512 + size).astype(U64))
                offsets = pa.array(np.concatenate([first, [len(name)]]).astype(np.int32))
                took = [rows.column(c).to_numpy(zero_copy_only=False)[who] for c in ("seed", "id", "document", "whole")]
                start = rows.column("low").to_numpy().astype(np.int64)[who] + at
                yield pa.record_batch(
                    [pa.array(core.view(np.int64)), pa.array(outer.view(np.int64)), *map(pa.array, took), pa.array(start), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(name.view(np.int64)))],
                    names=["core", "outer", "seed", "id", "document", "whole", "start", "n", "names"],
                )

    return contexts.filter("hot").mapInArrow(cut, "core long, outer long, seed long, id long, document long, whole boolean, start long, n long, names array<long>")


def hot_round(contexts: DataFrame) -> DataFrame:
    """Round 200 for the other anchors, by aggregation of rows: blocks of windows first, and single windows only of
    blocks whose core occurs elsewhere while the whole block does not."""
    blocks_ = materialise(block_rows(contexts), "blocks")
    outer = materialise(blocks_.groupBy("seed", "outer").agg(F.min("id").alias("a"), F.max("id").alias("b")), "block-names")
    named = materialise(blocks_.join(outer, ["seed", "outer"]), "named-blocks")
    whole_blocks = named.filter("a <> b AND NOT whole").select("document", "start", (F.col("start") + F.col("n") + F.lit(LENGTH - 1)).alias("end"))
    # one block of each name stands for all of them from here on
    single = named.filter("id = a").withColumn("known", F.col("whole") | (F.col("a") != F.col("b")))
    mixed = materialise(single.groupBy("seed", "core").agg(F.min("outer").alias("x"), F.max("outer").alias("y"), F.min("known").alias("all_known")).filter("x <> y AND NOT all_known").select("seed", "core"), "mixed-cores")
    windows = single.join(mixed, ["seed", "core"], "left_semi").select("seed", "id", "document", "known", "start", F.posexplode("names").alias("k", "name"))
    windows = materialise(windows.select("seed", "name", "id", "document", "known", (F.col("start") + F.col("k")).alias("start")), "windows")
    repeated = materialise(windows.groupBy("seed", "name").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("seed", "name"), "repeated-windows")
    hit = windows.filter("NOT known").join(repeated, ["seed", "name"], "left_semi")
    return whole_blocks.unionByName(hit.select("document", "start", (F.col("start") + LENGTH).alias("end")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``key, check, spans``: for each document with repeats the byte ranges that they cover, unmerged."""
    found = materialise(anchor_rows(docs), "anchors")
    keys = materialise(found.select("document", "key", "check"), "keys")
    decided = materialise(sorted_round(found), "anchors-decided")
    discard(found)
    pending = decided.filter("open").select(F.xxhash64("document", "low").alias("id"), "document", "low", "n", "offset", "seed", "whole")
    lists = pending.join(keys, "document").groupBy("key", "check").agg(F.collect_list(F.struct(*[c.split()[0] for c in CONTEXT.split(", ")])).alias("contexts"))
    lists = materialise(lists, "open-contexts")
    opened = materialise(context_bytes(docs, lists), "contexts")
    left = alive(opened)
    # written, so that the planner knows how few the hot anchors are and need not sort all rows by anchor to join them
    hot = left.groupBy("seed").agg(F.count("*").alias("n_contexts")).filter(F.col("n_contexts") > GROUP).select("seed", F.lit(True).alias("hot"))
    hot = materialise(hot, "hot-anchors")
    flags = left.join(hot, "seed", "left").select("id", F.coalesce("hot", F.lit(False)).alias("hot"))
    contexts = materialise(opened.drop("positions").dropDuplicates(["id"]).join(flags, "id"), "contexts")
    discard(lists, opened, left, hot)
    spans = local_round(contexts).unionByName(hot_round(contexts))
    whole = decided.filter("whole").select("document", F.col("low").cast("long").alias("start"), (F.col("low") + F.col("n") + F.lit(LENGTH - 1)).cast("long").alias("end"))
    both = whole.unionByName(spans).join(keys, "document").select("key", "check", "start", "end")
    out = materialise(both.groupBy("key", "check").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeats")
    discard(decided, keys, contexts)
    return out


def merged(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(((s["start"], s["end"]) for s in spans or ())):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` and ``spans``; the join key holds the document id, so no group
    of copies shares one."""
    rows = docs.select(F.struct("*").alias("row"), "text", *keyed())
    return rows.join(repeated_spans(docs), ["key", "check"], "left").select("row", "text", "spans")


def kept_parts(text: str | None, spans: list[dict[str, int]] | None) -> tuple[bytes, bytes, int]:
    raw = (text or "").encode()
    cuts = merged(spans)
    at, kept = 0, []
    for a, b in cuts:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return raw, b"".join(kept), len(cuts)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw, kept, n = kept_parts(text.as_py(), spans.as_py())
                for column, value in zip(rows, (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(plain).select("row.doc_id", "text", "spans").mapInArrow(sums, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; rows stay, with all their columns."""
    names_ = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            at = names_.index("text")
            texts = columns[at].to_pylist()
            for r, own in enumerate(batch.column(1).to_pylist()):
                if own:
                    texts[r] = kept_parts(texts[r], own)[1].decode(errors="ignore")
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names=names_)

    return with_spans(docs).select("row", "spans").mapInArrow(cut, docs.schema)
