"""Operator 7, benchmark decontamination.

The windows of all benchmark items (``size`` consecutive normalised words; an item with fewer words is one
window) form a hash set that is broadcast. Executors hash the words of each block of texts with a handful of
vector operations, roll them into windows, look the windows up, and verify every hit word by word against
the item, so a hash collision marks nothing.

What is broadcast is the items' words, up to ``block_windows`` windows; workers build the hash set of it once, with
some 16 bytes a window beside the words. A larger benchmark is taken in blocks of that size, one scan of the
documents each, and the hits of all blocks are merged per document before anything is judged or cut.

Defined cases: a null or empty text, or one without words, has no hits; items without words match nothing;
a text of any length is one block of words, whatever the others are; repeated or tied items each count; repeated documents each get their row; an item with a null id is hit and
cut as any other, and only its id is left out of the list of items; empty tables on either side give all-clean or no rows; other columns are ignored by
``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .bytehash import blocks
from .common import ALNUM_PATTERN, materialise
from .wordhash import ALNUM, LOWER, roll, word_table

SPAN = "array<struct<first:long,last:long,start:long,end:long>>"
SCHEMA = f"doc_id long, text_key long, n_words long, items array<string>, spans {SPAN}"
ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])))])


def words_of(text: bytes) -> list[bytes]:
    return ALNUM_PATTERN.findall(text.lower())  # bytes.lower() changes A-Z alone


class WindowSet:
    """The windows of a block of ``(item, words joined by blanks)``, sorted by fingerprint: 16 bytes a window beside
    the words. Windows have ``size`` words, or all words of a shorter item."""

    def __init__(self, block: list[tuple[str | None, bytes]], size: int) -> None:
        self.items = [item for item, _ in block]
        texts = [text for _, text in block]
        self.data = b"".join(texts)
        starts = np.cumsum([0, *map(len, texts)])
        self.begins, self.ends, hashes, first = word_table(np.frombuffer(self.data, np.uint8), starts, ALNUM)
        self.item_of = np.repeat(np.arange(len(block)), np.diff(first))
        number = np.diff(first)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(number[number > 0], size)).tolist():
            rolled = roll(hashes, length)
            own = self.item_of[: len(rolled)]
            fits = (own == self.item_of[length - 1 :]) & (np.minimum(number, size)[own] == length)
            at = np.flatnonzero(fits)
            at = at[np.argsort(rolled[at], kind="stable")]
            self.lengths[length] = (rolled[at], at)

    def hits(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray, text_of_word: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of each verified occurrence inside one text."""
        for length, (prints, places) in self.lengths.items():
            rolled = roll(hashes, length)
            if not len(rolled):
                continue
            low = np.searchsorted(prints, rolled)
            same_text = text_of_word[: len(rolled)] == text_of_word[length - 1 :]
            for k in np.flatnonzero((prints[np.minimum(low, len(prints) - 1)] == rolled) & same_text).tolist():
                phrase = b" ".join(LOWER[data[begins[w] : ends[w]]].tobytes() for w in range(k, k + length))
                equal = [p for p in places[low[k] : np.searchsorted(prints, rolled[k], "right")].tolist() if self.data[self.begins[p] : self.ends[p + length - 1]] == phrase]
                if equal:  # an item without an id is hit, and is not in the list
                    yield k, length, {item for p in equal if (item := self.items[self.item_of[p]]) is not None}


_known: dict[str, object] = {}


def window_set(shared: Broadcast, size: int) -> WindowSet:
    """The set of a broadcast block, built once a worker; a worker keeps the one that it used last."""
    if shared.value is not _known.get("block"):
        _known.clear()
        _known.update(block=shared.value, windows=WindowSet(shared.value, size))
    return _known["windows"]


def find(known: WindowSet, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[set[str]], list[list[dict[str, int]]]]:
    """Of each text of a block: its word count, the items found, and the hit runs as words and as bytes."""
    begins, ends, hashes, first = word_table(data, starts, ALNUM)
    n = len(starts) - 1
    text_of_word = np.repeat(np.arange(n), np.diff(first))
    items: list[set[str]] = [set() for _ in range(n)]
    hit = np.zeros(len(begins) + 1, np.int64)
    for k, length, own in known.hits(data, begins, ends, hashes, text_of_word):
        items[text_of_word[k]].update(own)
        hit[k] += 1
        hit[k + length] -= 1
    covered = np.cumsum(hit)[:-1] > 0
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    for r in np.unique(text_of_word[covered]).tolist():
        turns = np.flatnonzero(np.diff(np.concatenate([[False], covered[first[r] : first[r + 1]], [False]]).astype(np.int8)))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            spans[r].append({"first": a, "last": b - 1, "start": int(begins[first[r] + a] - starts[r]), "end": int(ends[first[r] + b - 1] - starts[r])})
    return np.diff(first), items, spans


def scan(docs: DataFrame, block: list[tuple[str | None, bytes]], size: int) -> DataFrame:
    """``doc_id, text_key, n_words, items, spans`` of each document against one block of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = window_set(shared, size)
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text"):
                n_words, items, spans = find(known, data, starts)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), n_words.astype(np.int64), [sorted(x) for x in items], spans]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(look, SCHEMA)


def window_blocks(benchmark: DataFrame, size: int, block_windows: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most ``block_windows`` windows; the driver never holds more than one block and one
    item. An item that goes over two blocks has ``size - 1`` words in both."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own: list[tuple[str | None, bytes]] = []
    room, any_block = block_windows, False
    for row in rows.toLocalIterator():
        words = words_of(row["text"].encode())
        at, n = 0, max(1, len(words) - size + 1) if words else 0
        while at < n:
            if not room:
                any_block = True
                yield own
                own, room = [], block_windows
            took = min(room, n - at)
            own.append((row["item"], b" ".join(words[at : at + took + size - 1])))
            at, room = at + took, room - took
    if own or not any_block:
        yield own


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = 500_000) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row of ``docs(doc_id, text)``.

    Spans are the maximal runs of hit words, as word numbers ``first..last`` and as bytes ``[start, end)``."""
    scans = [scan(docs, block, size) for block in window_blocks(benchmark, size, block_windows)]
    found = scans[0]
    if len(scans) > 1:
        # each row comes once from every block; equal rows stay as many as they were
        for more in scans[1:]:
            found = found.unionByName(more)
        found = found.groupBy("doc_id", "text_key", "n_words").agg(
            F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
        )
        found = found.withColumn("spans", F.expr(MERGE_SPANS)).withColumn("copy", F.explode(F.expr(f"sequence(1, int(n / {len(scans)}))")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


MERGE_SPANS = """aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>), (done, s) ->
    CASE WHEN size(done) > 0 AND s.first <= element_at(done, -1).last + 1
         THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last),
                     'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
         ELSE concat(done, array(s)) END)"""


def cut(text: bytes, spans: list[dict[str, int]]) -> bytes:
    for s in reversed(spans):
        text = text[: s["start"]] + b"\n" + text[s["end"] :]
    return text


def mostly_hit(spans: list[dict[str, int]], n_words: int, remove_above: float) -> bool:
    return sum(s["last"] - s["first"] + 1 for s in spans) > remove_above * n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove_above: float = 0.5, block_windows: int = 500_000) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``, and without the documents of whose words more than
    the share ``remove_above`` is hit. All columns stay; a cut leaves one line break, and a text is looked
    at again until nothing is found, so words that a cut brings together make no new hit.

    The share and each cut follow from the hits of all blocks, so the result is the same for any ``block_windows``."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in window_blocks(benchmark, size, block_windows)]
    if len(shared) > 1:
        return decontaminate_by_blocks(docs, shared, size, remove_above)
    (windows,) = shared

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = window_set(windows, size)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep, texts = np.ones(batch.num_rows, bool), {}
            for i, j, data, starts in blocks(batch, "text"):
                n_words, _, spans = find(known, data, starts)
                for r in range(j - i):
                    if not spans[r]:
                        continue
                    if mostly_hit(spans[r], n_words[r], remove_above):
                        keep[i + r] = False
                        continue
                    text, own = data[starts[r] : starts[r + 1]].tobytes(), spans[r]
                    while own:
                        text = cut(text, own)
                        own = find(known, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[2][0]
                    texts[i + r] = text.decode()
            if texts:
                column = batch.column(at).to_pylist()
                for r, text in texts.items():
                    column[r] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def decontaminate_by_blocks(docs: DataFrame, shared: list[Broadcast], size: int, remove_above: float) -> DataFrame:
    """``decontaminate`` for a benchmark of several blocks. In each turn all blocks look at the same texts, their
    spans are merged, and each text is cut once; the next turn looks at the texts that were cut."""

    def hits(texts: DataFrame, block: Broadcast) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = window_set(block, size)
            for batch in batches:
                for i, j, data, starts in blocks(batch, "text"):
                    n_words, _, spans = find(known, data, starts)
                    hit = [r for r in range(j - i) if spans[r]]
                    columns = [batch.column(k).slice(i, j - i).take(pa.array(hit, pa.int64())) for k in range(2)]
                    yield pa.record_batch([*columns, pa.array(n_words[hit].astype(np.int64)), pa.array([spans[r] for r in hit], ARROW.field("spans").type)], names=["row", "text", "n_words", "spans"])

        return texts.mapInArrow(look, f"row long, text string, n_words long, spans {SPAN}")

    def changed(first: bool):
        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, n_words, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    out.append(None if first and mostly_hit(spans, n_words, remove_above) else cut(text.encode(), spans).decode())
                yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

        return change

    # written once, so that a row keeps its number
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    texts = rows.select("row", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    turns: list[DataFrame] = []
    while True:
        found = hits(texts, shared[0])
        for block in shared[1:]:
            found = found.unionByName(hits(texts, block))
        merged = found.groupBy("row").agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        turn = materialise(merged.withColumn("spans", F.expr(MERGE_SPANS)).mapInArrow(changed(not turns), "row long, text string"), "cut-texts")
        if turn.isEmpty():
            break
        turns.append(turn.select("row", F.lit(len(turns)).alias("turn"), "text"))
        texts = turn.filter("text IS NOT NULL")
    if not turns:
        return rows.select("doc.*")
    changes = turns[0]
    for turn in turns[1:]:
        changes = changes.unionByName(turn)
    last = changes.groupBy("row").agg(F.max(F.struct("turn", "text")).alias("change"))
    text = F.when(F.col("change").isNull(), F.col("doc.text")).otherwise(F.col("change.text").cast(docs.schema["text"].dataType))
    out = rows.join(last, "row", "left").filter("change IS NULL OR change.text IS NOT NULL")
    return out.select(*(text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The items of each document as a count and as a sha256 of their sorted, comma-joined ids."""
    joined = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
