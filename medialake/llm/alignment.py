"""Operator 12, cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both vocabularies cut the bytes of a space and the text. A *group* ends where tokens of both end; a *link* is a pair of
tokens whose bytes overlap. As both sides cut the same bytes, the links of a text are the parts between the ends of either
side, and a block of texts is aligned by array operations over its bytes. Pairs of ids are packed into 64-bit integers, A's
id above B's. Texts are encoded once and their ids written, two or four bytes each; counting and looking up scan these:

1. Each task counts its links with ``numpy.unique`` and hands on sorted partial counts, at most ``PARTIAL`` pairs at a time.
   A global sort by ranges of the packed pair brings equal pairs together; runs are added up as they stream by. The result
   is a table of sorted shards, bounded by the product of the vocabularies and not by the corpus.
2. Executors fetch the shards once each (``SparkContext.addFile`` from the shared folder), keep them as two flat files and map
   these into memory; pages are shared by the workers of an executor and looked up by ``searchsorted``.

B reads texts whole. Where A is plain byte-level BPE (no normaliser, the usual splitting pattern), a text is cut for it before
spaces that follow a character that is no white space, which its pattern always does too; each distinct chunk is encoded
once a worker and remembered (``MEMO`` entries at most, emptied when full). With another A texts are encoded whole.

Defined cases: a null or empty text has no tokens, and neither has one whose bytes either side does not give back (say one
with U+2581, which B reads as a space); such texts count nothing. Strings of special tokens are plain text. Texts are taken
whole, also one of a single long chunk; repeated rows count as often as they stand; an empty table gives no rows;
other columns are ignored, whatever their names; a null id stays null.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pyspark.sql.functions as F
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame

from .bytehash import binary_column, blocks
from .common import materialise, shuffle_width, text_of
from .tokens import Memo, byte_letters

LOW = (1 << 32) - 1
PARTIAL = 1 << 21
MEMO = 500_000
BLOCK = 1 << 20  # bytes of texts or ids that are worked on at once
#: White space by any of the libraries' tables; a chunk ends behind none of these.
BLANK = "\\s\u180e\u200b\ufeff"
ODD = re.compile(f"^ |[{BLANK}] | $")
CUT = re.compile(f"(?<=[^{BLANK}])(?= +[^ ])")
# Fixed value: the splitting pattern of byte-level BPE, for texts of printable ASCII and line ends.
PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+")
PRINTABLE = re.compile(r"[\x20-\x7E\n\r\t]*")
LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


class Aligned(NamedTuple):
    """A block of texts: tokens of each side, links and groups, with the bounds of each text among them."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray  # where a group ends
    b_last: np.ndarray
    pairs: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    pair_at: np.ndarray
    group_at: np.ndarray


def bounds(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)


class Pair:
    """The two vocabularies in a worker: a byte-level one of the tokenizers library, and a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.letters = byte_letters()
        byte = {self.letters.get(b, chr(b)): b for b in range(256)}
        vocabulary = self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            a_bytes[k] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_of = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in (a_bytes, b_bytes))
        self.width = np.dtype("<u2" if max(len(a_bytes), len(b_bytes)) <= 1 << 16 else "<u4")
        # ids as text with what follows: within a group, at the end of its first half, at its end
        spelt = [f"{k}{mark}" for k in range(len(a_bytes)) for mark in ",|"] + [f"{k}{mark}" for k in range(len(b_bytes)) for mark in ",;"]
        self.spelt = pa.array(spelt, pa.large_binary())
        spec = json.loads(self.a.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.apart = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
        self.memo = Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        """A's ids, packed, for a space and ``chunk``."""
        latin = LATIN.fullmatch(chunk)
        if latin is not None:
            word, marks = latin.groups()
            word = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            parts = ["\u0120" + word, marks] if marks else ["\u0120" + word]
        elif PRINTABLE.fullmatch(chunk):
            parts = [p.translate(self.letters) for p in PIECES.findall(" " + chunk)]
        else:
            return array("I", self.a.encode(" " + chunk, add_special_tokens=False).ids).tobytes()
        return array("I", [t.id for p in parts for t in self.model.tokenize(p)]).tobytes()

    def a_packed(self, text: str) -> bytes:
        if not self.apart:
            return array("I", self.a.encode(" " + text, add_special_tokens=False).ids).tobytes()
        chunks = text.split(" ") if ODD.search(text) is None else [c[1:] for c in CUT.split(" " + text)]
        return b"".join(map(self.memo.__getitem__, chunks))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of both sides as bytes of ``self.width``; of a text that a side does not give back, none."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        whole = [b" " + t.encode() if t else b"" for t in texts]
        packed = [self.a_packed(t) if t else b"" for t in texts]
        tokens = [t if w else [] for t, w in zip(self.b.encode(texts, num_threads=1), whole)]
        a, b = np.frombuffer(b"".join(packed), np.uint32), np.array([k for t in tokens for k in t], np.uint32)
        size, joined = bounds([len(w) for w in whole]), b"".join(whole)
        good, sides = np.ones(len(texts), bool), []
        for ids, at, lengths, own in ((a, bounds([len(p) // 4 for p in packed]), self.lengths[0], self.bytes_of[0]), (b, bounds([len(t) for t in tokens]), self.lengths[1], self.bytes_of[1])):
            got = own.take(pa.array(ids))
            data = got.buffers()[2]
            data = data.to_pybytes()[: len(joined) + 1] if data is not None else b""
            if data != joined or not np.array_equal(bounds(lengths[ids])[at], size):
                good &= np.array([w == b"".join(got[x:y].to_pylist()) for w, x, y in zip(whole, at, at[1:])], bool)
            sides.append((ids.astype(self.width).tobytes(), (at * self.width.itemsize).tolist()))
        return tuple([raw[x:y] if ok else b"" for x, y, ok in zip(at, at[1:], good)] for raw, at in sides)

    def align(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> Aligned:
        """Links and groups of a block of texts, given by the ids of both sides and the bounds of each text."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        size = np.concatenate(([0], a_ends))[a_at]  # where texts end
        ends = np.zeros((2, size[-1] + 1), bool)  # of tokens
        ends[0][a_ends], ends[1][b_ends] = True, True
        cuts = np.flatnonzero(ends[0] | ends[1])
        of_a, of_b = ends[0][cuts], ends[1][cuts]
        pairs = a[np.cumsum(of_a) - of_a] << 32 | b[np.cumsum(of_b) - of_b]
        common = cuts[of_a & of_b]
        return Aligned(a, b, of_b[of_a], of_a[of_b], pairs, a_at, b_at, np.searchsorted(cuts, size, "right"), np.searchsorted(common, size, "right"))

    def spell(self, x: Aligned) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        heads = lambda last: np.cumsum(last) - last  # the group of each token
        ends_a, ends_b = np.flatnonzero(x.a_last) + 1, np.concatenate(([0], np.flatnonzero(x.b_last) + 1))
        order = np.empty(len(x.a) + len(x.b), np.int64)
        order[np.arange(len(x.a)) + ends_b[heads(x.a_last)]] = 2 * x.a + x.a_last
        order[np.arange(len(x.b)) + ends_a[heads(x.b_last)]] = 2 * len(self.lengths[0]) + 2 * x.b + x.b_last
        taken = self.spelt.take(pa.array(order))
        starts = np.frombuffer(taken.buffers()[1], np.int64)[x.a_at + x.b_at]
        data = memoryview(taken.buffers()[2]) if len(order) else b""
        return [bytes(data[i : max(i, j - 1)]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id long, a binary, b binary``: the ids of each text by both vocabularies, written once."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(path_a, path_b)
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text", BLOCK):
                raw = data.tobytes()
                a, b = own.encode([raw[starts[r] : starts[r + 1]].decode("utf-8", "replace") for r in range(j - i)])
                yield pa.record_batch([batch.column(0)[i:j], pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    return materialise(texts.mapInArrow(encode, "doc_id long, a binary, b binary"), "ids")


def _blocks(own: Pair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Aligned]]:
    """The rows of a batch of ``encoded``, aligned block by block."""
    for i, j, data, a_starts in blocks(batch, "a", BLOCK):
        b, b_starts = binary_column(batch.column(batch.schema.get_field_index("b"))[i:j])
        ids = lambda raw: np.frombuffer(raw.tobytes(), own.width)
        yield i, j, own.align(ids(data), a_starts // own.width.itemsize, ids(b), b_starts // own.width.itemsize)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    keys, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, where, counts)
    return keys, out


def pair_counts(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How many links of a corpus, ``encoded`` before, hold each pair of ids: ``pair long, n long``, in sorted shards that
    share no pair."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    batch_of = lambda keys, counts: pa.record_batch([pa.array(keys), pa.array(counts)], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(path_a, path_b)
        keys = counts = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, met in _blocks(own, batch):
                got, times = np.unique(met.pairs, return_counts=True)
                keys, counts = added(np.concatenate((keys, got)), np.concatenate((counts, times)))
                if len(keys) > PARTIAL:
                    yield batch_of(keys, counts)
                    keys = counts = np.zeros(0, np.int64)
        yield batch_of(keys, counts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal neighbours; a run may go on in the next batch."""
        last, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((last, batch.column(0).to_numpy()))
            counts = np.concatenate((n, batch.column(1).to_numpy()))
            heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            keys, counts = keys[heads], np.add.reduceat(counts, heads)
            yield batch_of(keys[:-1], counts[:-1])
            last, n = keys[-1:], counts[-1:]
        yield batch_of(last, n)

    partials = materialise(ids.select("a", "b").mapInArrow(partial, "pair long, n long"), "pairs-by-task")
    ordered = partials.repartitionByRange(shuffle_width(partials), "pair").sortWithinPartitions("pair")
    return materialise(ordered.mapInArrow(runs, "pair long, n long"), "pairs")


def best_partners(counts: DataFrame) -> DataFrame:
    """For each id of B: its highest count and the ids of A that have it, in order."""
    own = counts.select((F.col("pair").bitwiseAND(F.lit(LOW))).alias("b"), F.shiftright("pair", 32).alias("a"), "n")
    top = own.groupBy("b").agg(F.max("n").alias("n"))
    return own.join(top, ["b", "n"]).groupBy("b", "n").agg(F.array_sort(F.collect_list("a")).alias("partners"))


class Counts:
    """The sorted shards of ``pair_counts``, mapped into memory."""

    def __init__(self, shards: list[str]) -> None:
        """``shards`` are this executor's copies, in order of their pairs; the flat files are written beside them."""
        total = sum(pq.read_metadata(f).num_rows for f in shards)
        paths = [f"{shards[0]}.{c}.npy" for c in ("pair", "n")] if total else []
        if not all(map(os.path.exists, paths)):
            whole = [np.lib.format.open_memmap(f"{p}.{os.getpid()}", "w+", np.int64, (total,)) for p in paths]
            at = 0
            for f in shards:
                rows = pq.read_table(f)
                for column, out in zip(("pair", "n"), whole):
                    out[at : at + rows.num_rows] = rows.column(column).to_numpy()
                at += rows.num_rows
            for p, out in zip(paths, whole):
                out.flush()
                os.replace(f"{p}.{os.getpid()}", p)  # another worker may have made the same file
        self.pair, self.n = (np.load(p, mmap_mode="r") for p in paths) if total else np.zeros((2, 0), np.int64)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        return np.asarray(self.n[np.searchsorted(self.pair, pairs)])


_counts: dict[str, Counts] = {}


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, where
    ``n_best`` are links whose count is the highest of their B id, ``count_sum`` adds up the links' counts, and ``groups``
    spells the groups as ``a1,a2|b1;a3|b2,b3``."""
    from pyspark import SparkFiles

    context = docs.sparkSession.sparkContext
    written = encoded(docs, path_a, path_b)
    counts = pair_counts(written, path_a, path_b)
    paths = sorted(counts.inputFiles())
    for path in paths:
        context.addFile(path)  # the shards stay until the session ends, for executors to come
    shards = [path.rsplit("/", 1)[1] for path in paths]
    name = counts._medialake_path
    top = highest(counts)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = pair(path_a, path_b), top.value
        if name not in _counts:
            _counts.clear()
            _counts[name] = Counts([SparkFiles.get(f) for f in shards])
        count = _counts[name]
        for batch in batches:
            for i, j, met in _blocks(own, batch):
                distinct, where = np.unique(met.pairs, return_inverse=True)
                n = count.of(distinct)
                sums = [np.diff(bounds(of[where])[met.pair_at]) for of in (n == best[distinct & LOW], n)]
                columns = [*map(np.diff, (met.a_at, met.b_at, met.group_at, met.pair_at)), *sums]
                yield pa.record_batch([batch.column(0)[i:j], *map(pa.array, columns), pa.array(own.spell(met), pa.binary()).cast(pa.string())], names=names)

    return written.mapInArrow(look_up, ", ".join(f"{c} long" for c in names[:-1]) + ", groups string")


def highest(counts: DataFrame) -> Broadcast:
    """The highest count of each id of B as an array, broadcast: as long as the vocabulary of B at most."""
    rows = counts.groupBy(F.col("pair").bitwiseAND(F.lit(LOW)).alias("b")).agg(F.max("n").alias("n")).collect()
    top = np.zeros(max((r["b"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        top[r["b"]] = r["n"]
    return counts.sparkSession.sparkContext.broadcast(top)
