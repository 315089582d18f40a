"""Operator 6, LM scoring with Brown's class-based bigram model.

Training words are counted in full. The most frequent ``clustered`` words are assigned to ``classes`` classes by
exchange clustering, which moves one word at a time to the class that raises the likelihood of the class
bigrams most, until none moves. Every other training word, however rare, then goes to the one of these classes
that raises the likelihood most, by the counts of the classes on its left and right; among its neighbours, words
outside the clustered ones count by kind (frequent or rare, by length). The class bigrams are counted again with
the classes of all words. A text's probability is the product of P(class | previous class), which is smoothed,
and P(word | class) over its words and one end token. A word unseen in training is the only member of a class for its
length, which has no counts but the smoothing.

Scans of the texts: word counts; bigrams of the clustered words and kinds; neighbours of all other words; classes of
the frequent words. The last one leaves a class a word, in which the classes of rare words are filled in and which
the class bigrams and scores are taken from. Words and their classes grow with the corpus and stay distributed. Two
tables are broadcast, both of bounded size: the words above a frequency threshold that at most ``frequent`` words
pass, and the class model. Words below the threshold, a few per cent of all tokens, are joined by fingerprint with
the table of all classes. Words are identified by 64-bit fingerprints.

Defined cases: a null or empty text is just the end token; a null id counts as the empty string, so its text
is used for training; a text of any length is read whole, and is one row of classes; repeated rows are each learned from and scored; with no training text every count is 0
and all probabilities come from smoothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .bytehash import U64, blocks
from .common import materialise
from .wordhash import NOT_BLANK, word_table

#: Upper byte lengths of the kinds of words outside the clustered vocabulary, and of unseen words.
LENGTHS = np.array([3, 6, 9, 13])
N_BINS = len(LENGTHS) + 1
FLUSH_WORDS = 2_000_000
FLUSH_NEIGHBOURS = 1 << 20
ASSIGN_CELLS = 1 << 15
TRANSITION_SMOOTHING = 0.5


def training_flag(held_out_of: int = 7, held_out: int = 2):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_out_of) != held_out


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), training_flag().alias("training"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_block(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and length bin of each word of a block, and the number of words before each text."""
    begins, ends, hashes, first = word_table(data, starts, NOT_BLANK)
    return hashes, np.searchsorted(LENGTHS, ends - begins, "left").astype(np.int8), first


def count_words(rows: DataFrame) -> DataFrame:
    """``word, bin, n`` of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins, counts = np.zeros(0, U64), np.zeros(0, np.int8), np.zeros(0, np.int64)

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(words.view(np.int64)), pa.array(bins), pa.array(counts)], names=["word", "bin", "n"])

        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, starts in blocks(batch, "text"):
                hashes, own_bins, first = word_block(data, starts)
                chosen = np.repeat(training[i:j], np.diff(first))
                own, at, n = np.unique(hashes[chosen], return_index=True, return_counts=True)
                both = np.concatenate([words, own])
                both_bins = np.concatenate([bins, own_bins[chosen][at]])
                words, at, where = np.unique(both, return_index=True, return_inverse=True)
                bins = both_bins[at]
                counts = np.bincount(where, np.concatenate([counts, n]), len(words)).astype(np.int64)
                if len(words) > FLUSH_WORDS:
                    yield packed()
                    words, bins, counts = words[:0], bins[:0], counts[:0]
        if len(words):
            yield packed()

    found = rows.mapInArrow(count, "word long, bin byte, n long")
    return found.groupBy("word").agg(F.min("bin").alias("bin"), F.sum("n").alias("n"))


@dataclass
class Model:
    """Bounded: the frequent words' fingerprints (sorted), counts and symbols, and the class tables."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    n_clustered: int
    tokens: int
    distinct: int
    end_count: int
    n_classes: int = 1
    class_of: np.ndarray | None = None  # by symbol, for the neighbours of words outside the clustered ones
    class_of_word: np.ndarray | None = None  # by frequent word

    @property
    def least(self) -> int:
        """Words of this frequency or more are among the frequent ones."""
        return int(self.counts.min()) if len(self.counts) else 1 << 62

    @property
    def n_symbols(self) -> int:
        return self.n_clustered + 2 * N_BINS + 1

    def look_up(self, hashes: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its place among the frequent words (-1: rare), and its symbol."""
        if not len(self.words):
            return np.full(len(hashes), -1), self.n_clustered + N_BINS + bins.astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        at = np.where(self.words[at] == hashes, at, -1)
        return at, np.where(at >= 0, self.symbols[at], self.n_clustered + N_BINS + bins.astype(np.int64))

    def sequence(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The symbols of a block with the end symbol after each text."""
        return np.insert(symbols, first[1:], self.n_symbols - 1)


def frequent_words(counts: DataFrame, frequent: int, clustered: int) -> Model:
    """Words above the lowest frequency that at most ``frequent`` words reach; collects those words only."""
    level = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for step in sorted(steps, key=lambda s: -s["level"]):
        if total + step["words"] > frequent:
            break
        total, least = total + step["words"], step["least"]
    top = counts.filter(F.col("n") >= (least or 0)).toArrow() if least else None
    words = top.column("word").to_numpy().view(U64) if top else np.zeros(0, U64)
    n = top.column("n").to_numpy() if top else np.zeros(0, np.int64)
    bins = top.column("bin").to_numpy() if top else np.zeros(0, np.int8)
    order = np.argsort(words)
    words, n, bins = words[order], n[order], bins[order]
    leading = np.lexsort((words, -n))[:clustered]
    symbols = len(leading) + bins.astype(np.int64)
    symbols[leading] = np.arange(len(leading))
    return Model(words, n, symbols, len(leading), sum(s["tokens"] for s in steps), sum(s["words"] for s in steps), 0)


def count_bigrams(rows: DataFrame, model: Model) -> np.ndarray:
    """Counts of neighbouring symbols, a matrix of the model's size."""
    shared, size = rows.sparkSession.sparkContext.broadcast(model), model.n_symbols

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = shared.value, np.zeros(size * size, np.int64)
        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, starts in blocks(batch, "text"):
                hashes, bins, first = word_block(data, starts)
                chosen = np.repeat(training[i:j], np.diff(first))
                _, symbols = own.look_up(hashes[chosen], bins[chosen])
                line = own.sequence(symbols, np.concatenate([[0], np.cumsum(np.diff(first)[training[i:j]])]))
                if len(line):
                    before = np.concatenate([[size - 1], line[:-1]])  # a text starts after an end
                    cells += np.bincount(before * size + line, minlength=size * size)
        used = np.flatnonzero(cells)
        for k in range(0, len(used), 1 << 17):
            part = used[k : k + (1 << 17)]
            yield pa.record_batch([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    table = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    out = np.zeros(size * size, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def exchange_clustering(bigrams: np.ndarray, n_words: int, classes: int) -> np.ndarray:
    """Classes of the first ``n_words`` symbols; every other symbol is a class of its own. Passes go on until no word
    moves; a move has to gain more than rounding can, so they end."""
    classes = max(1, min(classes, n_words))
    n_other = len(bigrams) - n_words
    total = classes + n_other
    class_of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(n_other)])
    between = np.zeros((len(bigrams), total))
    np.add.at(between.T, class_of, bigrams.T)  # symbol -> class counts
    into = np.zeros((len(bigrams), total))
    np.add.at(into.T, class_of, bigrams)  # counts from each class into a symbol
    pairs = np.zeros((total, total))
    np.add.at(pairs, class_of, between)
    g = lambda x: x * np.log(np.maximum(x, 1.0))
    tolerance = 1e-9 + 1e-13 * float(g(float(bigrams.sum())))
    moved = True
    while moved:
        moved = False
        for w in range(n_words):
            old, own = class_of[w], bigrams[w, w]
            right, left = between[w].copy(), into[w].copy()
            right[old] -= own
            left[old] -= own
            pairs[old] -= right
            pairs[:, old] -= left
            pairs[old, old] -= own
            some = pairs[:classes]
            rows = g(some + right) - g(some)
            columns = g(pairs[:, :classes] + left[:, None]) - g(pairs[:, :classes])
            k = np.arange(classes)
            gain = rows.sum(1) + columns.sum(0) - rows[k, k] - columns[k, k] + g(some[k, k] + right[k] + left[k] + own) - g(some[k, k])
            # a class's total has its bigrams with the word, wherever the word goes
            out_of, in_to = some.sum(1) + left[:classes], pairs[:, :classes].sum(0) + right[:classes]
            n_right, n_left = right.sum() + own, left.sum() + own
            gain -= g(out_of + n_right) - g(out_of) + g(in_to + n_left) - g(in_to)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + tolerance else old
            pairs[new] += right
            pairs[:, new] += left
            pairs[new, new] += own
            if new != old:
                moved = True
                class_of[w] = new
                between[:, old] -= bigrams[:, w]
                between[:, new] += bigrams[:, w]
                into[:, old] -= bigrams[w]
                into[:, new] += bigrams[w]
    return class_of


def pairs_of(bigrams: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes."""
    n = int(class_of.max()) + 1
    pairs = np.zeros((n, n))
    np.add.at(pairs, (class_of[:, None], class_of[None, :]), bigrams)
    return pairs


def neighbours(rows: DataFrame, model: Model) -> DataFrame:
    """``word, cells``: of words outside the clustered ones, counts by the class before (cell = class) and after
    (cell = number of classes + class), packed as ``cell << 48 | count``; a word comes once from each run of a task."""
    shared, n = rows.sparkSession.sparkContext.broadcast(model), int(model.class_of.max()) + 1

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, left, right = (np.concatenate(x) for x in zip(*parts))
        own, where = np.unique(words, return_inverse=True)
        cells, counts = np.unique(np.concatenate([where * (2 * n) + left, where * (2 * n) + n + right]), return_counts=True)
        codes = (cells % (2 * n)) << 48 | counts
        offsets = np.searchsorted(cells, np.arange(len(own) + 1) * (2 * n)) * 8
        binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(codes.astype(np.int64))])
        return pa.record_batch([pa.array(own.view(np.int64)), binary], names=["word", "cells"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, held = shared.value, [], 0
        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, starts in blocks(batch, "text"):
                hashes, bins, first = word_block(data, starts)
                number = np.diff(first)
                chosen = np.repeat(training[i:j], number)
                number = number[training[i:j]]
                hashes = hashes[chosen]
                _, symbols = own.look_up(hashes, bins[chosen])
                line = own.class_of[own.sequence(symbols, np.concatenate([[0], np.cumsum(number)]))]
                other = np.flatnonzero(symbols >= own.n_clustered)
                if not len(other):
                    continue
                at = other + np.repeat(np.arange(len(number)), number)[other]  # an end stands after each text before
                parts.append((hashes[other], line[at - 1], line[at + 1]))
                held += len(other)
                if held > FLUSH_NEIGHBOURS:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return rows.mapInArrow(look, "word long, cells binary")


def best_classes(owner: np.ndarray, cell: np.ndarray, times: np.ndarray, pairs: np.ndarray, n_classes: int) -> np.ndarray:
    """For each word the induced class that raises the likelihood of the class bigrams most; cells are sorted by owner."""
    g = lambda x: x * np.log(np.maximum(x, 1.0))
    n, k = len(pairs), np.arange(n_classes)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    # by cell and class: what the class bigram has so far
    some = np.concatenate([pairs[:, :n_classes], pairs[:n_classes].T])
    gain = np.add.reduceat(g(some[cell] + times[:, None]) - g(some)[cell], starts)
    # a class beside itself takes both counts in one cell
    left, right = np.zeros((2, len(starts), n_classes))
    for side, low in ((left, 0), (right, n)):
        inside = (cell >= low) & (cell < low + n_classes)
        np.add.at(side, (owner[inside], cell[inside] - low), times[inside])
    w, c = np.nonzero((left > 0) & (right > 0))
    same, a, b = pairs[k, k][c], left[w, c], right[w, c]
    gain[w, c] += g(same + a + b) - g(same + a) - g(same + b) + g(same)
    number = np.add.reduceat(np.where(cell < n, times, 0), starts)[:, None]
    for total in (pairs[:n_classes].sum(1), pairs[:, :n_classes].sum(0)):
        gain -= g(total + number) - g(total)
    return np.argmax(gain, 1)


def assign(rows: DataFrame, model: Model, pairs: np.ndarray) -> DataFrame:
    """``word, n, class`` of every training word outside the clustered ones."""
    n, n_classes = len(pairs), model.n_classes

    def chosen(words: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        own, owner = np.unique(words, return_inverse=True)
        cells, where = np.unique(owner * (2 * n) + (codes >> 48), return_inverse=True)
        times = np.bincount(where, codes & ((1 << 48) - 1), len(cells))
        owner, cell = cells // (2 * n), cells % (2 * n)
        number = np.bincount(owner, np.where(cell < n, times, 0), len(own))
        best = best_classes(owner, cell, times, pairs, n_classes)
        return pa.record_batch([pa.array(own), pa.array(number.astype(np.int64)), pa.array(best.astype(np.int16))], names=["word", "n", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, held = [], [], 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            codes.append(np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]].copy().view(np.int64))
            words.append(np.repeat(batch.column(0).to_numpy(), np.diff(starts) // 8))
            held += len(words[-1])
            if held > ASSIGN_CELLS:
                w, c = np.concatenate(words), np.concatenate(codes)
                last = int(np.searchsorted(w, w[-1]))  # the last word may go on in the next batch
                if last:
                    yield chosen(w[:last], c[:last])
                words, codes = [w[last:]], [c[last:]]
                held = len(words[0])
        if held:
            yield chosen(np.concatenate(words), np.concatenate(codes))

    found = neighbours(rows, model)
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word long, n long, class short")


def fit(rows: DataFrame, counts: DataFrame, frequent: int, clustered: int, classes: int) -> tuple[Model, DataFrame]:
    """The model of the frequent words, and ``word, n, class`` of all words that are not clustered."""
    model = frequent_words(counts, frequent, clustered)
    model.end_count = rows.filter("training").count()
    bigrams = count_bigrams(rows, model)
    model.n_classes = max(1, min(classes, model.n_clustered))
    model.class_of = exchange_clustering(bigrams, model.n_clustered, classes)
    assigned = materialise(assign(rows, model, pairs_of(bigrams, model.class_of)), "word-classes")
    model.class_of_word = model.class_of[model.symbols]
    known = assigned.filter(F.col("n") >= model.least).select("word", "class").toArrow()  # frequent words only
    model.class_of_word[np.searchsorted(model.words, known.column("word").to_numpy().view(U64))] = known.column("class").to_numpy()
    return model, assigned


def lines(rows: DataFrame, model: Model) -> DataFrame:
    """The class of each word of a text: a frequent word's own, and -1 - length bin for the others. These
    are listed once a text (``rare``), with the place in the list of each of them (``places``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        base, log = np.log10(own.counts + 1.0), np.log10(np.maximum(own.counts, 1))
        for batch in batches:
            for i, j, data, starts in blocks(batch, "text"):
                n = j - i
                hashes, bins, first = word_block(data, starts)
                at, _ = own.look_up(hashes, bins)
                known = at >= 0
                per_word = np.zeros((3, len(hashes)))
                line = -1 - bins.astype(np.int16)
                if len(own.words):
                    per_word[0], per_word[1], per_word[2] = known, np.where(known, base[at], 0.0), np.where(known, log[at], 0.0)
                    line = np.where(known, own.class_of_word[at], line).astype(np.int16)
                sums = np.concatenate([np.zeros((3, 1)), np.cumsum(per_word, 1)], 1)
                n_frequent, base_sum, log_sum = sums[:, first[1:]] - sums[:, first[:-1]]
                rare = np.flatnonzero(~known)
                text_of = np.searchsorted(first, rare, "right") - 1
                order = np.lexsort((hashes[rare], text_of))
                words, owner = hashes[rare][order], text_of[order]
                fresh = np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]) if len(words) else np.zeros(0, bool)
                new = np.flatnonzero(fresh)
                offsets = np.searchsorted(owner[new], np.arange(n + 1))
                places = np.zeros(len(rare), np.int64)
                places[order] = np.cumsum(fresh) - 1 - offsets[owner]
                as_list = lambda o, v: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, n), batch.column(1).slice(i, n), batch.column(3).slice(i, n), pa.array(n_frequent.astype(np.int64)), pa.array(base_sum), pa.array(log_sum),
                        as_list(first, line), as_list(offsets, words[new].view(np.int64)), as_list(np.searchsorted(text_of, np.arange(n + 1)), places.astype(np.int32)),
                    ],
                    names=["doc_id", "training", "row", "n_known", "base", "log_n", "line", "rare", "places"],
                )

    schema = "doc_id long, training boolean, row long, n_known long, base double, log_n double, line array<short>, rare array<long>, places array<int>"
    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(look, schema)


def filled(found: DataFrame, assigned: DataFrame, model: Model) -> DataFrame:
    """``doc_id, training, n_known, base, log_n, line``: lines with the classes of the rare words; an unseen word keeps
    -1 - length bin."""
    rare = found.select("row", F.posexplode("rare").alias("k", "word"))
    seen = assigned.filter(F.col("n") < model.least)
    joined = rare.join(seen, "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("own"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_known, base, log_n = (batch.column(k).to_numpy().copy() for k in (1, 2, 3))
            line, places, own = batch.column(4), batch.column(5), batch.column(6)
            values = line.flatten().to_numpy().copy()
            first = np.concatenate([[0], np.cumsum(line.value_lengths().to_numpy())])
            for r in np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist():
                k, n, c = (x.to_numpy() for x in own[r].values.flatten())
                at = places[r].values.to_numpy()
                number, class_of = np.zeros(at.max() + 1), np.full(at.max() + 1, -1)
                number[k], class_of[k] = n, c
                text = values[first[r] : first[r + 1]]
                here = np.flatnonzero(text < 0)
                hit = class_of[at] >= 0
                text[here[hit]] = class_of[at][hit]
                n_known[r] += hit.sum()
                base[r] += np.log10(number[at][hit] + 1).sum()
                log_n[r] += np.log10(number[at][hit]).sum()
            offsets = pa.array(first.astype(np.int32))
            yield pa.record_batch([*batch.column(0).flatten(), pa.array(n_known), pa.array(base), pa.array(log_n), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["doc_id", "training", "n_known", "base", "log_n", "line"])

    both = found.drop("rare").join(joined, "row", "left").select(F.struct("doc_id", "training").alias("of"), "n_known", "base", "log_n", "line", "places", "own")
    return both.mapInArrow(fill, "doc_id long, training boolean, n_known long, base double, log_n double, line array<short>")


def class_lines(batch: pa.RecordBatch, column: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch with the end class after each text, and the number of words before each text."""
    line = batch.column(column)
    values = line.flatten().to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(line.value_lengths().to_numpy())])
    values = np.where(values < 0, n_classes - 1 - values, values)
    return np.insert(values, first[1:], n_classes + N_BINS), first


def class_bigrams(whole: DataFrame, n_classes: int) -> np.ndarray:
    """Counts of neighbouring classes in the training texts: induced ones, unseen ones by length, the end."""
    size = n_classes + N_BINS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for batch in batches:
            line, _ = class_lines(batch, 0, n_classes)
            if len(line):
                cells += np.bincount(np.concatenate([[size - 1], line[:-1]]) * size + line, minlength=size * size)
        used = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    table = whole.filter("training").select("line").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    out = np.zeros(size * size)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


def scored(whole: DataFrame, pairs: np.ndarray, n_classes: int, end_count: int) -> DataFrame:
    """``doc_id, training, n_tokens, n_known, base, score`` by the class model."""
    transition = np.log10((pairs + TRANSITION_SMOOTHING) / (pairs.sum(1, keepdims=True) + TRANSITION_SMOOTHING * len(pairs)))
    within = np.zeros(len(pairs))  # an unseen word and the end are alone in their classes
    within[:n_classes] = np.log10(np.maximum(pairs.sum(0)[:n_classes], 1))
    step = transition - within[None, :]
    end_base = float(np.log10(end_count + 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, first = class_lines(batch, 5, n_classes)
            sums = np.concatenate([[0.0], np.cumsum(step[np.concatenate([[len(step) - 1], line[:-1]]), line])])
            bounds = first + np.arange(len(first))
            own = sums[bounds[1:]] - sums[bounds[:-1]] + batch.column(4).to_numpy()
            base = batch.column(3).to_numpy() + end_base
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(first) + 1), batch.column(2), pa.array(base), pa.array(own)], names=["doc_id", "training", "n_tokens", "n_known", "base", "score"])

    return whole.mapInArrow(score, "doc_id long, training boolean, n_tokens long, n_known long, base double, score double")


def score(docs: DataFrame, frequent: int = 1 << 17, clustered: int = 2048, classes: int = 32) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row of
    ``docs(doc_id, text)``. ``base_score`` is the add-one unigram score, ``score`` the class model's log10
    probability."""
    rows = texts(docs)
    counts = materialise(count_words(rows), "word-counts")
    model, assigned = fit(rows, counts, frequent, clustered, classes)
    whole = materialise(filled(materialise(lines(rows, model), "lines"), assigned, model), "class-lines")
    found = scored(whole, class_bigrams(whole, model.n_classes), model.n_classes, model.end_count)
    n_known = F.col("n_known") + F.lit(int(model.end_count > 0))
    train_tokens = model.tokens + model.end_count
    distinct = model.distinct + int(model.end_count > 0)
    total = float(np.log10(train_tokens + distinct + 1.0))
    return found.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", n_known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
