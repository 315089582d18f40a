import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
from corpus import documents, empty, rows
from tokenizers import Tokenizer

from medialake.llm import packing, token_output
from medialake.llm.common import work_path
from medialake.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library):
    own = Encoder(VOCABULARY)
    assert own.by_chunk
    odd = ["", " ", "a\x01b", "<|endoftext|> x<|ENDOFTEXT|>", "It's DON'T we'll", "é É ﬁ ½ ３ Σς İ ß", "q\x85r \x1c  z ​", "...,, !?a.b,c; (x), y).", "日本語 テスト 🎉🎉", "ÀÈ ÿŸ ñ,", "\r\n\t\v\fz"]
    r = random.Random(2)
    odd += ["".join(r.choice("aZé.,' \ń<|>1ßΣ\x1f") for _ in range(200)) for _ in range(300)]
    assert [np.frombuffer(p, "<u4").tolist() for p in own.packed([t.encode() for t in odd])] == [ids_of(library, t) for t in odd]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_encoder_other_vocabulary(name):
    path = public_tokenizers.path(name)
    own, other = Encoder(path), Tokenizer.from_file(path)
    assert not own.by_chunk
    text = "Some  text,\n with ünïcode."
    assert np.frombuffer(own.packed([text.encode()])[0], "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, window):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            best = min(fits, key=lambda k: free[k])
            free[best] -= n
        else:
            free.append(window - n)
    return sorted(free)


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_equals_one_by_one(seed):
    r = random.Random(seed)
    window = r.choice([7, 16, 50, 100])
    lengths = [r.randint(1, window) for _ in range(r.randint(0, 120))]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    runs, opened = packing.best_fit_decreasing(dict(histogram), window)
    used = defaultdict(list)
    for length, own in runs.items():
        for k, run in enumerate(own):
            end = own[k + 1].first if k + 1 < len(own) else histogram[length]
            for i in range(run.first, end):
                used[run.window + i - run.first].append((run.offset, length))
    left = []
    for k in range(opened):
        at = 0
        for offset, length in sorted(used[k]):
            assert offset == at
            at += length
        assert 0 < at <= window
        left.append(window - at)
    assert sorted(left) == plain_best_fit(lengths, window)


def test_packing(spark, library):
    found = packing.pack(documents(spark), VOCABULARY, window=64).collect()
    expected = defaultdict(int)
    for row in rows():
        ids = ids_of(library, row[1]) + [1]
        for start in range(0, len(ids), 64):
            expected[(row[0], start, len(ids[start : start + 64]), crc(ids[start : start + 64]), len(ids))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for p in found:
        got[(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)] += 1
        places[p.sequence_id].append((p.offset, p.length))
    assert got == expected
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(p.length for p in found)
    assert len(places) <= total / 64 * 1.02 + 1
    assert sorted(places) == list(range(len(places)))


def test_token_sequences(spark, library):
    """Of rows with repeated and null ids and of a text longer than a window, every id is in its place."""
    window = 64
    packed = packing.pack(documents(spark), VOCABULARY, window=window, with_ids=True).cache()
    filled = packing.token_sequences(packed, window).collect()
    by = {r.sequence_id: r.ids for r in filled}
    used = Counter()
    for p in packed.collect():
        assert crc(by[p.sequence_id][p.offset : p.offset + p.length]) == p.ids_crc32
        used[p.sequence_id] += p.length
    assert len(by) == len(filled) == len(used)
    assert all(len(ids) == window and not any(ids[used[k] :]) for k, ids in by.items())
    got = Counter(t for k, ids in by.items() for t in ids[: used[k]])
    assert got == Counter(t for r in rows() for t in [*ids_of(library, r[1]), 1])


def test_packing_empty(spark):
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_token_output_round_trip(spark, library):
    path = work_path(spark, "test-ids")
    token_output.write_token_ids(documents(spark), path, VOCABULARY)
    back = token_output.read_token_ids(spark, path)
    stored = sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in back.collect())
    assert stored == sorted((-1 if r[0] is None else r[0], tuple([*ids_of(library, r[1]), 2])) for r in rows())
    at, before = 0, -1
    for r in sorted(token_output.digests(back).collect(), key=lambda r: r.start):
        doc = -1 if r.doc_id is None else r.doc_id
        assert doc >= before and r.start == at
        at, before = at + r.n_tokens, doc
    assert back.filter("doc_id = 7").count() == 1


def test_start_is_where_the_ids_lie(spark, library):
    """Rows that share an id have different starts, and the files hold their ids there."""
    docs = spark.createDataFrame([(5, t) for t in ("one", "two words", "three words here", "and a much longer text " * 20, None)] + [(None, "x"), (None, "y y")], "doc_id long, text string")
    path = work_path(spark, "test-ids")
    token_output.write_token_ids(docs.repartition(3), path, VOCABULARY)
    back = token_output.read_token_ids(spark, path).select("*", "_metadata.file_name").collect()
    line = [i for r in sorted(back, key=lambda r: (r.file_name, r.row)) for i in r.ids]
    found = token_output.digests(token_output.read_token_ids(spark, path)).collect()
    assert sorted(r.doc_id is None for r in found) == [False] * 5 + [True] * 2
    for r in found:
        assert crc(line[r.start : r.start + r.n_tokens]) == r.ids_crc32


def test_stripes_have_row_indexes_and_bloom_filters(spark):
    """The files' footers name both, and a reader that looks for one document skips the others' rows."""
    docs = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text")).coalesce(1)
    path = work_path(spark, "test-stripes")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_output.write_token_ids(docs, path, VOCABULARY)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getNumberOfRows() == 40_000 and reader.getRowIndexStride() == 1000
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = Counter(stripe.getStreams(k).getKind().toString() for k in range(stripe.getStreamsCount()))
    assert kinds["ROW_INDEX"] >= 1 and kinds["BLOOM_FILTER_UTF8"] == 1
    assert all(stripe.getColumns(k).getKind().toString() == "DIRECT_V2" for k in range(1, 5))  # run-length encoded
    one = token_output.read_token_ids(spark, path).filter("doc_id = 12345")
    assert one.count() == 1
    scan = one.select("doc_id", "row")
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan()
    read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert read <= 2000


def test_token_output_empty(spark):
    assert token_output.token_output(empty(spark), VOCABULARY).count() == 0


def test_a_full_memo_is_small():
    """Each Python worker keeps one beside its JVM's heap."""
    import sys

    from medialake.llm import tokens

    memo = {b"%09d," % i: bytes(12) for i in range(tokens.MEMO_ENTRIES)}
    assert sys.getsizeof(memo) + sum(sys.getsizeof(x) for pair in memo.items() for x in pair) < 100 << 20
