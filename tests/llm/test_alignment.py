import bisect
import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from corpus import documents, empty, rows
from medialake.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "\t\t x", "a", " a", "a ", "  two  spaces   here    ", "line\n  indented\n\n\tTabs \t mixed \r\n end", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ mark", "x▁y z",
    "été naïve İ ﬁ ＡＢ", "你好世界 مرحبا \U0001f600\U0001f680 ‍ ​ ﻿ x", "  nbsp  　 wide ᠎ x   y", "a\x00b \x1c c \x85 d", "don't I'll we've 123 4567 89.10 $%^ &*()", "́ combining é x", "Z" * 3000, "ab" * 2000 + " " * 50 + "end" + " " * 9,
]


def by_force(texts):
    """Straight from the two libraries, whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}
    out, count = [], Counter()
    for text in texts:
        links, groups = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(letter[c] for c in a.id_to_token(k)) for k in x]
            yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                xs, ys = _places(xb), _places(yb)
                j = 0
                for i, (s, e) in enumerate(xs):
                    while ys[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(ys) and ys[k][0] < e:
                        links.append((x[i], y[k]))
                        k += 1
                ends = sorted({e for _, e in xs} & {e for _, e in ys})
                inside = lambda ids, spans: [",".join(str(k) for k, _ in own) for _, own in itertools.groupby(zip(ids, spans), lambda t: bisect.bisect_left(ends, t[1][1]))]
                groups = [f"{own}|{other}" for own, other in zip(inside(x, xs), inside(y, ys), strict=True)]
        out.append((links, groups, len(x) if links else 0, len(y) if links else 0))
        count.update(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(n_a, n_b, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if k else "") for k, g, n_a, n_b in out]


def _places(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def test_query_equals_both_libraries(spark, tmp_path):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(1000 + n, x[1]) for n, x in enumerate(rows())]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_alignment(spark, str(tmp_path)).collect()}
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for (k, text), want in zip(texts, by_force([t for _, t in texts]), strict=True):
        assert tuple(got[k][c] for c in columns) == want, (k, text and text[:60])


def test_chunks_and_whole_texts_agree(monkeypatch):
    own = alignment.pair(A, B)
    assert own.apart
    texts = [x[1] for x in rows()] + ODD
    cut = [own.a_packed(t) for t in texts if t]
    monkeypatch.setattr(own, "apart", False)
    assert cut == [own.a_packed(t) for t in texts if t]


def test_partial_counts_of_any_size_agree(spark):
    """Blocks, flushes and shards change nothing."""
    docs = documents(spark)
    counts = lambda df: sorted(map(tuple, alignment.pair_counts(alignment.encoded(df, A, B), A, B).collect()))
    want = counts(docs)
    own, by_one = alignment.pair(A, B), Counter()
    for _, text, *_ in rows():
        sides = [np.frombuffer(x[0], own.width) for x in own.encode([text or ""])]
        by_one.update(own.align(sides[0], np.array([0, len(sides[0])]), sides[1], np.array([0, len(sides[1])])).pairs.tolist())
    assert want == sorted(by_one.items()) and len(want) == len(by_one)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert want == counts(docs.repartition(9))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_partners(spark):
    counts = spark.createDataFrame([(1 << 32 | 5, 3), (2 << 32 | 5, 3), (3 << 32 | 5, 2), (9 << 32 | 6, 1)], "pair long, n long")
    assert sorted(map(tuple, alignment.best_partners(counts).collect())) == [(5, 3, [1, 2]), (6, 1, [9])]


@pytest.mark.parametrize("texts", [[], [None, ""], ["▁"]])
def test_tables_without_tokens(spark, texts):
    docs = spark.createDataFrame([(k, t, "g", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, pair long")
    got = alignment.align(docs, A, B).collect()
    assert len(got) == len(texts) and all(r["n_a"] == r["n_links"] == r["count_sum"] == 0 and r["groups"] == "" for r in got)
    assert alignment.align(empty(spark), A, B).collect() == []
