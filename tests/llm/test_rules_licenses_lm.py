import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import regex
from corpus import BLANK_WORD, LOWER, WORD, documents, empty, rows, words

from medialake.llm import decontamination, licenses, lm_scoring, quality
from medialake.llm.sql import licenses_sql

SPECIAL = regex.compile(r"[^\p{L}\p{N}\x20\x09-\x0D]")
BENCHMARK = "item_id long, text string"


def counts_of(text):
    text = text or ""
    w = BLANK_WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if BLANK_WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    found = quality.quality(documents(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    expected = Counter()
    for r in rows():
        c = counts_of(r[1])
        expected[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == expected
    assert not any(r.kept and r.base_failed for r in found)
    clean = [r for r in found if r.n_words > 100 and r.n_repeat_words == 0 and r.n_dup_lines == 0]
    assert clean and all(r.kept for r in clean)


def test_filter_documents(spark):
    docs = documents(spark)
    out = quality.filter_documents(docs)
    assert out.schema == docs.schema
    kept = Counter(r.doc_id for r in quality.quality(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in out.collect()) == kept
    assert quality.filter_documents(empty(spark)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    r = random.Random(4)
    n, on_good, on_bad = len(quality.RULES), 0.95, 0.7
    patterns = Counter()
    for _ in range(20000):
        good = r.random() < 0.8
        votes = ""
        for _ in range(n):
            if r.random() < 0.2:
                votes += "0"
            else:
                right = r.random() < (on_good if good else on_bad)
                votes += "+" if right == good else "-"
        patterns[votes] += 1
    model = quality.expectation_maximisation(patterns)
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(a - on_good) < 0.03 for a in model.on_good) and all(abs(a - on_bad) < 0.05 for a in model.on_bad)
    assert quality.expectation_maximisation({}).prior == 0.8


def test_rules_that_see_different_kinds_of_bad_texts():
    """Two kinds of bad texts, each seen by two rules that all others take for good: both are found, and a lone bad vote
    of a rule that errs now and then is not enough."""
    n, patterns = len(quality.RULES), Counter({"+" * len(quality.RULES): 8000})
    vote = lambda *bad: "".join("-" if j in bad else "+" for j in range(n))
    patterns += Counter({vote(1, 6): 600, vote(3, 7): 600, vote(0): 400, vote(2): 5})
    model = quality.expectation_maximisation(patterns)
    assert model.posterior(vote(1, 6)) < 0.01 and model.posterior(vote(3, 7)) < 0.01 and model.posterior(vote(0)) > 0.9 and model.posterior(vote()) > 0.9
    assert all(a + b >= 1.0009 for a, b in zip(model.on_good, model.on_bad))


LICENSED = [
    "Released under the MIT License. mit license, MIT-license!", "CC BY CC BY-NC 4.0 cc by", "the GNU General Public License, version 3.", "GNU general public licence", "Apache License, Version 2.0",
    "apache", None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit  LICENSE xK mit_license mité license",
]


def license_report(text, frequency):
    """What the scan of a text has to give, by trying every pair of hits and every place."""
    w = words(text)
    get = lambda i: w[i] if 0 <= i < len(w) else None
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    near = range(-licenses.SLACK, licenses.SLACK + 1)

    def stands(begin, key):
        same = [get(begin + i) == x for i, x in enumerate(key.split())]
        return same.count(False) <= 1 and all(same[i] for i, x in enumerate(key.split()) if len(same) < licenses.DAMAGED_FROM or x.isdigit() or x in licenses.NAMES)

    places = sorted(i for p in licenses.BASE.values() for i in at(p))
    base, met, share = {k for k, p in licenses.BASE.items() if at(p)}, set(), 0.0
    for t in licenses.TEMPLATES:
        rare = set()
        for own, offset, most in ((t.words, 0, max(2, len(t.words) // 20)), (t.keys[0].split(), t.places[0], 2)):
            rare |= {(x, offset + own.index(x)) for x in sorted(set(own), key=lambda x: (frequency[x], own.index(x)))[:most]}
        hits = {(x, i - p) for i, x in enumerate(w) for y, p in rare if x == y}
        for s in {s for x, s in hits if any(y != x and abs(s - o) <= licenses.SLACK for y, o in hits)}:
            if all(any(stands(s + a + d, k) for d in near) for k, a in zip(t.keys, t.places)):
                met.add(t.label)
                share = max(share, sum(any(get(s + k + d) == x for d in near) for k, x in enumerate(t.words)) / len(t.words))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), max(share, licenses.MENTION if base else 0.0)


def license_texts():
    r, out = random.Random(8), [*LICENSED, LICENSED[0]]
    out += ["GNU General Public License. " + "and more words " * 200 + "Python version 3", "version 3", "the GNU General Public License (GPL for short) version 3", "GNU General Public License a b c d version 3"]
    for t in licenses.TEMPLATES:
        w = t.words
        changed = [x if r.random() < 0.9 else "other" for x in w]
        out += [t.text, "Copyright (c) A. B.\n" + t.text.upper() + " end", " ".join(changed), " ".join(w[len(w) // 3 :]), " ".join(w[: len(w) // 2]), " ".join(w[:9] + ["1", "2"] + w[9:])]
    out.append((" filler" * 300).join(t.text for t in licenses.TEMPLATES) + " cc by" * 3000)  # one long text with all of them
    return out


def test_licenses(spark):
    texts = license_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    found = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    frequency = Counter(x for t in texts for x in set(words(t)))
    assert [found[k] for k in range(len(texts))] == [license_report(t, frequency) for t in texts]
    far = [k for k, t in enumerate(texts) if t and "Python" in t]
    assert [found[k][5] for k in far] == ["gpl"] and found[far[0] + 1][5:] == ("", 0.0)  # a distant or lone version labels nothing
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_with_damage(spark):
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit-text")
    apache = max((t for t in licenses.TEMPLATES if t.label == "apache-2.0"), key=lambda t: len(t.words))
    notice = lambda label: max((t for t in licenses.TEMPLATES if t.label == label), key=lambda t: len(t.words)).text
    w = mit.words
    texts = [
        mit.text, mit.text.replace("person obtaining", "human obtaining"), apache.text.replace("apache license", "apache licence", 1), " ".join(w[:16] + ["hereinafter"] + w[16:]), " ".join(w[:30] + w[31:]),
        mit.keys[0], notice("gpl-3.0"), notice("agpl-3.0"), notice("gpl-2.0"), "licensed under the gnu lesser general public license", "licensed under cc by 3 0", "nothing of the kind",
    ]
    found = [(r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [labels for labels, _ in found] == ["mit-text", "mit-text", "apache-2.0", "mit-text", "mit-text", "mit-text", "gpl,gpl-3.0", "agpl-3.0", "gpl,gpl-2.0", "lgpl", "cc-by", ""]
    scores = [score for _, score in found]
    assert scores[0] == 1.0 and min(scores[:5]) > 0.95 and 0 < scores[5] < 0.3 and scores[10:] == [licenses.MENTION, 0.0]


def test_licenses_oracle(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(license_texts())), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    out = licenses.scan(docs)
    assert Counter(tuple(r) for r in out.collect()) == Counter(db.sql(licenses_sql()).select(*out.columns).fetchall())


def label_model(votes, rounds=100, prior=0.8, on_good=0.95, on_bad=0.3, weight=10.0):
    """Expectation maximisation by definition, over a list of votes: the posterior of each."""
    n = len(votes[0])
    p_good, right_good, right_bad = prior, [on_good] * n, [on_bad] * n

    def posterior(v):
        good, bad = p_good, 1 - p_good
        for x, a, b in zip(v, right_good, right_bad):
            good *= {"+": a, "-": 1 - a, "0": 1}[x]
            bad *= {"+": 1 - b, "-": b, "0": 1}[x]
        return good / (good + bad)

    for _ in range(rounds):
        q = [posterior(v) for v in votes]
        next_good, next_bad = [], []
        for j in range(n):
            cast = [(p, v[j]) for p, v in zip(q, votes) if v[j] != "0"]
            good = min(0.999, max(0.501, (weight * on_good + sum(p for p, x in cast if x == "+")) / (weight + sum(p for p, _ in cast))))
            next_good.append(good)
            next_bad.append(min(0.999, max(1.001 - good, (weight * on_bad + sum(1 - p for p, x in cast if x == "-")) / (weight + sum(1 - p for p, _ in cast)))))
        p_good = min(0.999, max(0.5, (sum(q) + weight * prior) / (len(votes) + weight)))
        right_good, right_bad = next_good, next_bad
    return [posterior(v) for v in votes]


def vote(counts):
    """The rules' votes, from the counts of a text, spelled out anew."""
    n, chars, symbols, dup, repeat, lines, digits, distinct, special = counts
    rules = [
        (n < 20, n >= 50), (100 * repeat > 30 * n, 100 * repeat <= 5 * n), (chars < 2 * n or chars > 15 * n, 3 * n <= chars <= 10 * n), (10 * symbols > n, 100 * symbols <= n),
        (100 * dup > 30 * lines, 100 * dup <= 10 * lines), (4 * digits > chars, 20 * digits <= chars), (n >= 100 and 10 * distinct < n, n >= 20 and 5 * distinct >= n),
        (100 * special > 10 * chars, 100 * special <= 6 * chars),
    ]
    return "".join("-" if bad else "+" if good else "0" for bad, good in rules)


def test_quality_verdicts(spark):
    found = quality.quality(documents(spark)).collect()
    own = []
    for r in rows():
        w = [x for x in BLANK_WORD.findall(r[1] or "")]
        lines = [x for x in (r[1] or "").split("\n") if BLANK_WORD.search(x)]
        covered, seen = set(), Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(covered), len(lines), sum(c in "0123456789" for c in r[1] or ""), len(set(w)), len(SPECIAL.findall(r[1] or "")))
        own.append((r[0], vote(counts), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    expected = Counter((k, v, failed, round(p, 9), not failed and p >= 0.5) for (k, v, failed), p in zip(own, label_model([v for _, v, _ in own])))
    assert Counter((r.doc_id, r.votes, r.base_failed, round(r.probability, 9), r.kept) for r in found) == expected
    assert len({r.kept for r in found}) == 2


def test_lm_scoring(spark):
    found = lm_scoring.score(documents(spark), frequent=100, clustered=30, classes=6).collect()
    tokens = [[*BLANK_WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows()]
    out = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
    c = Counter(t for r, own in zip(rows(), tokens) if not out(r) for t in own)
    n, v = sum(c.values()), len(c)
    expected = Counter((r[0], out(r), len(own), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), 6)) for r, own in zip(rows(), tokens))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)


def test_class_model_beats_its_start(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = [list(range(0, 10)), list(range(10, 20)), list(range(20, 30))]
    bigrams = np.zeros((31, 31), np.int64)
    for _ in range(20000):  # words of group g are followed by words of group g + 1
        g = rng.integers(3)
        bigrams[rng.choice(groups[g]), rng.choice(groups[(g + 1) % 3])] += 1
    classes = lm_scoring.exchange_clustering(bigrams, 30, 3)
    assert all(len({classes[w] for w in g}) == 1 for g in groups) and len({classes[g[0]] for g in groups}) == 3


def test_lm_without_training_text(spark):
    docs = documents(spark).filter("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    found = lm_scoring.score(docs).collect()
    assert found and all(r.n_known == 0 and r.train_tokens == 0 for r in found)
    assert lm_scoring.score(empty(spark)).count() == 0


def items(seed=1):
    found = [words(r[1]) for r in rows(seed) if len(words(r[1])) > 40][:6]
    out = [(k, " ".join(w[k : k + 25])) for k, w in enumerate(found)]
    return [*out, (50, "one two three"), (51, ""), (52, None), (None, out[0][1]), (53, out[1][1]), (53, "ab ab ab ab ab ab ab ab ab ab ab"), (54, "no such words here at all in any of the texts")]


@pytest.mark.parametrize("block", [500_000, 7])
def test_contamination(spark, block):
    found = decontamination.digest(decontamination.contamination(documents(spark), spark.createDataFrame(items(), BENCHMARK), block_windows=block)).collect()
    import hashlib

    expected = Counter()
    for r in rows():
        w = words(r[1])
        hit, met = set(), set()
        for item, text in items():
            own = words(text)
            if item is None or not own:
                continue
            size = min(10, len(own))
            for k in range(len(own) - size + 1):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == own[k : k + size]:
                        hit.update(range(i, i + size))
                        met.add(str(item))
        expected[(r[0], len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == expected


def test_decontaminate(spark):
    docs, benchmark = documents(spark), spark.createDataFrame(items(), BENCHMARK)
    out = decontamination.decontaminate(docs, benchmark)
    assert out.schema == docs.schema
    again = decontamination.digest(decontamination.contamination(out, benchmark)).collect()
    assert not any(r.contaminated for r in again)
    before = {r.doc_id: r for r in decontamination.digest(decontamination.contamination(docs, benchmark)).collect()}
    left = {r.doc_id: r.text for r in out.collect()}
    texts = {r[0]: r[1] for r in rows()}
    assert all(left[k] == texts[k] for k, r in before.items() if not r.contaminated)
    assert all(k in left for k, r in before.items() if r.n_hit <= 0.5 * r.n_words)
    assert decontamination.decontaminate(empty(spark), benchmark).count() == 0
    assert decontamination.contamination(docs, spark.createDataFrame([], BENCHMARK)).filter("n_hit > 0").count() == 0


def decontaminated(text, windows):
    """One text as decontaminate leaves it, by brute force; None if it goes."""
    first = True
    while True:
        found = list(re.finditer(WORD, (text or "").translate(LOWER)))
        w, hit = [m.group() for m in found], set()
        for own in windows:
            for i in range(len(w) - len(own) + 1):
                if w[i : i + len(own)] == own:
                    hit.update(range(i, i + len(own)))
        if first and len(hit) > 0.5 * len(w):
            return None
        if not hit:
            return text
        for last in sorted((k for k in hit if k + 1 not in hit), reverse=True):
            start = last
            while start - 1 in hit:
                start -= 1
            text = text[: found[start].start()] + "\n" + text[found[last].end() :]
        first = False


def windows_of(benchmark):
    own = [words(text) for _, text in benchmark]
    return [w[k : k + min(10, len(w))] for w in own if w for k in range(len(w) - min(10, len(w)) + 1)]


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontaminate_does_not_depend_on_blocks(spark, block):
    item = [[f"{c}{k}" for k in range(30)] for c in "pqr"]
    own = lambda n: [f"own{k}" for k in range(n)]
    texts = [
        [*item[0], *own(20), *item[1], *own(20)],  # 30 % and 30 % of its words: goes
        [*own(40), *item[0][:20], *own(40)],  # an item cut at the border of two blocks
        [*own(60), *item[0][:10], *item[0][3:13], *own(30)],
        [*own(40), *item[2][:5], *item[0], *item[2][5:12], *own(40)],  # a cut brings words together
        [*own(60), *item[1][20:30], "p0", "p1", *own(30)],
    ]
    benchmark = [(k, " ".join(w)) for k, w in enumerate(item)] + [(9, " ".join([*item[1][25:], *item[0][:8]])), (10, "own5 own6 own7")]
    more = [(1000 + k, " ".join(t), "en", None, None, None, None, None, None, None) for k, t in enumerate(texts)] * 2
    docs = documents(spark).unionByName(spark.createDataFrame(more, documents(spark).schema))
    benchmark += [x for x in items() if x[0] is not None]
    out = decontamination.decontaminate(docs, spark.createDataFrame(benchmark, BENCHMARK), block_windows=block)
    assert out.schema == docs.schema
    expected = Counter((*r[:1], left, *r[2:]) for r in [*rows(), *more] if (left := decontaminated(r[1], windows_of(benchmark))) is not None or r[1] is None)
    assert Counter(tuple(r) for r in out.collect()) == expected
    assert not any(r[0] == 1000 for r in expected) and any(r[0] == 1001 for r in expected)


@pytest.mark.parametrize("block", [500_000, 3])
def test_items_without_id_are_hit_and_cut(spark, block):
    own, other = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    before, after = " ".join(f"x{k}" for k in range(20)), " ".join(f"y{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"{before} {own} {after}"), (2, own), (3, f"{before} {other} {after} {own}"), (4, before)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, own), (7, other)], BENCHMARK)
    found = decontamination.contamination(docs, benchmark, block_windows=block).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found} == {1: (12, []), 2: (12, []), 3: (24, ["7"]), 4: (0, [])}
    assert {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark, block_windows=block).collect()} == {1: f"{before} \n {after}", 3: f"{before} \n {after} \n", 4: before}


def fingerprint(word):
    import numpy as np
    from medialake.llm.wordhash import NOT_BLANK, word_table

    data = word.encode()
    return int(word_table(np.frombuffer(data, np.uint8), np.array([0, len(data)]), NOT_BLANK)[2].view(np.int64)[0])


@pytest.mark.parametrize("frequent", [100, 8])
def test_every_training_word_has_an_induced_class(spark, frequent):
    clustered, n_classes = 30, 6
    docs = documents(spark)
    out = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
    tokens = [(r, BLANK_WORD.findall((r[1] or "").translate(LOWER))) for r in rows()]
    training = [own for r, own in tokens if not out(r)]
    c = Counter(w for own in training for w in own)
    texts = lm_scoring.texts(docs)
    model, assigned = lm_scoring.fit(texts, lm_scoring.count_words(texts), frequent, clustered, n_classes)
    n_classes = model.n_classes
    of = {fingerprint(w): w for w in c}
    seed = {of[int(w)]: int(model.class_of[s]) for w, s in zip(model.words.view("int64"), model.symbols) if s < model.n_clustered}
    found = {of[r.word]: (r.n, r["class"]) for r in assigned.collect()}
    assert set(found) == set(c) - set(seed) and all(n == c[w] for w, (n, _) in found.items())

    # each word has the class that gives the class bigrams the greatest likelihood, all others left as they were
    held = {of[int(w)] for w in model.words.view("int64")}
    bin_of = lambda w: sum(len(w.encode()) > k for k in (3, 6, 9, 13))
    kind = lambda w: seed.get(w, ("frequent" if w in held else "rare", bin_of(w)))
    pairs, beside = Counter(), {w: Counter() for w in found}
    for own in training:
        for a, b in zip(["end", *map(kind, own)], [*map(kind, own), "end"]):
            pairs[a, b] += 1
        line = ["end", *map(kind, own), "end"]
        for i, w in enumerate(own):
            if w in found:
                beside[w][line[i], None] += 1
                beside[w][None, line[i + 2]] += 1
    g = lambda x: x * math.log(x) if x else 0.0
    before, after = Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n

    def gain(w, k):
        new = Counter()
        for (a, b), n in beside[w].items():
            new[k if a is None else a, k if b is None else b] += n
        return sum(g(pairs[p] + n) - g(pairs[p]) for p, n in new.items()) - sum(g(t[k] + c[w]) - g(t[k]) for t in (before, after))

    for w, (_, k) in found.items():
        assert gain(w, k) >= max(gain(w, x) for x in range(n_classes)) - 1e-6

    # the score, by a plain class model over these classes
    class_of = lambda w: seed[w] if w in seed else found[w][1] if w in found else ("unseen", bin_of(w))
    steps, totals, into = Counter(), Counter(), Counter()
    for own in training:
        line = [*map(class_of, own), "end"]
        for a, b in zip(["end", *line], line):
            steps[a, b] += 1
            totals[a] += 1
            into[b] += 1
    expected = Counter()
    for r, own in tokens:
        total, last = 0.0, "end"
        for w in [*own, None]:
            k = "end" if w is None else class_of(w)
            total += math.log10((steps[last, k] + 0.5) / (totals[last] + 0.5 * (n_classes + 6))) + (math.log10(c[w] / into[k]) if w in c else 0)
            last = k
        expected[r[0], round(total, 5)] += 1
    got = lm_scoring.score(docs, frequent=frequent, clustered=clustered, classes=6)
    assert Counter((r.doc_id, round(r.score, 5)) for r in got.collect()) == expected


def test_exchange_clustering_ends_in_a_local_optimum():
    import numpy as np

    bigrams = np.random.default_rng(5).poisson(2.0, (61, 61))
    g = lambda x: float((x * np.log(np.maximum(x, 1))).sum())

    def likelihood(class_of):
        pairs = lm_scoring.pairs_of(bigrams, class_of)
        return g(pairs) - g(pairs.sum(0)) - g(pairs.sum(1))

    classes = lm_scoring.exchange_clustering(bigrams, 60, 6)
    best = likelihood(classes)
    for w in range(60):
        for k in range(6):
            moved = classes.copy()
            moved[w] = k
            assert likelihood(moved) <= best + 1e-6
