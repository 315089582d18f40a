import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import documents, empty, rows, words

import pyspark.sql.functions as F
from medialake.llm import near_dedup, repeats


def removed(texts):
    """Kept bytes and number of runs of each text, by looking at every window."""
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((bytes(b for b, g in zip(t, gone) if not g), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return out


@pytest.mark.parametrize("group", [128, 1])
def test_repeats(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    raw = [(r[1] or "").encode() for r in rows()]
    expected = Counter((r[0], len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()) for r, t, (kept, runs) in zip(rows(), raw, removed(raw)))
    assert Counter(tuple(r) for r in repeats.digest(documents(spark)).collect()) == expected


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1500)
    raw = [(r[1] or "").encode() for r in rows(3)]
    found = []
    for k, t in enumerate(raw):
        for begin, part, own in repeats.segments(np.frombuffer(t, np.uint8), np.array([0, len(t)])):
            got = repeats.anchors(part, own)
            if got is not None:
                for low, n in zip(got[1] + begin, got[2]):
                    found += [(k, p) for p in range(low, low + n)]
    assert sorted(found) == [(k, p) for k, t in enumerate(raw) for p in range(len(t) - 199)]


def test_repeats_of_long_texts_in_pieces(spark, monkeypatch):
    """Segments and pieces of contexts far smaller than the texts change nothing."""
    monkeypatch.setattr(repeats, "SEGMENT", 1500)
    long = max((r[1] or "" for r in rows(4)), key=len)
    more = [(950, long[500:] + "x" * 300), (951, long), (951, long), (952, long[:9000])]
    own = [(r[0], r[1]) for r in rows(4)] + more
    docs = spark.createDataFrame(own, "doc_id long, text string")
    raw = [(t or "").encode() for _, t in own]
    expected = Counter((k, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()) for (k, _), t, (kept, runs) in zip(own, raw, removed(raw)))
    assert Counter(tuple(r) for r in repeats.digest(docs).collect()) == expected


@pytest.mark.parametrize("shared, stays", [(90, False), (140, False), (199, True), (260, True)])
def test_rounds_drop_what_is_unique(spark, monkeypatch, shared, stays):
    """Contexts that share their anchor, but no 150 bytes, leave before windows are named."""
    r = np.random.default_rng(shared)
    noise = lambda n: bytes(r.integers(33, 127, n, dtype=np.uint8)).decode()
    passages = [noise(shared) for _ in range(12)]
    own = [(k, noise(400) + passages[k // 3] + noise(400)) for k in range(36)]
    counted, real = {}, repeats.alive

    def watched(contexts):
        left = real(contexts)
        counted.update(opened=contexts.count(), left=left.count())
        return left

    monkeypatch.setattr(repeats, "alive", watched)
    raw = [t.encode() for _, t in own]
    expected = Counter((k, len(t) - len(kept), runs) for (k, _), t, (kept, runs) in zip(own, raw, removed(raw)))
    got = repeats.digest(spark.createDataFrame(own, "doc_id long, text string"))
    assert Counter((x.doc_id, x.n_removed, x.n_spans) for x in got.collect()) == expected
    assert counted["opened"] > 0 and (counted["left"] > 0) == stays


def test_remove_repeats_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = repeats.remove_repeats(docs)
    assert out.schema == docs.schema
    raw = [(r[1] or "").encode() for r in rows()]
    expected = Counter((r[0], None if r[1] is None else kept.decode(errors="ignore"), r[6]) for r, (kept, _) in zip(rows(), removed(raw)))
    assert Counter((r.doc_id, r.text, r.spans) for r in out.collect()) == expected


def test_repeats_empty(spark):
    assert repeats.digest(empty(spark)).count() == 0
    assert repeats.remove_repeats(empty(spark)).count() == 0


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(found):
    """The least id of each row's class, by comparing all pairs."""
    bags = [bag(r[1]) for r in found]
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(found)):
        members[root(i)].append(i)
    out = Counter()
    for own in members.values():
        ids = [found[i][0] for i in own if found[i][0] is not None]
        for i in own:
            out[(found[i][0], min(ids, default=None), len(own))] += 1
    return out


@pytest.mark.parametrize("seed, rounds, block", [(1, 3, 512), (5, 3, 512), (1, 1, 3), (5, 2, 3)])
def test_near_duplicates(spark, monkeypatch, seed, rounds, block):
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    assert Counter(tuple(r) for r in near_dedup.digest(documents(spark, seed)).collect()) == classes(rows(seed))


def test_drop_near_duplicates(spark):
    docs = documents(spark)
    out = near_dedup.drop_near_duplicates(docs)
    assert out.schema == docs.schema
    got = Counter(r.doc_id for r in out.collect())
    expected = Counter({c for d, c, n in classes(rows()) if d == c})
    assert got == expected


def test_near_empty(spark):
    assert near_dedup.digest(empty(spark)).count() == 0
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    common = rng.integers(1, 1 << 62, 300, dtype=np.int64).view(np.uint64)
    counts = rng.integers(1, 20, 300)
    other = np.where(rng.random(300) < 0.3, np.maximum(1, counts // 2), counts)
    truth = np.minimum(counts, other).sum() / np.maximum(counts, other).sum()
    owner = np.repeat([0, 1], 300)
    got = near_dedup.signatures(owner, np.concatenate([common, common]), np.concatenate([counts, other]), 2)
    assert abs((got[0] == got[1]).mean() - truth) < 0.1
    again = near_dedup.signatures(np.zeros(300, int), common, counts, 1)
    assert (again[0] == got[0]).all()  # whatever else is in the block


@pytest.mark.parametrize("n", [1, 3, 17, 60, 400, 5000])
def test_signature_of_any_size_is_full(n):
    hashes = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = near_dedup.signatures(np.zeros(n, int), hashes, np.ones(n, int), 1)
    assert np.isfinite(got.view(float)).all()


def test_long_pairs_at_the_threshold(spark):
    n = 360_000  # shingles a text; two texts shifted by n / 9 words have a similarity of exactly 0.8
    text = lambda low: " ".join(f"{k:x}" for k in range(low, low + n + 4))
    docs = spark.createDataFrame([(1, text(0)), (2, text(n // 9)), (3, text(n // 9 + n // 9 + 1))], "doc_id long, text string")
    described = near_dedup.describe(docs).select("doc_id", F.col("bag").alias("node"), "key", "check").collect()
    of = {r.node: r.doc_id for r in described}
    wanted = spark.createDataFrame([(r.node, r.key, r.check) for r in described], "node long, key long, check long")
    sets = near_dedup.shingle_sets(docs, wanted).collect()
    assert all(len(set(r.shingles)) == n for r in sets)
    node = {v: k for k, v in of.items()}
    pairs = spark.createDataFrame([(node[a], node[b]) for a, b in ((1, 2), (2, 3), (1, 3))], "a long, b long")
    all_sets = spark.createDataFrame(sets, "node long, shingles array<long>")
    with_b = pairs.join(all_sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    near = near_dedup.compared(with_b, all_sets, 0.8).collect()
    assert [{of[r.a], of[r.b]} for r in near] == [{1, 2}]
    arrays = {of[r.node]: np.sort(np.array(r.shingles)) for r in sets}
    none = np.zeros((3, near_dedup.SKETCH_WORDS), np.uint64)
    a, b = near_dedup.spanning_links(np.full(3, n), none, np.arange(3), None, [arrays[k] for k in (1, 2, 3)], 0.8)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 1)]


@pytest.mark.parametrize("two_sides", [False, True])
def test_spanning_links_join_what_all_pairs_join(two_sides):
    rng = np.random.default_rng(5)
    base = [rng.choice(1 << 40, 60, replace=False) for _ in range(12)]
    sets = []
    for k in range(150):  # chains of slowly changing sets, so that not all of a class are similar to each other
        own = base[k % 12].copy()
        own[: rng.integers(0, 14)] = rng.choice(1 << 40, 1)[0] + np.arange(1)
        sets.append(np.unique(np.concatenate([own, rng.choice(1 << 40, rng.integers(0, 6))])))
    sizes, side = np.array([len(x) for x in sets]), rng.integers(0, 2, 150) if two_sides else None
    start = rng.integers(0, 130, 150)  # some are joined already
    none = np.zeros((150, near_dedup.SKETCH_WORDS), np.uint64)

    def joined(pairs):
        own = {int(c): int(c) for c in start}
        find = lambda x: x if own[x] == x else find(own[x])
        for i, j in pairs:
            own[find(int(start[i]))] = find(int(start[j]))
        return [find(int(c)) for c in start]

    def similar(i, j):
        common = len(np.intersect1d(sets[i], sets[j]))
        return common >= 0.8 * (sizes[i] + sizes[j] - common)

    pairs = [(i, j) for i in range(150) for j in range(i) if (side is None or side[i] != side[j]) and similar(i, j)]
    a, b = near_dedup.spanning_links(sizes, none, start, side, sets, 0.8)
    assert 0 < len(a) < 150 and len(a) < len(pairs) and all(similar(i, j) for i, j in zip(a, b))
    one, other = joined(pairs), joined(zip(a, b))
    assert len(set(zip(one, other))) == len(set(one)) == len(set(other))


def test_blocks_return_fewer_pairs_than_nodes(spark):
    """Two thousand similar texts in one bucket give a forest, not two million pairs."""
    n = 2000
    base = list(range(100, 140))
    members = spark.createDataFrame([(7, k, 1, 40, (0,) * near_dedup.SKETCH_WORDS, k) for k in range(n)], f"bucket long, node long, degree long, size long, sketch {near_dedup.SKETCH}, component long")
    sets = spark.createDataFrame([(k, [*base[:39], 1000 + k]) for k in range(n)], "node long, shingles array<long>")
    links = [(r.a, r.b) for r in near_dedup.compare_in_blocks(members, sets, 0.8).collect()]
    blocks = -(-n // near_dedup.BLOCK_ROWS)
    assert n - 1 <= len(links) <= blocks * n
    own = list(range(n))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[find(a)] = find(b)
    assert len({find(x) for x in range(n)}) == 1


def test_prefix_groups_keep_every_similar_pair(spark):
    """Two similar sets of one bucket share a group; families that are alike below the threshold make none."""
    r = random.Random(3)
    base = list(range(200))
    sets = {k: sorted({*r.sample(base, r.randint(120, 200)), *(1000 * k + i for i in range(r.randint(0, 40)))}) for k in range(1, 41)}
    sets |= {k: sorted({*base[:150], *(1000 * k + i for i in range(40))}) for k in range(101, 121)}  # 150 of 230: below
    rows = [(b, k, 1, len(v), [0] * 7, k) for k, v in sets.items() for b in ((1, 2) if k % 3 else (2,))]
    members = spark.createDataFrame(rows, "bucket long, node long, degree long, size long, sketch array<long>, component long")
    own = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    got = near_dedup.prefix_groups(members, own, 0.8)
    assert got.columns == members.columns
    groups = {}
    for x in got.select("bucket", "node").collect():
        groups.setdefault(x["bucket"], set()).add(x["node"])
    similar = [(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    assert len(similar) > 20
    for a, b in similar:
        assert any(a in g and b in g for g in groups.values()), (a, b)
    alone = near_dedup.prefix_groups(members.filter("node > 100"), own, 0.8)
    assert alone.isEmpty()
