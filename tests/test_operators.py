import datetime as dt
import json
import random
import sqlite3

import pyspark.sql.functions as F
import pytest

from medialake.operators import channels, coverage, fts, index, intervals, library, phrases, query, retrieval, stats, store, threads, transcript

COMMENTS = [("a1", None, "v1", "alpha", 10, 300, "Alice", "UCa"), ("a1.1", "a1", "v1", "beta reply", 1, 400, "Bob", "UCb"), ("a2", None, "v1", "gamma", 99, 100, "Alice", "UCa"), ("b1", None, "v2", "alpha elsewhere", 0, None, "Zed", None)]


@pytest.fixture(scope="module")
def comment(spark):
    rows = spark.createDataFrame(COMMENTS, "comment_id string, parent_id string, video_id string, text string, like_count long, t long, author string, author_id string")
    return rows.withColumn("published_at", F.timestamp_seconds("t"))


@pytest.fixture(scope="module")
def video(spark):
    rows = [("v1", "UCch", "Camera review", 600, dt.date(2026, 1, 1), 900, 0, "x"), ("v2", None, "Battery test", 60, None, 50, 1, None)]
    return spark.createDataFrame(rows, "video_id string, channel_id string, title string, duration_s long, upload_date date, view_count long, catalog_rank long, detail_at string").withColumn("comment_count", F.lit(1))


def test_comment_queries(comment, video):
    n = lambda **k: query.comments(comment, video, query.CommentQuery(**k)).count()
    assert (n(video_id="v1"), n(channel_id="UCch"), n(author="UCa"), n(author="Zed"), n(min_likes=10)) == (3, 3, 2, 1, 2)
    first = lambda order: query.comment_page(comment, video, query.CommentQuery(video_id="v1", order=order)).first()["comment_id"]
    assert [first(o) for o in ("likes", "newest", "oldest", "relevance")] == ["a2", "a1.1", "a2", "a2"]
    assert query.comments(comment, video, query.CommentQuery(), fts.search(comment, "alpha")).count() == 2
    assert [r.comment_id for r in query.comment_page(comment, video, query.CommentQuery(thread="a1")).collect()] == ["a1", "a1.1"]


def test_video_queries(comment, video):
    n = lambda **k: query.videos(video, comment, query.VideoQuery(**k)).count()
    assert (n(), n(since="2025-01-01"), n(until="2027-01-01"), n(detailed_only=True), n(match="BATTERY"), n(min_duration=100)) == (2, 1, 1, 1, 1, 1)
    page = query.video_page(video, comment, query.VideoQuery(order="oldest")).collect()
    assert [(r.video_id, r.stored_comments) for r in page] == [("v1", 3), ("v2", 1)]
    assert query.page_envelope(2, 1, 0, 1) == {"total": 2, "count": 1, "offset": 0, "has_more": True, "next_offset": 1}
    got = {r.video_id: r.x for r in video.select("video_id", query.excluded(100, "2025-01-01").alias("x")).collect()}
    assert got == {"v1": False, "v2": True}


RECEIPT = "scope string, target_id string, have long, expected long, expected_source string, ran_to_exhaustion boolean, limit_applied long, reason string, resume_token string, harvested_at timestamp"
AT = dt.datetime(2026, 9, 6, 12)
# The eleven cases that a receipt is judged by.
MATRIX = [
    (120, 120, "comment_count", None, None, None, True, "COMPLETE"), (130, 120, "comment_count", None, None, None, True, "COMPLETE"), (119, 120, "comment_count", None, None, None, False, "SOURCE_SILENT"),
    (42, 42, "source-exhausted", True, None, None, True, "COMPLETE"), (5000, None, None, None, None, None, False, "SOURCE_SILENT"), (58, 58, "comment_count", True, 58, None, False, "CAP_REACHED"),
    (40, 40, "source-exhausted", True, 40, None, False, "CAP_REACHED"), (39, 39, "comment_count", None, 40, None, True, "COMPLETE"), (30, 30, "source-exhausted", False, None, None, False, "SOURCE_SILENT"),
    (12, None, None, None, None, "RATE_LIMITED", False, "RATE_LIMITED"), (0, 0, "comment_count", None, None, None, True, "COMPLETE"),
]


def test_receipts(spark):
    rows = [("comments", str(k), m[0], m[1], m[2], m[3], m[4], m[5], "token", AT) for k, m in enumerate(MATRIX)]
    made = coverage.receipts(spark.createDataFrame(rows, RECEIPT))
    for r in made.collect():
        m = MATRIX[int(r.target_id)]
        assert (r.complete, r.reason) == (m[6], m[7])
        assert (r.stale_after == AT + dt.timedelta(days=7)) == m[6] and (r.resume_token is None) == m[6]
    assert coverage.violations(made).count() == 0
    broken = made.withColumn("complete", ~F.col("complete"))
    assert coverage.violations(broken).count() == len(MATRIX)
    tabs = spark.createDataFrame([("c", "videos", True, 5, False), ("c", "shorts", False, 0, False), ("d", "videos", True, 9, True)], "channel_id string, tab string, present boolean, listed long, page_full boolean")
    assert {r.target_id: (r.have, r.complete) for r in coverage.catalogue_receipt(tabs).collect()} == {"c": (5, True), "d": (9, False)}


def test_reply_to_a_reply_is_an_orphan(spark, comment):
    deep = spark.createDataFrame([("a1.1.1", "a1.1", "v1", "deeper", 0, 500, "A", "B")], "comment_id string, parent_id string, video_id string, text string, like_count long, t long, author string, author_id string")
    r = threads.counts(comment.unionByName(deep.withColumn("published_at", F.timestamp_seconds("t")))).first()
    assert (r.threads, r.orphans, r.roots, r.replies) == (4, 1, 3, 1)


def test_threads(spark, comment):
    orphan = spark.createDataFrame([("z1", "gone", "v9", "x", 0, 5, "A", "B")], "comment_id string, parent_id string, video_id string, text string, like_count long, t long, author string, author_id string")
    rows = comment.unionByName(orphan.withColumn("published_at", F.timestamp_seconds("t")))
    r = threads.counts(rows).first()
    assert (r.threads, r.orphans, r.roots, r.replies) == (4, 1, 3, 1)
    got = {x.root_id: len(x.replies) for x in threads.assemble(rows).collect()}
    assert got == {"a1": 1, "a2": 0, "b1": 0, "z1": 0}


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([("d1", "A", "throttling requests politely"), ("d2", "A", "budget throttling throttling"), ("d3", "B", "nothing here"), ("d4", "B", "throttling once")], "id string, c string, text string")
    found = retrieval.top(retrieval.search(docs, "throttling the", key="id"), 5, key="id").collect()
    assert [r.id for r in found][0] == "d2" and len(found) == 3
    assert retrieval.search(docs, "the and", key="id").count() == 0
    fused = retrieval.fused(retrieval.search(docs, "throttling", key="id", corpus="c"), "c", 2, 10, key="id").collect()
    assert [(r.rank, r.id) for r in fused][0][0] == 1 and {r.id for r in fused} == {"d1", "d2", "d4"}
    lib = spark.createDataFrame([("1", "v1", "rate limits", "summary", "how to back off", 1), ("1", "v1", "rate limits", "summary", "newer text on limits", 2), ("2", "v2", "x", "bad-kind", "limits", 3), ("3", "v3", "other", "skill", "one mention of rate", 4)], "id string, video_id string, title string, kind string, text string, doc_order int")
    hits = library.search(library.documents_of(lib), "rate limits").collect()
    assert [h.id for h in hits] == ["1", "3"]


def test_phrases(spark):
    texts = [(v, 0, f"{w} ring the little bell {x}") for v, w, x in (("v1", "one", "now"), ("v2", "two", "please"), ("v3", "three", "today ring the little bell"))]
    texts += [("v1", 1, "only in one video " * 10), ("v4", 0, "and then it was and then it was"), ("v5", 0, "and then it was")]
    got = phrases.ranked(phrases.recurring(spark.createDataFrame(texts, "video_id string, ord int, text string"))).collect()
    assert [(r.phrase, r.video_count, r.occurrences) for r in got] == [("ring the little bell", 3, 4)]


def test_phrases_as_counted_by_hand(spark, monkeypatch):
    """Against counting every run; the most frequent phrases are those of the full ranking, however few runs are tried first."""
    from collections import Counter, defaultdict

    r = random.Random(5)
    texts = [None, "", "ab ac", *(" ".join(r.choices("ab ac the it's of éa".split(), [9, 5, 4, 2, 3, 1], k=r.randint(1, 40)) if k % 3 else ["ab", "the", "of"] * 5) for k in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "video_id long, text string")
    videos, n = defaultdict(set), Counter()
    for k, text in enumerate(texts):
        w = (text or "").split()
        for size in range(3, 7):
            for i in range(len(w) - size + 1):
                if not {*w[i : i + 3]} <= {"the", "of"}:
                    videos[" ".join(w[i : i + size])].add(k)
                    n[" ".join(w[i : i + size])] += 1
    want = {(p, len(v), n[p]) for p, v in videos.items() if len(v) >= 3}
    assert {tuple(x) for x in phrases.recurring_in_videos(rows).collect()} == want
    assert {tuple(x) for x in phrases.count_phrases(rows, range(3, 4), 3).collect()} == {x for x in want if len(x[0].split()) == 3}
    full = phrases.ranked(phrases.recurring_in_videos(rows), 4).collect()
    for first in (3, 20, 10_000):
        monkeypatch.setattr(phrases, "FIRST", first)
        assert phrases.most_frequent(rows, limit=4).collect() == full


def test_phrase_inside_words(spark):
    rows = spark.createDataFrame([("hat the ending", 3, 3), ("at the end", 3, 3), ("at the en d", 4, 4)], "phrase string, video_count long, occurrences long")
    assert {r.phrase for r in phrases.ranked(rows).collect()} == {"hat the ending", "at the en d"}


@pytest.mark.parametrize(("asked", "ids"), [("beta", {2}), ("alpha beta", {1}), ("alpha OR gamma", {0, 1, 3}), ("alpha NOT beta", {0}), ('"beta reply"', {2}), ("alp*", {0, 1}), ("cafe", {3}), ("(alpha OR beta) AND reply", {2}), ("", {0, 1, 2, 3})])
def test_boolean_search(spark, asked, ids):
    rows = spark.createDataFrame(list(enumerate(["alpha one", "beta and alpha", "the beta reply", "Café gamma"])), "id int, text string")
    found = {r.id for r in fts.search(rows, asked).collect()}
    assert found == ({1, 2} if asked == "beta" else ids)


FOUND = ["alpha beta gamma", "beta alpha", "gamma delta", "alphabet soup", "Café au lait", "delta x1_y2 alpha", "beta beta gamma delta", "", "über alpha-beta", "gamma"]


def asked_at_random(n):
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "alph*", '"beta gamma"', '"alpha be"*', "cafe", "ÜBER", "x1_y2", '"..."', "alpha + beta", "be* + ga*", '"a ""b"', "nothing", "AND", "(", ")", "*"]
    for _ in range(n):
        out = [r.choice(words[:14])]
        for _ in range(r.randint(0, 4)):
            out += [r.choice(["AND", "OR", "NOT", "", "", ""]), r.choice(words)]
        text = " ".join(out)
        yield f"({text}) {r.choice(['AND', 'OR', 'NOT'])} {r.choice(words[:8])}" if r.random() < 0.3 else text


def test_queries_as_sqlite_takes_them(spark, tmp_path):
    """The same rows, or a refusal, as the full-text search of SQLite gives, with and without an index."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(FOUND)))
    rows = spark.createDataFrame(list(enumerate(FOUND)), "doc_id int, text string")
    kept = index.build(rows, f"file://{tmp_path}/index", fts.search_tokens("text"), positions=True)
    asked, expected, refused = [], [], 0
    for q in dict.fromkeys(asked_at_random(260)):
        try:
            want = {r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (q,))}
        except sqlite3.OperationalError:
            refused += 1
            with pytest.raises(fts.QuerySyntaxError):
                fts.parse(q)
            continue
        asked.append(q)
        expected.append(want)
    tokens = rows.withColumn("t", fts.search_tokens("text"))
    flags = tokens.select("doc_id", *(fts.compile_query(q, F.col("t")).alias(f"q{k}") for k, q in enumerate(asked))).collect()
    assert refused > 20 and len(asked) > 100
    for k, (q, want) in enumerate(zip(asked, expected)):
        assert {r.doc_id for r in flags if r[f"q{k}"]} == want, q
    for q, want in list(zip(asked, expected))[:12]:
        assert {r.doc_id for r in fts.search_index(kept, q).collect()} == want, q


def _words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "the"]) + r.choice(["", "", "s", "x"]) for _ in range(n))


def test_index_takes_changes(spark, tmp_path):
    """After any adds, replacements, deletes and merges, every search gives what a fresh build of the same rows gives."""
    r = random.Random(1)
    schema, path = "doc_id long, text string, source string", f"file://{tmp_path}/i"
    rows = {k: (_words(r, r.randint(0, 12)), r.choice("pq")) for k in range(30)}
    frame = lambda own: spark.createDataFrame([(k, *v) for k, v in own.items()], schema)
    words = fts.search_tokens("text")
    kept = index.build(frame(rows), path, words, positions=True)
    by_source = index.build(frame(rows), f"{path}-s", words, corpus="source")
    first = kept
    for step in range(5):
        batch = {k: (_words(r, r.randint(0, 12)), r.choice("pq")) for k in r.sample(range(60), 3)}
        rows |= batch
        kept, by_source = kept.add(frame(batch), words), by_source.add(frame(batch), words)
        if step == 1:
            gone = [(k,) for k in r.sample(range(60), 3)]
            rows = {k: v for k, v in rows.items() if (k,) not in gone}
            kept, by_source = (x.delete(spark.createDataFrame(gone, "doc_id long")) for x in (kept, by_source))
    assert max(s["number"] for s in kept.segments) == 7 and len(kept.segments) < 7  # seven segments were written, a tier was merged
    opened = index.Index(spark, path)
    assert opened.meta == kept.meta
    found = lambda df: sorted((tuple(r)[0], *(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[1:])) for r in df.collect())
    plain = lambda q: found(retrieval.search(frame(rows), q, words))
    for q in ("alpha betas", "gammax gammax delta", "zeta"):
        assert found(retrieval.search_index(opened, q)) == plain(q), q
        assert found(retrieval.search_index(by_source, q)) == found(retrieval.search(frame(rows), q, words, corpus="source")), q
    for q in ("alpha NOT betas", '"alpha beta"', "gam* OR deltas", "zeta eps"):
        assert found(fts.search_index(opened, q)) == found(fts.search(frame(rows), q).select("doc_id")), q
    assert sorted(x["key"] for x in opened.docs().collect()) == sorted(rows)
    assert len(first.docs().collect()) == 30  # an older version stays readable
    again = index.build(frame(rows), path, words, positions=True)
    assert again.meta["version"] == opened.meta["version"] + 1 and found(retrieval.search_index(index.Index(spark, path), "alpha")) == plain("alpha")


def test_a_small_change_writes_little(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common words"), F.concat(F.lit("w"), F.col("id") % 97)).alias("text"))
    kept = index.build(rows, f"file://{tmp_path}/i")
    more = kept.add(rows.filter("doc_id % 100 = 0"))
    assert [s["name"] for s in more.segments][0] == kept.segments[0]["name"]  # the large segment is as it was
    assert spark.read.parquet(f"{tmp_path}/i/{more.segments[1]['name']}/postings").count() == 60


def test_repeated_keys_are_refused(spark, tmp_path):
    for rows in ([(1, "a one"), (1, "b two"), (1, "c"), (2, "d")], [(None, "a")]):
        with pytest.raises(index.RepeatedKeysError):
            index.build(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/i")
    empty = index.build(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e")
    assert retrieval.search_index(empty, "one").count() == 0
    filled = empty.add(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"))
    assert [r.doc_id for r in retrieval.search_index(filled, "one").collect()] == [1] and filled.statistics()[0] == 2


def test_tokens_are_made_once(spark, tmp_path):
    """Scans without an index split each text once, however many words are asked for."""
    spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    rows = spark.read.parquet(f"{tmp_path}/d")
    for found in (retrieval.search(rows, "alpha beta gamma delta eps zeta").drop("score"), fts.search(rows, "(alpha OR beta OR gamma) NOT delta")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        scans = plan.count("Relation [")
        assert scans and plan.count("split(") <= scans, plan


def test_postings_are_counted_in_their_rows(spark, tmp_path, monkeypatch):
    """Terms, counts and positions of repeated words, null and empty texts; tasks that grow with the rows."""
    from medialake import work

    docs = spark.createDataFrame([(1, "beta alpha beta  beta"), (2, None), (3, ""), *((k, f"word{k} common") for k in range(4, 400))], "doc_id long, text string")
    monkeypatch.setattr(work, "TASK_BYTES", 1000)
    made = index.build(docs, f"file://{tmp_path}/i", fts.search_tokens("text"), positions=True)
    assert {tuple(x) for x in made.postings(["alpha", "beta"]).select("key", "n_tokens", "term", "tf", F.array_join("positions", ",")).collect()} == {(1, 4, "alpha", 1, "1"), (1, 4, "beta", 3, "0,2,3")}
    assert {tuple(x) for x in made.docs().filter("key < 4").select("key", "n_tokens").collect()} == {(1, 4), (2, 0), (3, 0)}
    assert len(made.segments[0]["postings"]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = docs.select("doc_id", F.inline_outer(index.counted(fts.search_tokens("text"), True)))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Filter" not in plan


def test_index_reads_the_files_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 50:02d} common text{k}") for k in range(400)], "doc_id int, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would make one file
    try:
        made = index.build(docs, f"file://{tmp_path}/i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = index.Index(spark, f"file://{tmp_path}/i")
    assert again.meta == made.meta and again.statistics()[0] == 400
    assert {tuple(r) for r in made.frequencies(["word07", "common", "none"]).collect()} == {("all", "word07", 8), ("all", "common", 400)}
    first, last, names = zip(*made.segments[0]["postings"])
    assert len(names) > 1 and list(first) == sorted(first) and all(a <= b for a, b in zip(first, last))
    asked = made.postings(["word07"])
    assert len(asked.inputFiles()) < len(names) and asked.count() == 8
    got = [tuple(r) for r in retrieval.search_index(made, "common word07 common").orderBy("doc_id").collect()]
    want = [tuple(r) for r in retrieval.search(docs, "common word07 common").orderBy("doc_id").collect()]
    assert [(a, round(s, 9), f) for a, s, f in got] == [(a, round(s, 9), f) for a, s, f in want]
    assert retrieval.search_index(made, "of the").count() == 0 and retrieval.search_index(made, "nowhere").count() == 0


@pytest.mark.parametrize("bad", ['"open', "(a", "a AND", "OR b", ")", "(a OR b) c", "a (b)", "a-b", "NOT a", "*", "a +"])
def test_bad_queries(spark, bad):
    with pytest.raises(fts.QuerySyntaxError):
        fts.compile_query(bad, F.array(F.lit("x")))


SEGMENTS = [("v", 0, 0.0, 10.0, "opening on the subject"), ("v", 1, 10.0, 20.0, "its central claim"), ("v", 2, 20.0, 30.0, "a last remark")]
SEGMENT = "video_id string, ord int, start double, end double, text string"


def test_transcript(spark):
    rows = spark.createDataFrame(SEGMENTS, SEGMENT)
    cut = lambda *a: [r.ord for r in transcript.slice_segments(rows, *a).orderBy("ord").collect()]
    assert (cut(20.0), cut(None, 10.0), cut(15.0, 25.0), cut(100.0)) == ([2], [0], [1, 2], [])
    hits = lambda *a, **k: [r.start for r in transcript.find_phrase(rows, *a, **k).collect()]
    assert hits("CENTRAL claim") == [10.0] and hits("CENTRAL", case_sensitive=True) == [] and hits("l.") == [] and sorted(hits("l.", regex=True)) == [10.0, 20.0]
    assert hits("subject its central") == [0.0] and hits("claim a last remark") == [10.0]
    two = rows.unionByName(rows.withColumn("video_id", F.lit("w")))
    assert sorted((r.video_id, r.ord) for r in transcript.find_phrase(two, "a", limit=1).collect()) == [("v", 1), ("w", 1)]  # the limit is each video's
    for bad in ("(a+)+", "(a|b)*", r"(a)\1", "x" * 201):
        with pytest.raises(transcript.UnsafePatternError):
            transcript.check_pattern(bad)
    transcript.check_pattern("[a-z]+ (foo|bar) x?")
    lines = spark.createDataFrame([("v", 0, 0.0, 2.0, "good evening all"), ("v", 1, 2.0, 4.0, "good evening all"), ("v", 2, 2.0, 4.0, "here we are"), ("v", 3, 4.0, 6.0, ""), ("v", 4, 4.0, 6.0, " here we are "), ("v", 5, 4.0, 6.0, "once more"), ("v", 6, 2.0, 5.0, "out of order")], SEGMENT)
    got = transcript.rolling_dedupe(lines).orderBy("start").collect()
    got = sorted((r.ord, r.start, r.end, r.text) for r in got)
    assert got == [(0, 0.0, 2.0, "good evening all"), (2, 2.0, 4.0, "here we are"), (5, 4.0, 6.0, "once more"), (6, 2.0, 5.0, "out of order")]


def passages_of(spark, segments, chapters=()):
    rows = spark.createDataFrame([("v", k, *s) for k, s in enumerate(segments)], SEGMENT)
    marks = spark.createDataFrame([("v", float(c)) for c in chapters], "video_id string, start double") if chapters else None
    return transcript.passages(rows, marks).orderBy("ord").collect()


def test_passages(spark):
    assert passages_of(spark, []) == []
    one = passages_of(spark, [(k * 5.0, k * 5.0 + 5, "a short line") for k in range(3)])
    assert [(p.start, p.end, p.ord) for p in one] == [(0.0, 15.0, 0)]
    split = passages_of(spark, [(k * 5.0, k * 5.0 + 5, f"line {k}") for k in range(4)], [0, 10])
    assert [(p.start, p.end) for p in split] == [(0.0, 10.0), (10.0, 20.0)]
    pause = [(k * 5.0, k * 5.0 + 5, "x" * 100) for k in range(9)] + [(47.0, 52.0, "after the pause")]
    assert len(passages_of(spark, pause)) == 2
    assert len(passages_of(spark, [(0.0, 2.0, "short"), (60.0, 62.0, "late")])) == 1
    assert all(len(p.text) <= 1300 for p in passages_of(spark, [(k * 5.0, k * 5.0 + 5, "y" * 100) for k in range(40)]))
    assert [len(p.text) for p in passages_of(spark, [(0.0, 5.0, "z" * 3600)])] == [3600]
    assert passages_of(spark, [(0.0, 5.0, "   ")]) == []


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 20, 25), ("b", 10, 40), ("b", 15, 25), ("b", 10, 40), ("b", 35, 50)], "k string, start int, end int")
    assert {r.k: r.covered for r in intervals.covered_length(rows, "k").collect()} == {"a": 15, "b": 40}
    heat = [(k * 10.0, k * 10.0 + 10, v) for k, v in enumerate((0.1, 0.2, 0.9, 0.95, 0.3, 0.1, 0.6, 0.2, 0.1, 0.8))]
    h = spark.createDataFrame([(heat,)], "h array<struct<start:double,end:double,value:double>>")
    assert [p.start for p in h.select(intervals.peaks("h", 3).alias("p")).first().p] == [30.0, 90.0, 60.0]
    spans = [("v", k, 10.0 * k, 10.0 * k + (500.0 if k == 2 else 10.0)) for k in range(80)] + [("w", 80, 300.0, 310.0)]
    near = spark.createDataFrame(spans, "v string, i int, start double, end double")
    for around in (0.0, 25.0, 200.0):
        got = sorted((r.hit_id, r.i) for r in intervals.context(near.filter("i IN (30, 60)"), near, "v", around, "i", bucket=7.0).select("hit_id", "i").collect())
        assert got == sorted((h, i) for h in (30, 60) for v, i, a, b in spans if v == "v" and i != h and b > 10.0 * h - around and a < 10.0 * h + 10 + around)


def test_stored_rows_are_checked(spark, video):
    with pytest.raises(Exception, match="unexpected shape: channel_id"):
        query.checked(video, query.VIDEO_RULES()).collect()
    assert query.checked(video.filter("channel_id IS NOT NULL"), query.VIDEO_RULES()).count() == 1


def test_stats(spark):
    rows = [("c", "indexed", 100, 60, dt.date(2024, 3, 1)), ("c", "indexed", 200, 60, dt.date(2024, 3, 9)), ("c", "failed", 0, 60, None), ("d", "pending", 0, 0, None)]
    videos = spark.createDataFrame(rows, "channel_id string, state string, word_count long, duration_s long, upload_date date")
    got = {r.channel_id: (r.videos, r.indexed, r.failed, r.words_per_minute) for r in stats.corpus_stats(videos).collect()}
    assert got == {"c": (3, 2, 1, 150), "d": (1, 0, 0, 0)}
    assert [tuple(r) for r in stats.uploads_per_month(videos).collect()] == [("2024-03", 2)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    old = spark.createDataFrame([("a", "old", 1, "Ann")], "comment_id string, text string, like_count int, author string")
    assert s.commit({"comment": old, "receipt": old}) == 1
    batch = spark.createDataFrame([("a", "new", 5, "Imp", 1), ("b", "first", 1, "Bob", 2), ("b", "second", 2, "Eve", 3)], "comment_id string, text string, like_count int, author string, seq int")
    merged = store.upsert(s.read("comment"), batch, "comment_id", "seq", ["text", "like_count"])
    assert {tuple(r) for r in merged.collect()} == {("a", "new", 5, "Ann"), ("b", "second", 2, "Bob")}
    s.commit({"comment": merged}, based_on=1)
    again = store.upsert(s.read("comment"), batch, "comment_id", "seq", ["text", "like_count"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, s.read("comment").collect()))
    assert s.read("receipt").count() == 1
    with pytest.raises(store.StoreError):
        s.commit({"comment": old}, based_on=1)
    s.vacuum()
    assert s.read("comment").count() == 2
    plain = s.read("comment").collect()
    seq = batch.withColumn("text", F.lit("third"))
    s.commit(merges={"comment": store.Merge(seq.filter("comment_id = 'a'"), "comment_id", "seq", ["text"], buckets=4)})  # a table written whole is dealt
    assert sorted((r.comment_id, r.text) for r in s.read("comment").collect()) == [("a", "third"), ("b", "second")] and len(plain) == 2
    before = s.manifest()["tables"]["comment"]["parts"]
    s.commit(merges={"comment": store.Merge(seq.filter("comment_id = 'b'"), "comment_id", "seq", ["text"])})
    after = s.manifest()["tables"]["comment"]["parts"]
    assert sum(after[k] != before.get(k) for k in after) == 1
    with pytest.raises(store.StoreError, match="dealt by"):
        s.commit(merges={"comment": store.Merge(seq, "author", "seq", [])})
    s.commit(appends={"event": old})
    s.commit(appends={"event": old})
    s.vacuum()
    assert s.read("event").count() == 2 and s.read("comment").count() == 2 and s.read("receipt").count() == 1
    s.compact("event")
    assert s.read("event").count() == 2 and len(s.manifest()["tables"]["event"]["parts"]) == 1
    assert s.quarantine().startswith("file:") and not s.has("comment")


def test_images_are_saved(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    entries = spark.createDataFrame([("v1", "videos", "saved", 10), ("v2", "videos", "failed", None), ("v3", "shorts", None, None)], "video_id string, tab string, state string, bytes long")
    stats.save_images(s, "UCa", entries)
    stats.save_images(s, "UCb", entries.limit(1))
    stats.save_images(s, "UCa", entries)
    assert s.read("image").count() == 4
    got = {(r.channel_id, r.tab): (r.images, r.saved, r.failed, r.pending, r.bytes) for r in s.read("image_stats").collect()}
    assert got == {("UCa", "videos"): (2, 1, 1, 0, 10), ("UCa", "shorts"): (1, 0, 0, 1, 0), ("UCb", "videos"): (1, 1, 0, 0, 10)}


def test_work_files_need_a_shared_folder():
    from types import SimpleNamespace

    from medialake.work import work_path

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_path(unset, "x")
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://shared/"), sparkContext=unset.sparkContext)
    assert work_path(named, "x").startswith("hdfs://shared/medialake/x-")


def test_two_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "k string")
    one, two = (store.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.commit({"t": rows})
    late = two.manifest()
    one.commit({"t": rows})
    two.manifest = lambda: late  # it has not seen the last commit
    with pytest.raises(store.StoreError, match="another writer"):
        two.commit({"t": rows})


def test_deletes_and_details(spark, comment, video):
    assert store.delete_author(comment, "Alice").count() == 2
    channel = spark.createDataFrame([("UCch",)], "channel_id string")
    left = store.delete_channel(channel, video, comment, lambda: F.col("channel_id") == "UCch")
    assert [x.count() for x in left] == [0, 1, 1]
    details = spark.createDataFrame([("v2", 77, None), ("unknown", 1, 1)], "video_id string, duration_s long, view_count long")
    got = {r.video_id: (r.duration_s, r.view_count) for r in store.update_details(video, details, ["duration_s", "view_count"]).collect()}
    assert got == {"v1": (600, 900), "v2": (77, 50)}
    read = spark.createDataFrame([("v1", None, "now")], "video_id string, duration_s long, detail_at string")
    got = store.update_details(video, read.unionByName(read.withColumn("video_id", F.lit("v9"))), ["duration_s"], ["detail_at"])
    assert {r.video_id: (r.duration_s, r.detail_at) for r in got.collect()} == {"v1": (600, "now"), "v2": (60, None)}
    gone = store.update_details(video, read.withColumn("detail_at", F.lit(None).cast("string")), ["duration_s"], ["detail_at"])
    assert {r.video_id: r.detail_at for r in gone.collect()} == {"v1": None, "v2": None}
    kind = "r struct<id:string,title:string,description:string,chapters:array<string>,tags:array<string>,categories:array<string>>"
    made = [("x", "t", "d" * 40000, ["c"], ["g"], ["k"]), ("y", "t", "d", ["c"], ["g"], ["k"]), ("z", "t", "d" * 40000, ["c" * 40000], ["g" * 40000], ["k" * 40000])]
    kept = [json.loads(r.j) for r in spark.createDataFrame([(r,) for r in made], kind).select(store.capped_record(F.col("r")).alias("j")).collect()]
    assert kept[0] == {"id": "x", "title": "t", "chapters": ["c"], "tags": ["g"], "categories": ["k"], "detail_truncated": True}
    assert "detail_truncated" not in kept[1] and kept[1]["description"] == "d"
    assert kept[2] == {"id": "z", "title": "t", "detail_truncated": True}


def test_channels(spark):
    rows = [("UC" + "x" * 22, "@handle", "Some Name", "https://www.youtube.com/@handle")]
    channel = spark.createDataFrame(rows, "channel_id string, handle string, name string, channel_url string")
    for name in ("UC" + "x" * 22, "@handle", "handle", "SOME name", "https://www.youtube.com/@handle/", "https://www.youtube.com/@handle/videos", "https://www.youtube.com/channel/UC" + "x" * 22):
        assert channels.resolve_channel(channel, name).count() == 1, name
    assert channels.resolve_channel(channel, "nobody").count() == 0
    listed = spark.createDataFrame([("new1", "videos", 0, 0), ("old1", "videos", 0, 1), ("new1", "shorts", 1, 0)], "video_id string, tab string, tab_order int, position int")
    known = spark.createDataFrame([("old1",)], "video_id string")
    assert [(r.video_id, r.tab) for r in channels.new_uploads(listed, known).collect()] == [("new1", "videos")]
    assert channels.decode_cursor(channels.encode_cursor(40, "v9")) == (40, "v9")
    for bad in ("nonsense", channels.encode_cursor(0, "v9"), channels.encode_cursor(1, None), channels.encode_cursor(True, "v9")):
        with pytest.raises(ValueError, match="not a cursor"):
            channels.decode_cursor(bad)
    entries = spark.createDataFrame([(f"v{k}", k) for k in range(10)], "video_id string, position int")
    ids = lambda page: [r.video_id for r in page.collect()]
    assert ids(channels.listing_page(entries, 4)) == ["v0", "v1", "v2", "v3"]
    first = channels.page_state(entries, 4)
    assert (first["has_more"], first["drift_detected"]) == (True, False) and channels.decode_cursor(first["next_cursor"]) == (5, "v3")
    moved = spark.createDataFrame([("new", 0), *((f"v{k}", k + 1) for k in range(10))], "video_id string, position int")
    assert ids(channels.listing_page(moved, 4, first["next_cursor"])) == ["v4", "v5", "v6"]
    state = channels.page_state(moved, 4, first["next_cursor"], total=11)
    assert state["drift_detected"] and state["has_more"] and channels.decode_cursor(state["next_cursor"]) == (9, "v6")
    assert channels.page_state(entries, 4, channels.encode_cursor(9, "v7")) == {"drift_detected": False, "has_more": False}
    chapters = spark.createDataFrame([("v", 0.0, "Intro to it"), ("v", 5.0, "Intro"), ("w", 0.0, "More intro")], "video_id string, start double, title string")
    assert {r.video_id: r.start for r in channels.chapter_by_name(chapters, "intro").collect()} == {"v": 5.0, "w": 0.0}
    states = spark.createDataFrame([("a", "indexed"), ("b", "indexed"), ("c", "failed")], "video_id string, state string")
    passages = spark.createDataFrame([("a",)], "video_id string")
    got = {r.video_id: r.state for r in channels.reconcile(states, passages, spark.createDataFrame([("d",)], "video_id string")).collect()}
    assert got == {"a": "indexed", "b": "pending", "c": "failed", "d": "pending"}


def test_channels_resolved_in_bulk(spark):
    made = [("UC" + "x" * 22, "@handle", "Some Name", "https://www.youtube.com/@handle"), ("UC" + "y" * 22, "@other", "Twin", None), ("UC" + "z" * 22, None, "twin", ""), (None, "@ghost", "Ghost", None)]
    channel = spark.createDataFrame(made, "channel_id string, handle string, name string, channel_url string")
    want = {
        "UC" + "x" * 22: "x", "@handle": "x", " HANDLE ": "x", "some name/": "x", "https://www.youtube.com/@Handle/": "x", "https://www.youtube.com/@handle/videos?a=1": "x",
        "see https://www.youtube.com/channel/UC" + "y" * 22: "y", "uc" + "z" * 22: "z", "TWIN": "ambiguous", "@twin": "ambiguous", "twin @handle": "x",
        "UC" + "x" * 22 + " and @other": "ambiguous", "nobody": "unknown", "ghost": "unknown", "": "unknown", "  ": "unknown", None: "unknown",
    }
    asked = spark.createDataFrame([(n, i) for i, n in enumerate([*want, "twin", "twin"])], "name string, status_before int")
    got = channels.resolve_channels(channel, asked)
    assert got.columns == ["name", "status_before", "status", "channel_id"] and got.count() == len(want) + 2
    kinds = {r.name: r.channel_id[-1] if r.status == "found" else r.status for r in got.collect()}
    assert kinds == want | {"twin": "ambiguous"}
    assert channels.resolve_channels(channel.limit(0), asked).filter("status <> 'unknown' OR channel_id IS NOT NULL").count() == 0
    assert channels.resolve_channels(channel, asked.limit(0)).count() == 0


def test_detail_runs(spark):
    from medialake.streaming import ingest

    codes = {
        "whole": [None] * 3, "capped": [None] * 6, "private": [None, "PRIVATE", None], "throttled": [None, "PRIVATE", "RATE_LIMITED", "PRIVATE", None, "BOT_CHECK"],
        "refused": ["LOGIN_REQUIRED"], "cancelled": [None, None, None, None, "CANCELLED"], "unknown": [None, None],
    }
    videos = spark.createDataFrame([(c, i, code) for c, own in codes.items() for i, code in enumerate(own)], "target_id string, ord int, code string")
    made = ingest.detail_run(videos.filter("ord < 5"), 2)
    reads = {c: [r.marks_unreadable for r in made.filter(F.col("target_id") == c).orderBy("ord").collect()] for c in codes}
    assert reads["throttled"] == [False, True, False, True] and reads["private"] == [False, True, False] and len(reads["capped"]) == 5  # a batch is read to its end
    after = made.groupBy("target_id").agg(F.count_if(F.col("code").isNull()).alias("detailed"), F.count_if("marks_unreadable").alias("unreadable"))
    state = videos.groupBy("target_id").agg(F.count("*").alias("videos")).join(after, "target_id")
    state = state.withColumn("remaining", F.col("videos") - F.col("detailed") - F.col("unreadable")).withColumn("catalogue_complete", F.col("target_id") != "unknown")
    idle = spark.createDataFrame([("idle", 2, 2, 0, 0, True)], "target_id string, videos long, detailed long, unreadable long, remaining long, catalogue_complete boolean")
    rows = coverage.receipts(coverage.detail_attempts(made, state.unionByName(idle), 5, F.lit("2024-01-01").cast("timestamp")))
    got = {r.target_id: (r.have, r.complete, r.reason, r.resume_token, (r.note or "")[:8]) for r in rows.collect()}
    assert got == {
        "whole": (3, True, "COMPLETE", None, ""), "capped": (5, False, "CAP_REACHED", "details:capped", ""), "private": (2, False, "PARTIAL_ERROR", None, "1 video "), "throttled": (1, False, "RATE_LIMITED", "details:throttled", "2 videos"),
        "refused": (0, False, "SOURCE_REFUSED", "details:refused", ""), "cancelled": (4, False, "CANCELLED", "details:cancelled", ""), "unknown": (2, False, "SOURCE_SILENT", None, ""), "idle": (2, True, "COMPLETE", None, ""),
    }
    assert coverage.violations(rows).count() == 0
