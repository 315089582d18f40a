from collections import Counter, defaultdict

import duckdb
import pyspark.sql.functions as F
from corpus import documents, empty, rows

from medialake.llm import sharding, url_filters
from medialake.llm.common import work_path
from medialake.llm.queries import ORACLES, QUERIES
from medialake.llm.sql import sharding_sql


def test_shards_fit_and_only_full_buckets_split(spark):
    limit = 6000
    found = sharding.shard(documents(spark), limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in found) == Counter((r[0], len((r[1] or "").encode())) for r in rows())
    by, below = defaultdict(list), Counter()
    for r in found:
        by[r.shard].append(r)
        for k in range(len(r.shard)):
            below[r.shard[:k]] += r.n_bytes
    for name, own in by.items():
        assert {(r.depth, r.shard_docs, r.shard_bytes, r.fits) for r in own} == {(len(name), len(own), sum(r.n_bytes for r in own), sum(r.n_bytes for r in own) <= limit)}
        assert own[0].fits or len({(r.doc_id, r.n_bytes) for r in own}) == 1
    assert all(n > limit for n in below.values())
    assert not any(a != b and b.startswith(a) for a in by for b in by)


def test_hot_key_is_split_by_text(spark):
    docs = spark.createDataFrame([(1, f"text {k} " * 20) for k in range(200)], "doc_id long, text string")
    found = sharding.shard(docs, 4000).collect()
    assert len(found) == 200 and all(r.fits for r in found) and len({r.shard for r in found}) > 5


def test_deeper_than_the_histogram(spark):
    found = sharding.shard(documents(spark), 3000, slack_bits=-3).collect()
    other = sharding.shard(documents(spark), 3000).collect()
    assert Counter(tuple(r) for r in found) == Counter(tuple(r) for r in other)


def test_sharding_oracle(spark, tmp_path):
    docs = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    out = sharding.shard(docs, 6000)
    expected = db.sql(sharding_sql(6000)).select(*out.columns).fetchall()
    assert Counter(tuple(r) for r in out.collect()) == Counter(expected)


def test_directory_and_files(spark):
    docs = documents(spark)
    shards = sharding.shard(docs, 20000)
    ranges = sorted((r.first_hash, r.last_hash) for r in sharding.directory(shards).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    where = Counter((r.doc_id, r.shard) for r in shards.collect())
    for slack_bits in (4, -3):  # one round, and several
        path = work_path(spark, "test-shards")
        sharding.write_shards(docs, path, 20000, slack_bits=slack_bits)
        back = spark.read.schema(docs.withColumn("shard", F.lit("")).schema).parquet(path).collect()
        assert Counter((r.doc_id, r.shard or "") for r in back) == where
        assert Counter(tuple(r)[:-1] for r in back) == Counter(tuple(r) for r in rows())


def test_shard_column_of_the_input_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", "mine", 7), (2, None, None, None)], "doc_id long, text string, shard string, hash long")
    path = work_path(spark, "test-shards")
    sharding.write_shards(docs, path, 1000)
    assert {(r.doc_id, r.text, r.shard, r.hash) for r in spark.read.parquet(path).collect()} == {(1, "a", "mine", 7), (2, None, None, None)}


def test_sharding_empty(spark):
    assert sharding.shard(empty(spark), 1000).count() == 0


ENTRIES = [
    ("a", "bad.example.com", "2024-01-10", "add"), ("a", "bad.example.com", "2024-02-10", "remove"), ("a", "bad.example.com", "2024-03-10", "add"), ("a", "bad.example.com", "2024-03-12", "add"),
    ("b", "example.com", "2024-02-01", "add"), ("b", "example.org/x", "2024-01-01", "add"), ("b", "tie.net", "2024-01-01", "add"), ("b", "tie.net", "2024-01-01", "remove"),
    ("c", None, "2024-01-01", "add"), ("c", "null.net", None, "add"), ("a", "gone.net", "2024-01-01", "remove"), ("a", "bad.example.com", "2024-01-10", "add"),
]
CAPTURES = [
    (1, "http://bad.example.com/p", "2024-01-09"), (2, "http://bad.example.com/p", "2024-01-10"), (3, "https://u:p@sub.BAD.example.com:80/p?q", "2024-02-09"), (4, "http://bad.example.com", "2024-02-10"),
    (5, "http://bad.example.com#f", "2024-03-11"), (6, "http://example.org/x/y", "2024-05-01"), (7, "http://example.org/xy", "2024-05-01"), (8, "http://tie.net/", "2024-05-01"), (9, None, "2024-05-01"),
    (10, "not a url", "2024-05-01"), (11, "http://bad.example.com/", None), (2, "http://bad.example.com/p", "2024-01-10"), (None, "http://null.net", "2024-05-01"), (12, "http://gone.net", "2025-01-01"),
]


def test_url_filters(spark):
    import pyspark.sql.functions as F

    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, day string, action string").select("list", "pattern", F.to_timestamp("day").alias("at"), "action")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, day string").select("page_id", "url", F.to_timestamp("day").alias("fetched_at"), F.lit("x").alias("lists"))
    for most in (100_000, 0):  # broadcast and shuffled
        found = Counter((r.page_id, r.blocked, r.lists) for r in url_filters.evaluate(captures, entries, most).collect())
        assert found == Counter(
            [(1, False, ""), (2, True, "a"), (2, True, "a"), (3, True, "a,b"), (4, True, "b"), (5, True, "a,b"), (6, True, "b"), (7, False, ""), (8, False, ""), (9, False, ""), (10, False, ""), (11, False, ""), (None, False, ""), (12, False, "")]
        )
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0
    assert url_filters.evaluate(captures, entries.limit(0)).filter("blocked").count() == 0


def test_every_oracle_names_a_query():
    assert set(ORACLES) <= set(QUERIES)
