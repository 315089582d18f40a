import itertools
import random
from fractions import Fraction

import duckdb
import pyspark.sql.functions as F
import pytest
from corpus import BLANK_WORD, documents, empty, rows
from medialake.llm import mixing, queries


def spread(budget, weights, caps):
    """The reshared excess, round by round, as the words of the contract have it."""
    target, capped = [0] * len(caps), set()
    while True:
        free = [i for i in range(len(caps)) if i not in capped]
        left, weight = budget - sum(caps[i] for i in capped), sum(weights[i] for i in free)
        target = [caps[i] if i in capped else left * weights[i] / weight for i in range(len(caps))]
        over = {i for i in free if target[i] > caps[i]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(20))
def test_water_filled_equals_resharing(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 7, r.randrange(1000), r.randrange(10**6)]) for _ in range(r.randint(1, 9))]
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.water_filled(sizes, weights, Fraction(3, 2), 2)
    want = spread(Fraction(3, 2) * sum(sizes), weights, [2 * s for s in sizes])
    assert got == [float(x) for x in want]
    assert mixing.water_filled([], [], Fraction(3, 2), 2) == []


def best_by_force(patterns, quotas, repeats, cost):
    """The greatest volume and its least cost over all whole-number flows."""
    ways = [(p, s) for p, (own, _) in enumerate(patterns) for s in own]
    found = None
    for flow in itertools.product(*(range(repeats * patterns[p][1] + 1) for p, _ in ways)):
        used = [sum(f for f, (q, _) in zip(flow, ways) if q == p) for p in range(len(patterns))]
        if any(u > repeats * size for u, (_, size) in zip(used, patterns)) or any(sum(f for f, (_, s) in zip(flow, ways) if s == name) > q for name, q in quotas.items()):
            continue
        price = sum(cost(k) * min(max(u - k * size, 0), size) for u, (_, size) in zip(used, patterns) for k in range(repeats))
        found = min(found or (1, 0), (-sum(flow), price))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_greatest_and_cheapest(seed):
    r = random.Random(seed)
    sources = ["a", "b", None][: r.randint(1, 3)]
    patterns = [(own, r.randint(0, 2)) for own in [tuple(s for s in sources if r.random() < 0.6) for _ in range(3)]]
    quotas, cost = {s: r.randint(0, 5) for s in sources}, lambda k: k * k
    got = mixing.routed(patterns, quotas, 3, cost)
    used = [sum(x.values()) for x in got]
    for name, quota in quotas.items():
        assert sum(x.get(name, 0) for x in got) <= quota
    price = sum(cost(k) * min(max(u - k * size, 0), size) for u, (_, size) in zip(used, patterns) for k in range(3))
    assert (-sum(used), price) == best_by_force(patterns, quotas, 3, cost)


def test_overlapping_sources(spark):
    """Words of a text that belongs to two sources go to both, and nobody is taken more than allowed."""
    docs = documents(spark)
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array())
    want = {"x": 9000.0, "y": 2500.5}
    got = mixing.mix(docs, members, lambda sizes: want, repeats=3).collect()
    size = lambda t: len(BLANK_WORD.findall(t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((x[0] is None, x[0] or 0, size(x[1])) for x in rows())
    taken = {"x": 0, "y": 0}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] + r["rest"] == sum(t["taken"] for t in r["takes"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["rest"] < r["size"] or not r["size"])
        assert [t["source"] for t in r["takes"]] == r["members"]
        for t in r["takes"]:
            taken[t["source"]] += t["taken"]
    assert taken == {"x": 9000, "y": 2500}
    by_pattern = {}
    for r in got:
        by_pattern.setdefault(tuple(r["members"]), []).append(r)
    for own in by_pattern.values():  # documents differ by one copy at most, and one of them is cut
        assert max(r["copies"] for r in own if r["size"]) - min(r["copies"] for r in own if r["size"]) <= 1 and sum(r["rest"] > 0 for r in own) <= 1


def test_cut_in_partitions_alike(spark):
    docs = documents(spark)
    own = lambda df: sorted(map(str, mixing.mix(df, F.array("lang"), mixing.by_weight()).collect()))
    assert own(docs.repartition(1)) == own(docs.repartition(7))


def test_query_equals_sql(spark, tmp_path):
    docs = documents(spark).drop("start", "spans", "key", "row", "_row").withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 5)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_mixing(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op11_mixing']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_empty_table_and_clashing_names(spark):
    assert mixing.mix(empty(spark), F.array("source"), mixing.by_weight()).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "s", 5, "x"), (1, "a b c", "s", 5, "x"), (2, None, None, 0, "y")], "doc_id long, text string, source string, size long, taken string")
    got = mixing.mix(docs, F.array("source"), mixing.by_weight()).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 3), (1, 3, 6), (2, 0, 0)]
    assert sum(r["taken"] for r in got) == 9
