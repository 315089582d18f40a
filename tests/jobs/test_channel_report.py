import datetime
from pathlib import Path

from jobs import channel_report, common

DAY = datetime.datetime
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string, extra string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp"


def tables(spark, folder, orders, lines):
    spark.createDataFrame(orders, ORDERS).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, 1, 1, n, 1.0, DAY(2024, 1, 1)) for k, have in lines.items() for n in range(have)], LINES).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "one", "m"), (2, "two", "m")], "c_custkey long, c_name string, c_mktsegment string").write.mode("overwrite").parquet(f"{folder}/customer.parquet")


BASE = [
    (3, 1, "O", 10.1, DAY(2024, 1, 5), "x", "e"), (4, 1, "F", 10.1, DAY(2024, 1, 31), "x", "e"), (5, 2, "F", 79.8, DAY(2024, 1, 9), "x", "e"),
    (6, 2, "F", None, DAY(2024, 2, 1), "x", "e"), (7, 9, "F", 5.0, DAY(2024, 2, 29), "x", "e"), (8, 1, "F", 5.0, None, "x", "e"),
]


def rows(spark, out):
    return {(r["month"], r["channel_id"]): r for r in channel_report.read(spark, out).collect()}


def test_months_channels_and_reruns(spark, tmp_path):
    tables(spark, tmp_path, BASE, {3: 4, 4: 2, 7: 5})
    out = f"{tmp_path}/out"
    assert channel_report.run(spark, str(tmp_path), out) == 4
    got = rows(spark, out)
    assert set(got) == {("2024-01", 1), ("2024-01", 2), ("2024-02", 2), ("2024-02", 9)}
    one = got["2024-01", 1]
    assert (one["name"], one["videos"], one["views"], one["stored_comments"], one["most_comments"], one["best_video"]) == ("one", 2, 20.2, 6, 4, 3)  # of two best the lower id
    assert one["share"] == 20.2 / 100.0 and one["first_upload"] == datetime.date(2024, 1, 5) and one["last_upload"] == datetime.date(2024, 1, 31)
    assert got["2024-02", 9]["name"] is None and got["2024-02", 2]["views"] is None and got["2024-02", 2]["share"] is None and got["2024-02", 2]["best_video"] == 6
    assert one["complete"] + one["partial"] + one["failed"] == 2
    assert channel_report.run(spark, str(tmp_path), out) == 4 and rows(spark, out) == got


def test_a_window_replaces_its_months_only(spark, tmp_path):
    tables(spark, tmp_path, BASE, {3: 1})
    out = f"{tmp_path}/out"
    channel_report.run(spark, str(tmp_path), out)
    old = rows(spark, out)
    later = [(k, c, s, (v or 0.0) + 1.0, d, p, e) for k, c, s, v, d, p, e in BASE] + [(9, 2, "F", 1.0, DAY(2024, 3, 1), "x", "e")]
    tables(spark, tmp_path, later, {3: 1})
    assert channel_report.run(spark, str(tmp_path), out, since="2024-02", until="2024-02") == 2
    got = rows(spark, out)
    assert {k: v for k, v in got.items() if k[0] == "2024-01"} == {k: v for k, v in old.items() if k[0] == "2024-01"}
    assert got["2024-02", 9]["views"] == 6.0 and ("2024-03", 2) not in got
    assert channel_report.run(spark, str(tmp_path), out, replace=True) == 5 and rows(spark, out)["2024-01", 2]["views"] == 80.8


def test_bounds_reach_the_scan(spark, tmp_path):
    tables(spark, tmp_path, BASE, {3: 1})
    plan = channel_report.report(spark, str(tmp_path), "2024-02", "2024-02")._jdf.queryExecution().toString()
    assert "2024-02-01" in plan and "2024-03-01" in plan


def test_empty_tables_and_config(spark, tmp_path):
    tables(spark, tmp_path, [], {})
    assert channel_report.run(spark, str(tmp_path), f"{tmp_path}/out") == 0
    assert channel_report.read(spark, f"{tmp_path}/out").count() == 0
    assert common.config(spark, f"{Path(channel_report.__file__).parent}/channel_report.json", channel_report.SETTINGS) == channel_report.SETTINGS
