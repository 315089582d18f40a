from types import SimpleNamespace

import pytest

from medialake.llm import common


def session(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://somewhere:7077", None))
    assert common.shared_dir(session("spark://somewhere:7077", "hdfs://shared")) == "hdfs://shared"


def test_settled_leaves_one_table(spark):
    def make():
        part = common.materialise(spark.range(5), "part")
        return part.filter("id > 2")

    before = len(common._written)
    out = common.settled(make, "whole")
    assert [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in common._written[before:]] == ["whole"]
    assert {r.id for r in out.collect()} == {3, 4}
    common.discard(out)
    assert len(common._written) == before


def test_tasks_follow_the_bytes(spark, monkeypatch):
    rows = common.materialise(spark.range(20000), "rows")
    assert common.shuffle_width(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(common, "TASK_BYTES", 2000)
    assert common.shuffle_width(rows) > 10
    common.discard(rows)
