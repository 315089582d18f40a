import json
import logging
import random

import pyspark.sql.functions as F
import pytest
from jobs import common, passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch long"


def sentences(r, n):
    return " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", ".\n", "! ", "?\t"]) for _ in range(n))


def put(spark, folder, rows, files=2):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(folder)


def rows_of(seed, ids):
    r = random.Random(seed)
    return [(k, sentences(r, r.randint(1, 900)), "en", r.choice(["s1", "s2", "", None]), 1, 99) for k in ids]


def expected(latest):
    """Plain Python over the newest text of each id."""
    import re

    out = []
    for k, (text, lang, source) in latest.items():
        parts = [x for x in re.sub(r"([.!?])[ \t\r\n]+", "\\1\n", text or "").split("\n") if x]
        groups, chars = [], 0
        for part in parts:
            if not groups or chars >= 1200:
                groups.append([])
                chars = 0
            groups[-1].append(part)
            chars += len(part) + 1
        texts = [" ".join(" ".join(g).split()) for g in groups]
        out += [(k, source, lang, n, len(t.split(" ")), t) for n, t in enumerate(t for t in texts if t)]
    return sorted(map(str, out))


def found(spark, output):
    return sorted(str(tuple(r)) for r in passages.current(spark, output).select("doc_id", "source", "lang", "ord", "n_words", "text").collect())


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    docs, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    first = rows_of(1, range(40))
    put(spark, docs, [*first, (None, "without an id.", "en", "s1", 1, 1)])
    with caplog.at_level(logging.INFO, "jobs.passages"):
        assert passages.refresh(spark, docs, out, mark, files_per_batch=1) >= 2  # a batch a file
    latest = {k: (t, lang, s) for k, t, lang, s, *_ in first}
    assert found(spark, out) == expected(latest)
    assert any('"without_id": 1' in r.getMessage() for r in caplog.records)
    before = {f for f in map(str, (tmp_path / "out" / "passages").rglob("*.parquet"))}

    assert passages.refresh(spark, docs, out, mark) == 0  # nothing new: nothing is written
    assert {f for f in map(str, (tmp_path / "out" / "passages").rglob("*.parquet"))} == before

    second = [*rows_of(2, range(30, 55)), (3, None, "de", "s9", 1, 1), (4, "  \n ", "de", "s9", 1, 1)]
    put(spark, docs, second, 1)
    assert passages.refresh(spark, docs, out, mark) == 1
    latest |= {k: (t, lang, s) for k, t, lang, s, *_ in second}
    assert found(spark, out) == expected(latest)
    after = {f for f in map(str, (tmp_path / "out" / "passages").rglob("*.parquet"))}
    assert before < after  # the first run's files are as they were

    whole = f"{tmp_path}/whole"  # the newest texts in one go
    put(spark, f"{tmp_path}/once", [(k, *v, 1, 1) for k, v in latest.items()])
    passages.refresh(spark, f"{tmp_path}/once", whole, f"{tmp_path}/mark2")
    assert found(spark, whole) == found(spark, out)
    logged = [json.loads(r["value"]) for r in spark.read.text(f"{out}/log").collect()]
    assert sum(x["rows"] for x in logged) == len(first) + 1 + len(second) and all(x["files"] for x in logged)


def test_a_batch_that_fails_is_run_again(spark, tmp_path, monkeypatch):
    docs, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    rows = rows_of(3, range(20))
    put(spark, docs, rows)
    whole = passages.take

    def broken(*given):
        whole(*given)
        raise OSError("lost after writing")

    monkeypatch.setattr(passages, "take", broken)
    with pytest.raises(Exception, match="lost after writing"):
        passages.refresh(spark, docs, out, mark)
    monkeypatch.setattr(passages, "take", whole)
    put(spark, docs, rows_of(4, range(15, 25)), 1)
    passages.refresh(spark, docs, out, mark)
    latest = {k: (t, lang, s) for k, t, lang, s, *_ in [*rows, *rows_of(4, range(15, 25))]}
    assert found(spark, out) == expected(latest)


def test_rows_of_one_id_and_empty_batches(spark, tmp_path):
    rows = [(1, "a b.", "en", "x", "t1", "p1"), (1, "c d e.", "en", "y", "t2", "p1"), (1, "c d.", "en", "z", "t2", "p1"), (2, None, None, None, "t", "p"), (2, None, None, None, "t", "p")]
    batch = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _time string, _path string")
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in passages.newest(batch).collect())
    assert got == [(1, "c d.", "z"), (2, None, None)]
    got = passages.take(batch.limit(0), 0, f"{tmp_path}/out", 4)
    assert got == {"rows": 0, "without_id": 0, "files": 0, "documents": 0, "passages": 0} and passages.current(spark, f"{tmp_path}/out").collect() == []


def test_a_source_lies_on_one_shelf(spark, tmp_path):
    put(spark, f"{tmp_path}/in", rows_of(5, range(30)))
    passages.refresh(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", shelves=4)
    written = spark.read.schema(passages.PASSAGES).parquet(f"{tmp_path}/out/passages")
    assert written.groupBy("source").agg(F.countDistinct("shelf").alias("n")).filter("n > 1").count() == 0
    assert written.select("shelf").distinct().count() > 1


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"shelves": 3}')
    assert common.config(spark, f"{tmp_path}/c.json", passages.SETTINGS) == {"files_per_batch": 256, "shelves": 3}
    (tmp_path / "d.json").write_text('{"shelfs": 3}')
    with pytest.raises(ValueError, match="shelfs"):
        common.config(spark, f"{tmp_path}/d.json", passages.SETTINGS)
    from pathlib import Path

    here = Path(passages.__file__).parent
    assert common.config(spark, f"{here}/passages.json", passages.SETTINGS) == passages.SETTINGS


def test_texts_are_cut_once_for_their_rows(spark):
    """No filter below the shuffles cuts the texts as well."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "One. Two.", "en", "s", 1, "f"), (2, None, "en", "s", 1, "f")], "doc_id long, text string, lang string, source string, _time long, _path string")
    found = passages.placed(passages.cut(passages.newest(rows)).withColumn("batch", F.lit(0)))
    assert [(r.doc_id, r.ord, r.text) for r in found.collect()] == [(1, 0, "One. Two.")]
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in x]
    assert not [x for x in filters if "aggregate(" in x or "split(" in x], filters
