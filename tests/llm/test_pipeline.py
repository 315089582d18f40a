from collections import Counter

import corpus_pipeline
from corpus import SCHEMA, rows
from test_repeats_near import classes, removed
from test_rules_licenses_lm import BENCHMARK, decontaminated, items, windows_of

from medialake.llm import packing, quality
from medialake.llm.queries import vocabulary


def with_text(row, text):
    return (row[0], text, *row[2:4], None if text is None else len(text), *row[5:])


def test_pipeline_stages(spark, tmp_path):
    folder, benchmark = str(tmp_path), items()
    spark.createDataFrame([(*r[:4], -1, *r[5:]) for r in rows()], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, got = docs.schema, {}
    flags = {(r.doc_id, r.kept) for r in quality.quality(docs).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == schema
        got[name] = [tuple(r) for r in docs.collect()]

    # the label model itself has its own tests: here, the rows that it keeps
    expected = [(*r[:4], -1, *r[5:]) for r in rows() if (r[0], True) in flags]
    assert Counter(got["quality"]) == Counter(expected) and 0 < len(expected) < len(rows())
    least = {d for d, c, _ in classes(expected) if d == c}
    expected = list(dict.fromkeys(r for r in expected if r[0] in least))
    assert Counter(got["near-duplicates"]) == Counter(expected)
    kept = removed([(r[1] or "").encode() for r in expected])
    expected = [with_text(r, None if r[1] is None else text.decode(errors="ignore")) for r, (text, _) in zip(expected, kept)]
    assert Counter(got["repeats"]) == Counter(expected)
    texts = [decontaminated(r[1], windows_of(benchmark)) for r in expected]
    expected = [with_text(r, text) for r, text in zip(expected, texts) if text is not None or r[1] is None]
    assert Counter(got["decontamination"]) == Counter(expected) and expected
    # the plan of the whole run is that of these rows
    plan = packing.pack(spark.createDataFrame(expected, schema), vocabulary())
    assert Counter(corpus_pipeline.run(spark, folder).collect()) == Counter(plan.collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, own in (("none", []), ("some", rows()[:12])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
        plan = corpus_pipeline.run(spark, folder)
        assert plan.columns[:2] == ["doc_id", "start"] and bool(plan.collect()) == bool(own)


def test_files_of_earlier_stages_are_deleted(spark, tmp_path):
    from medialake.llm import common

    folder = str(tmp_path)
    spark.createDataFrame(rows()[:12], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items(), BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    before = len(common._written)
    corpus_pipeline.run(spark, folder).collect()
    left = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in common._written[before:]]
    assert sorted(left) == ["pieces", "pieces-by-length", "stage-decontamination"]
