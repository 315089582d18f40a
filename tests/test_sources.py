import json
import struct

import pyspark.sql.functions as F
import pytest

from medialake.operators.store import Merge, Store
from medialake.sources import exports, files, listing, raw
from medialake.streaming import ingest, jobs


def test_ndjson(spark):
    lines = spark.createDataFrame([('{"id":"a","title":"x","duration":61.5}',), ("not json",), ('{"title":"no id"}',), ('[1]',), ('{"id":"b","upload_date":"20260101","thumbnails":[{"url":"s","width":1,"height":1},{"url":"l","width":9,"height":9}]}',)], "value string")
    rows = raw.listing_rows(raw.ndjson_lines(lines, raw.RAW_LISTING)).orderBy("video_id").collect()
    assert [(r.video_id, r.duration_s, r.thumbnail_url) for r in rows] == [("a", 61.5, None), ("b", 0.0, "l")]
    assert [r.title for r in rows] == ["x", "Unknown title"]


def test_documents(spark, tmp_path):
    texts = spark.createDataFrame([('{"a":1}',), ("{",)], "value string")
    assert [r.a for r in raw.json_documents(texts, "a int").collect()] == [1]
    with pytest.raises(Exception, match="not a valid document"):
        raw.json_documents(texts, "a int", strict=True).collect()
    for k, t in enumerate(['{"updated_at":1,"n":"x"}', '{"updated_at":2,"n":"y"}', "broken"]):
        (tmp_path / f"{k}.json").write_text(t)
    assert [r.n for r in raw.document_files(spark, str(tmp_path), "updated_at int, n string", "updated_at").collect()] == ["y", "x"]
    maps = spark.createDataFrame([('{"a":{"n":1},"b":"bad","c":{"n":3}}',)], "m string")
    assert {(r.key, r.value.n) for r in raw.records_of_map(maps, "m", "n int").collect()} >= {("a", 1), ("c", 3)}


def test_video_rows_and_captions(spark):
    line = json.dumps({"id": "v", "description": "d" * 600, "subtitles": {"en": [], "de": []}, "automatic_captions": {"en-orig": {}}})
    r = raw.video_stats(raw.ndjson_lines(spark.createDataFrame([(line,)], "value string"), raw.RAW_VIDEO)).first()
    assert (r.subtitle_languages, r.caption_languages, r.description_cut, r.tags) == (["en", "de"], ["en-orig"], True, [])
    assert (r.title, r.channel, r.duration_s, r.duration_formatted, r.description_chars, r.has_heatmap, r.unplayable) == ("Unknown", "Unknown", 0.0, "0:00", 600, False, None)
    line = json.dumps({"id": "w", "availability": "private", "duration": 61.5, "heatmap": [{"start_time": 0, "end_time": 1, "value": 0.5}]})
    r = raw.video_stats(raw.ndjson_lines(spark.createDataFrame([(line,)], "value string"), raw.RAW_VIDEO)).first()
    assert (r.duration_s, r.duration_formatted, r.has_heatmap, r.unplayable) == (61.5, "1:01", True, "PRIVATE")
    got = spark.range(1).select(raw.caption_inventory(F.array(F.lit("en"), F.lit("en-orig"), F.lit("de"), F.lit("en"))).alias("x")).first().x
    assert got == ["de", "en"]


def test_small_parsers(spark):
    f = raw.ndjson_lines(spark.createDataFrame([('{"formats":[{"format_id":"sb0"},{"format_id":"22","width":4,"height":3},{"format_id":"18","resolution":"r","vcodec":"v","filesize_approx":7.0},{"format_id":"140"}]}',)], "value string"), raw.RAW_FORMATS, "formats")
    assert [(r.resolution, r.vcodec, r.acodec, r.filesize) for r in raw.formats(f).collect()] == [("4x3", "none", "none", None), ("r", "v", "none", 7), ("audio only", "none", "none", None)]
    s = raw.ndjson_lines(spark.createDataFrame([('{"videoID":"v","segments":[{"category":"a","segment":[5,9]},{"category":"b","segment":[1,2]},{"category":"c","segment":[1]}]}',)], "value string"), raw.RAW_SPONSOR, "videoID")
    assert [(r.start, r.duration, r.votes) for r in raw.sponsor_segments(s, "v").collect()] == [(1.0, 1.0, 0), (5.0, 4.0, 0)]
    a = raw.ndjson_lines(spark.createDataFrame([('{"transcription":[{"offsets":{"from":500,"to":1500},"text":" hi "},{"offsets":{"from":1,"to":2},"text":"[BLANK_AUDIO]"},{"offsets":{"from":1,"to":2},"text":" "},{"offsets":{"from":2000,"to":3000},"text":"[Music]"}]}',)], "value string"), raw.RAW_ASR, "transcription")
    assert [(r.start, r.end, r.text) for r in raw.asr_segments(a).collect()] == [(0.5, 1.5, "hi"), (2.0, 3.0, "[Music]")]
    assert spark.range(1).select(raw.scene_cuts(F.lit("x pts_time:9.5 y pts_time:1 pts_time:9.5")).alias("c")).first().c == [1.0, 9.5]


def test_records_of_listings(spark):
    lines = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "value string")
    c = raw.ndjson_lines(lines({"id": "UCa", "title": "T"}, {"id": "x", "channel_id": "UCb", "channel": "C", "uploader_id": "@c"}), raw.RAW_SEARCHED_CHANNEL)
    assert [(r.channel_id, r.name, r.handle, r.subscriber_count) for r in raw.searched_channels(c).collect()] == [("UCa", "T", "", 0), ("UCb", "C", "@c", 0)]
    p = raw.playlist_info(raw.ndjson_lines(lines({"id": "PL1", "modified_date": "20260102", "playlist_count": 7}), raw.RAW_LISTING_META), F.lit("asked")).first()
    assert (p.title, p.video_count, str(p.last_modified), p.url) == ("Unknown", 7, "2026-01-02", "asked")
    assert [r.total for r in raw.listing_total(raw.ndjson_lines(lines({"id": "a"}, {"id": "b", "playlist_count": 3}), raw.RAW_LISTING_META)).collect()] == [None, 3]
    record = F.from_json(F.lit(json.dumps({"id": "v", "formats": [1], "description": 'q"\n' + "d" * 600})), "map<string,string>")
    raw_json = F.map_from_arrays(F.array(*map(F.lit, ["id", "formats", "description"])), F.array(F.lit('"v"'), F.lit("[1]"), F.lit(json.dumps('q"\n' + "d" * 600))))
    kept = spark.range(1).select(raw.stripped(raw_json).alias("m"), record.alias("r")).first().m
    assert set(kept) == {"id", "description", "description_truncated"} and json.loads(kept["description"]) == 'q"\n' + "d" * 497
    short = F.map_from_arrays(F.array(F.lit("id"), F.lit("comments")), F.array(F.lit('"v"'), F.lit("[]")))
    assert spark.range(1).select(raw.stripped(short).alias("m")).first().m == {"id": '"v"'}


def test_vtt(spark):
    text = "WEBVTT\n\nNOTE skip\n\n00:00.000 --> 00:02.000\nhello <c>everyone</c>\n\n1\n00:00:02.000 --> 00:00:04.000\nhello everyone\nwelcome &amp; back\n \n<v Ann>once <more\n\nbroken\n"
    got = files.read_vtt(spark.createDataFrame([("v", text)], "video_id string, text string")).orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 2.0, "hello everyone"), (2.0, 4.0, "welcome & back once")]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\0" * 9)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + b"\0" * 4)
    (tmp_path / "c.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))
    (tmp_path / "d.bin").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height) for r in files.read_image_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480), "b.jpg": ("jpeg", 30, 20), "c.webp": ("webp", 100, 50), "d.bin": (None, None, None)}


def test_exports(spark, tmp_path):
    # Cells that a spreadsheet or a Markdown reader would take for more than text.
    rows = spark.createDataFrame([("-id", '=HYPER("x")', 3), ("b", "a,b\nc", None), ("c", "+1", 4)], "videoId string, title string, viewCount long")
    lines = [r.line for r in exports.csv_lines(rows).collect()]
    assert lines == ['-id,"\'=HYPER(""x"")",3', 'b,"a,b\nc",', "c,'+1,4"]
    exports.write_csv(rows, str(tmp_path / "csv"), files=1)
    body = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert body.startswith(b"videoId,title,viewCount\r\n") and b'"\'=HYPER(""x"")"' in body and body.endswith(b"\r\n")
    cell = spark.createDataFrame([("a|b`c[d]<e>\r\nf\\",)], "t string").select(exports.markdown_cell(F.col("t")).alias("m")).first().m
    assert cell == "a\\|b\\`c\\[d\\]&lt;e&gt; f\\\\"
    exports.write_markdown(rows.repartition(3), str(tmp_path / "md"))
    written = [line for f in sorted((tmp_path / "md").glob("part-*.txt")) for line in f.read_text().splitlines()]
    assert written[:2] == ["| videoId | title | viewCount |", "| --- | --- | --- |"] and len(written) == 5
    receipts = spark.createDataFrame([("x",)], "target_id string")
    assert exports.export(rows, str(tmp_path / "json"), "json", receipts, limit=2) == {"rows": 2, "total": 3, "truncated": True}
    assert spark.read.text(str(tmp_path / "json" / "rows")).count() == 2
    segments = spark.createDataFrame([("v", 0, 0.0, 1.5, "one"), ("v", 1, 1.5, 3.0, "two")], "video_id string, ord int, start double, end double, text string")
    assert exports.subtitles(segments).first().text == "1\n00:00:00,000 --> 00:00:01,500\none\n\n2\n00:00:01,500 --> 00:00:03,000\ntwo\n"
    assert exports.subtitles(segments, "vtt").first().text.startswith("WEBVTT\n\n00:00:00.000 --> ")


def test_listing_source(spark, tmp_path):
    path = tmp_path / "l.ndjson"
    path.write_text("\n".join(['{"id":"a","title":"A"}', "broken", '{"id":"b"}', '{"title":"none"}', '{"id":"c"}']))
    spark.dataSource.register(listing.ListingSource)
    read = spark.read.format("media_listing").option("path", str(path))
    assert [r.video_id for r in read.load().orderBy("position").collect()] == ["a", "b", "c"]
    assert [r.video_id for r in read.option("start", 1).option("limit", 1).load().collect()] == ["b"]


def test_listing_positions_and_stream(spark, tmp_path):
    path, want = tmp_path / "l.ndjson", []
    with path.open("w") as out:
        for k in range(2500):
            if k % 7:
                want.append(f"v{k}")
                out.write(json.dumps({"id": f"v{k}", "title": "é" * (k % 50)}) + "\n")
            else:
                out.write(["broken", '{"title":"none"}', "", "[1]"][k % 4] + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = {r.position: r.video_id for r in listing.positions(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [found[k] for k in range(len(want))] == want and len(found) == len(want)
    reader, at, got = listing.ListingStream({"path": str(path), "page": "300"}), None, []
    at = reader.initialOffset()
    while True:
        rows, after = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, after)) == rows
        if not rows:
            break
        got, at = got + rows, after
    assert [r[1] for r in got] == want and [r[0] for r in got] == list(range(len(want)))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", "failed", 1), ("a", "indexed", 2), ("a", "failed", 3), ("b", "failed", 1)], "video_id string, outcome string, at int")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    jobs.item_states(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.video_id, r.state, r.tries) for r in jobs.latest_states(spark, str(tmp_path / "out")).collect()} == {("a", "indexed", 2), ("b", "failed", 1)}
    jobs.event_log(spark.readStream.schema(rows.schema).parquet(str(src)), str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    s = Store(spark, f"file://{tmp_path}/store")
    jobs.upsert_stream(spark.readStream.schema(rows.schema).parquet(str(src)), s, "state", "video_id", "at", ["outcome"], str(tmp_path / "cp3")).awaitTermination(60)
    assert {(r.video_id, r.outcome) for r in s.read("state").collect()} == {("a", "failed"), ("b", "failed")}
    again = s.manifest()["tables"]["state"]
    one = spark.createDataFrame([("a", "indexed", 9)], "video_id string, outcome string, at int")
    s.commit(merges={"state": Merge(one, "video_id", "at", ["outcome"])})
    after = s.manifest()["tables"]["state"]
    assert {(r.video_id, r.outcome) for r in s.read("state").collect()} == {("a", "indexed"), ("b", "failed")}
    assert sum(after["parts"][b] != p for b, p in again["parts"].items()) == 1  # the other bucket stays where it is


def test_build_checkpoints_and_stops(spark, tmp_path):
    words = "ring the little bell"
    queue = spark.createDataFrame([(f"v{k}", k) for k in range(25)], "video_id string, ord int")

    def reader(refused):
        def read(step):
            error = F.when(F.col("ord").isin(refused), ingest.THROTTLED)
            states = step.withColumn("error", error).withColumn("state", F.when(error.isNull(), "indexed").otherwise("failed"))
            return states, step.filter(error.isNull()).select("video_id", F.lit(0).alias("ord"), F.lit(words).alias("text"))

        return read

    s = Store(spark, f"file://{tmp_path}/whole")
    assert ingest.build(s, queue, reader([3, 4, 9])) == ingest.Build(25, 3, None)
    assert s.read("state").count() == 25 and s.read("passage").count() == 22 and [r.phrase for r in s.read("phrase").collect()] == [words]
    s = Store(spark, f"file://{tmp_path}/cut")
    done = ingest.build(s, queue, reader([9, 10, 11, 12]))
    assert (done.attempted, done.checkpoints) == (12, 2) and "throttling" in done.stop_reason
    assert s.read("state").count() == 12 and s.read("passage").count() == 9


def test_segments_by_prefix(spark):
    import hashlib

    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()[: raw.PREFIX_DIGITS]
    part = lambda at: [("sponsor", [at, at + 1.0], None)]
    kind = "prefix string, videoID string, segments array<struct<category:string,segment:array<double>,votes:int>>"
    answers = spark.createDataFrame([(sha("a"), "a", part(1.0)), (sha("a"), "neighbour", part(2.0)), (sha("b"), "a", part(3.0)), (sha("c").upper(), "c", part(4.0)), (sha("c"), "c", part(5.0)), (sha("d"), "d", None), (sha("e"), None, part(6.0))], kind)
    videos = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), ("none",), (None,)], "id string")
    got = raw.segments_by_prefix(videos, answers, "id")
    assert sorted((r.id, r.start, r.votes) for r in got.collect()) == [("a", 1.0, 0), ("c", 4.0, 0), ("c", 5.0, 0)]
    assert raw.segments_by_prefix(videos.limit(0), answers, "id").count() == 0
