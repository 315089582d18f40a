import random

import pyspark.sql.functions as F
import pytest

from medialake.functions import scalars as X
from medialake.functions import text as T


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_timestamps(spark):
    got = values(spark, [(0.0,), (62.0,), (3723.0,), (3600.0,), (-5.0,)], "s double", X.format_timestamp("s"))
    assert got == ["0:00", "1:02", "1:02:03", "1:00:00", "0:00"]
    got = values(spark, [(0.0,), (62.5,), (3723.25,), (1.9996,), (-3.2,)], "s double", X.subtitle_timestamp("s"))
    assert got == ["00:00:00,000", "00:01:02,500", "01:02:03,250", "00:00:02,000", "00:00:00,000"]
    got = values(spark, [(0.0,), (65.5,), (3605.0,), (-1.0,)], "s double", X.format_duration("s"))
    assert got == ["0:00", "1:5.5", "1:00:05", "-1:-1"]
    assert values(spark, [("id", 62.7), ("id", -3.0)], "v string, s double", X.deep_link("v", "s")) == ["https://www.youtube.com/watch?v=id&t=62s", "https://www.youtube.com/watch?v=id&t=0s"]


def test_parse_timestamp(spark):
    got = values(spark, [("90",), ("1:30",), ("01:02:03.5",), ("1:75",), ("x",), ("",), (None,), ("75:10",), ("0:61:00",), ("1:05",), (" 100:59:59.9 ",), ("1:2:3:4",), ("1:",), ("-5",), ("1:005",)], "t string", X.parse_timestamp("t"))
    assert got == [90.0, 90.0, 3723.5, None, None, None, None, None, None, 65.0, 363599.9, None, None, None, None]


def test_dates_and_counts(spark):
    got = values(spark, [("20260101",), ("2026-01-01",), ("202601",), ("20261345",), (None,)], "t string", X.upload_date("t").cast("string"))
    assert got == ["2026-01-01", "2026-01-01", None, None, None]
    got = values(spark, [(999,), (1500,), (2000000,), (3100000000,)], "n long", X.format_count("n"))
    assert got == ["999", "1.5K", "2M", "3.1B"]
    # a double just below a tie goes down, an exact tie up
    assert values(spark, [(1150,), (1250,), (1350,), (999999,), (999949,)], "n long", X.format_count("n")) == ["1.1K", "1.3K", "1.4K", "1000K", "999.9K"]
    got = values(spark, [(0,), (None,), (5,), (2048,), (5 << 20,), (3 << 30,), (1234567890,)], "n long", X.format_filesize("n"))
    assert got == ["Unknown", "Unknown", "0.0 KB", "2.0 KB", "5.0 MB", "3.00 GB", "1.15 GB"]


def test_filesize_just_below_a_tie(spark, tmp_path):
    """3,269,543,854 bytes are 3.04499999973 GB: the library rounds the exact value, the query adds what its SQL adds."""
    from medialake.plans import behaviours

    assert values(spark, [(3269543854,)], "n long", X.format_filesize("n")) == ["3.04 GB"]
    spark.createDataFrame([(3279382,), (5,)], "event_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    assert {tuple(r) for r in behaviours.filesize_format(spark, f"file://{tmp_path}").collect()} == {(3279382, "3.05 GB"), (5, "Unknown")}


def test_ngrams_of_a_table(spark, tmp_path):
    """Runs of a whole table are counted without a join, and are those of the table function."""
    from medialake.plans import behaviours

    spark.createDataFrame([("a b a b",), ("It's a B",), (None,), ("one",), ("a b a b",)], "text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = behaviours.sql_ngrams(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in found.collect()} == {("a b", 5), ("b a", 2), ("it's a", 1)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in spark.sql("SELECT * FROM ngrams('a b a', 2) ORDER BY place").collect()] == [(0, "a b"), (1, "b a")]


def test_to_fixed_is_exact(spark):
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(3)
    rows = [(r.choice([r.random() * 10 ** r.randint(-2, 6), r.randint(0, 9999) / 100, r.randint(0, 99999) / 1000]),) for _ in range(2000)]
    for decimals in (1, 2):
        got = values(spark, rows, "x double", X.to_fixed(F.col("x"), decimals))
        assert got == [str(Decimal(x).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)) for (x,) in rows]


def test_ids_and_urls(spark):
    rows = [("dQw4w9WgXcQ",), ("https://youtu.be/dQw4w9WgXcQ?t=1",), ("https://www.youtube.com/shorts/dQw4w9WgXcQ",), ("https://example.com/",), (None,)]
    assert values(spark, rows, "u string", X.video_id("u")) == ["dQw4w9WgXcQ"] * 3 + [None, None]
    rows = [("http://youtube.com/@a",), ("youtube.com/@a",), ("https://evil.com/youtube.com",), ("https://u@youtube.com/",), ("https://youtube.com:8080/",), ("ftp://youtube.com/",)]
    assert values(spark, rows, "u string", X.allowed_url("u")) == ["https://youtube.com/@a", "https://youtube.com/@a", None, None, None, None]
    assert values(spark, [("@name",), ("UC" + "a" * 22,), ("nothing",)], "u string", X.list_target("u")) == ["https://www.youtube.com/@name", "https://www.youtube.com/channel/UC" + "a" * 22, None]
    assert values(spark, [("dQw4w9WgXcQ",)], "u string", X.hash_prefix("u")) == ["5f6b"]


def test_codes(spark):
    assert values(spark, [("private", None), (None, "post_live"), (None, "is_live")], "a string, l string", X.playability("a", "l")) == ["PRIVATE", "LIVE_NOT_ENDED", None]
    assert values(spark, [("x http error 429 y",), ("??",)], "e string", X.failure_code("e")) == ["RATE_LIMITED", X.FAILURE_FALLBACK]
    assert values(spark, [("..a/b: c\t d",), ("",)], "t string", X.safe_stem("t", F.lit("f"))) == ["ab c d", "f"]


def test_tags_keep_their_order(spark):
    assert values(spark, [(["z", "a"],), (None,)], "t array<string>", X.merge_tags("t", F.array(F.lit("m"), F.lit("a")))) == [["z", "a", "m"], ["m", "a"]]
    assert X.FAILURE_FALLBACK == "YTDLP_FAILED"


def test_even_times(spark):
    got = values(spark, [(0.0, 600.0)], "a double, b double", X.midpoints(F.col("a"), F.col("b"), 4))
    assert got == [[75.0, 225.0, 375.0, 525.0]]


@pytest.mark.parametrize(("text", "tokens"), [("Hello, World! Foo-bar", ["hello", "world", "foo", "bar"]), ("the quick and the dead", ["quick", "dead"]), ("a b cd", ["cd"]), ("café über 日本語", ["café", "über", "日本語"]), (None, [])])
def test_tokens(spark, text, tokens):
    assert values(spark, [(text,)], "t string", T.tokens("t")) == [tokens]


def test_excerpt_and_window(spark):
    long = "a" * 200 + " needle " + "b" * 200
    got = values(spark, [(long,), ("needle here",), ("nothing",)], "t string", T.excerpt("t", ["needle"]))
    assert got[0].startswith("…") and got[0].endswith("…") and "needle" in got[0] and got[1:] == ["needle here", "nothing"]
    got = values(spark, [("one two three four five",)], "t string", T.text_window("t", 0, 12))[0]
    assert (got.text, got.truncated, got.next_offset) == ("one two", True, 7)


def test_blanks_of_any_kind(spark):
    assert values(spark, [("a  b ﻿ c\n",)], "t string", T.word_count("t")) == [3]
