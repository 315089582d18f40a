"""Timed segments: rolling-caption dedupe, slices, phrase search across segments, and passages."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from . import ordered

TARGET_CHARS, MAX_CHARS, BREAK_GAP = 800, 1200, 2.0
MAX_PATTERN = 200
MAX_PASSAGES_PER_VIDEO, MAX_PASSAGES = 2000, 100_000


class UnsafePatternError(ValueError):
    """A search pattern that is too long, repeats a repetition or refers back."""


def rolling_dedupe(cues: DataFrame, key: str = "video_id", order: str = "ord", one_task: int = ordered.ONE_TASK) -> DataFrame:
    """Cue lines ``(key, ord, start, end, text)`` without blank lines and repeats of the line before; neighbouring lines
    of one start are one segment, which ends with the last of them. Where a key has more than ``one_task`` lines, each
    range of them starts from the last line before it."""
    lines = cues.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    if ordered.hot(lines, key, one_task):
        runs = _runs_by_ranges(lines, key, order)
    else:
        by = W.partitionBy(key).orderBy(order)
        fresh = lines.withColumn("_before", F.lag("text").over(by)).filter(_differs("_before", "text"))
        new = F.coalesce((F.lag("start").over(by) != F.col("start")).cast("int"), F.lit(1))
        runs = fresh.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    line = F.struct(F.col(order).alias("o"), F.col("text").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.trim(x["t"])), " ")
    return runs.groupBy(key, "start", "_run").agg(F.min(order).alias(order), F.max_by("end", order).alias("end"), joined.alias("text")).drop("_run")


def _differs(before: str, own: str) -> Column:
    return F.col(before).isNull() | (F.col(before) != F.col(own))


def _runs_by_ranges(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Fresh lines with ``_run``, in two carries: the last text of earlier ranges says which first lines are repeats, and
    the starts at the ranges' edges where a run goes on."""
    by = ordered.inside(key, order)
    parts = ordered.carry(ordered.ranges(lines, key, order), key, F.max_by("text", order), lambda edge: F.last(edge, ignorenulls=True))
    fresh = parts.withColumn("_before", F.coalesce(F.lag("text").over(by), "_carried")).filter(_differs("_before", "text")).drop("_carried")
    # a key's first fresh line in a range is judged by its edge, all others within the range
    new = F.when(F.row_number().over(by) == 1, 0).otherwise(F.coalesce((F.lag("start").over(by) != F.col("start")).cast("int"), F.lit(1)))
    fresh = fresh.withColumn("_new", new)
    edges = fresh.groupBy("_part", key).agg(F.min_by("start", order).alias("_first"), F.max_by("start", order).alias("_last"), F.sum("_new").alias("_sum"))
    opens = F.coalesce((F.lag("_last").over(W.partitionBy(key).orderBy("_part")) != F.col("_first")).cast("int"), F.lit(1))
    edges = edges.withColumn("_opens", opens)
    so_far = ordered.attach(fresh, edges, key, {"_runs": F.sum(F.col("_opens") + F.col("_sum")).over(ordered.earlier(key)) + F.col("_opens")})
    return so_far.withColumn("_run", F.coalesce("_runs", F.lit(1)) + F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))


def slice_segments(segments: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    out = segments if start is None else segments.filter(F.col("end") > start)
    return out if end is None else out.filter(F.col("start") < end)


def check_pattern(source: str) -> None:
    """Refuses patterns that could take exponential time: repeated groups that hold a repetition or an alternative,
    and back references."""
    if len(source) > MAX_PATTERN:
        raise UnsafePatternError(f"patterns have {MAX_PATTERN} characters at most")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k)", source):
        raise UnsafePatternError("back references are not supported")
    plain = re.sub(r"\\.", "x", source)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "x", plain)
    plain = re.sub(r"\(\?(?:[:=!]|<[=!]|<\w+>)", "(", plain)
    inner = re.compile(r"\(([^()]*)\)([*+?]|\{\d+(?:,\d*)?\})?")
    while found := inner.search(plain):
        risky = re.search(r"[*+?|]|\{\d", found[1]) is not None
        if risky and found[2]:
            raise UnsafePatternError("a repeated group holds a repetition or an alternative")
        plain = plain[: found.start()] + ("x+" if risky or found[2] else "x") + plain[found.end() :]
    re.compile(source)


def search_pattern(query: str, regex: bool = False, case_sensitive: bool = False) -> str:
    if regex:
        check_pattern(query)
    else:
        query = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    return query if case_sensitive else f"(?iu){query}"


def find_phrase(segments: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, limit: int | None = None, key: str = "video_id", order: str = "ord") -> DataFrame:
    """Segments in which a match begins; the match may end in one of the two that follow. ``limit`` is that of each
    video's first segments."""
    by = W.partitionBy(key).orderBy(order)
    following = [F.lead("text", k).over(by) for k in (1, 2)]
    hay = segments.withColumn("_hay", F.concat_ws(" ", "text", *following))
    at = F.regexp_instr("_hay", F.lit(search_pattern(query, regex, case_sensitive)))
    found = hay.filter((at > 0) & (at - 1 <= F.length("text"))).drop("_hay")
    return found if limit is None else found.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= limit).drop("_n")


def passages(segments: DataFrame, chapters: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """``key, ord, start, end, text``: segments joined into passages. Lengths are in UTF-16 units.

    A passage ends at a chapter's start, at ``MAX_CHARS``, and at a pause of ``BREAK_GAP`` seconds from
    ``TARGET_CHARS`` on. One fold over a video's sorted segments decides the breaks; it keeps the begins of the
    passages only, and the texts are joined afterwards. Runs of blanks alone make no passage and take no number."""
    item = F.struct("start", "end", F.coalesce("text", F.lit("")).alias("text"))
    video = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("s")))).alias("segs"))
    video = video.withColumn("segs", F.transform("segs", lambda x: x["s"]))
    starts = F.array().cast("array<double>")
    if chapters is not None:
        marks = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.col("start").cast("double"))).alias("_marks"))
        video = video.join(marks, key, "left")
        starts = F.coalesce("_marks", starts)
    kept = cut_passages(video.withColumn("_starts", starts)).select(key, F.filter("passages", lambda p: p["text"] != "").alias("p"))
    return kept.select(key, F.posexplode("p").alias("ord", "p")).select(key, "ord", "p.start", "p.end", "p.text")


def cut_passages(video: DataFrame) -> DataFrame:
    """``video(segs array<struct<start, end, text>>, _starts array<double>, ..)``, a row a video with its sorted segments, with
    its ``passages`` in place of these two; blank ones are left in."""
    begins = F.expr(
        f"""aggregate(segs,
            named_struct('chars', 0, 'end', cast(null as double), 'at', cast(null as double), 'n', 0, 'begins', cast(array() as array<int>)),
            (a, s) -> transform(array(
                a.n = 0 OR exists(_starts, c -> c <= s.start AND (a.at IS NULL OR c > a.at)) OR a.chars >= {MAX_CHARS} OR (a.chars >= {TARGET_CHARS} AND s.start - a.end >= {BREAK_GAP})
            ), cut -> named_struct('chars', CASE WHEN cut THEN 0 ELSE a.chars END + cast(octet_length(encode(s.text, 'UTF-16BE')) div 2 as int) + 1, 'end', cast(s.end as double),
                'at', greatest(coalesce(a.at, s.start), s.start), 'n', a.n + 1, 'begins', CASE WHEN cut THEN concat(a.begins, array(a.n)) ELSE a.begins END))[0],
            a -> a.begins)"""
    )
    runs = video.withColumn("begins", begins)
    cut = F.expr(
        """transform(begins, (b, i) -> transform(array(slice(segs, b + 1, coalesce(get(begins, i + 1), size(segs)) - b)), run -> named_struct(
            'start', run[0].start, 'end', element_at(run, -1).end, 'text', trim(regexp_replace(array_join(transform(run, r -> r.text), ' '), '(?U)\\\\s+', ' '))))[0])"""
    )
    return runs.withColumn("passages", cut).drop("segs", "_starts", "begins")


def size_guards(counts: DataFrame, key: str = "video_id", corpus: str = "channel_id", order: str = "ord", step: int = 4096) -> DataFrame:
    """A video's state after the size limits: too many passages of its own, or no room left in the corpus.

    The running total has two steps, over ranges of ``step`` of the order and within each range, so no task sorts a
    whole corpus."""
    own = F.when(F.col("passages") > MAX_PASSAGES_PER_VIDEO, "TOO_LARGE")
    counted = counts.withColumn("_own", own).withColumn("_counted", F.when(own.isNull(), F.col("passages")).otherwise(0)).withColumn("_range", F.floor(F.col(order) / step))
    ranges = counted.groupBy(corpus, "_range").agg(F.sum("_counted").alias("_sum"))
    before = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(corpus).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum("_counted").over(W.partitionBy(corpus, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counted.withColumn("_inside", inside).join(before, [corpus, "_range"])
    full = F.col("_before") + F.col("_inside") > MAX_PASSAGES
    state = F.coalesce("_own", F.when(full, "CORPUS_FULL"), F.lit("indexed"))
    return placed.withColumn("state", state).select(*counts.columns, "state")


def best_source(transcripts: DataFrame, priority: dict[str, int], now: Column, keep_days: int = 30) -> DataFrame:
    """The fresh transcript of the best source for each video and language."""
    rank = F.coalesce(*(F.when(F.col("source") == s, p) for s, p in priority.items()), F.lit(len(priority)))
    fresh = transcripts.filter(F.col("fetched_at") >= now - F.expr(f"INTERVAL {keep_days} DAYS"))
    by = W.partitionBy("video_id", "lang").orderBy(rank, F.desc("fetched_at"))
    return fresh.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
