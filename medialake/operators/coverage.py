"""Completeness receipts: whether a set of rows may be called complete, and why not."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.scalars import to_fixed

STALE_AFTER_DAYS = 7
EXHAUSTED = "source-exhausted"

# Reasons of a failed attempt, outcomes that end a detail run with the reasons that they give, and the words for scopes and reasons.
FAILED_REASONS = ["SOURCE_REFUSED", "TIMEOUT"]
STOPPING = {"BOT_CHECK": "SOURCE_REFUSED", "LOGIN_REQUIRED": "SOURCE_REFUSED", "RATE_LIMITED": "RATE_LIMITED", "CANCELLED": "CANCELLED"}
UNREADABLE_NOTE = " cannot be read (private, members-only, age-gated, removed or failing), so this stays incomplete."
UNITS = {"catalog": "videos", "details": "videos", "comments": "comments", "channel-catalog": "videos", "video-details": "videos", "video-comments": "comments"}
ESTIMATED = ["comment_count", "youtube:comment_count"]
WHY = {
    "COMPLETE": "complete", "CAP_REACHED": "stopped by the requested cap", "BUDGET_SPENT": "stopped when the time budget ran out",
    "RATE_LIMITED": "stopped because YouTube throttled this client", "CANCELLED": "cancelled by the client", "TIMEOUT": "timed out",
    "SOURCE_REFUSED": "YouTube refused this content to the current session", "COMMENTS_DISABLED": "comments are turned off for this video",
    "SOURCE_SILENT": "YouTube states no total, so exhaustion cannot be proven", "PARTIAL_ERROR": "some items failed", "NOT_ATTEMPTED": "not attempted yet",
}


def cap_binding() -> Column:
    return F.col("limit_applied").isNotNull() & (F.col("have") >= F.col("limit_applied"))


def provably_complete() -> Column:
    met = F.when(F.col("expected_source") == EXHAUSTED, F.coalesce(F.col("ran_to_exhaustion"), F.lit(True))).otherwise(F.col("have") >= F.col("expected"))
    return ~cap_binding() & F.col("expected").isNotNull() & F.coalesce(met, F.lit(False))


def reason_of(complete: Column) -> Column:
    given = F.col("reason").isNotNull() & (F.col("reason") != "COMPLETE")
    return F.when(complete, "COMPLETE").when(given, F.col("reason")).when(cap_binding(), "CAP_REACHED").otherwise("SOURCE_SILENT")


def receipts(attempts: DataFrame) -> DataFrame:
    """Receipts of ``attempts(scope, target_id, have, expected, expected_source, ran_to_exhaustion, limit_applied,
    reason, resume_token, harvested_at)``; all but the first three may be null."""
    done = provably_complete()
    out = attempts.withColumn("_complete", done).withColumn("reason", reason_of(F.col("_complete")))
    out = out.withColumn("stale_after", F.when(F.col("_complete"), F.col("harvested_at") + F.expr(f"INTERVAL {STALE_AFTER_DAYS} DAYS")))
    out = out.withColumn("resume_token", F.when(~F.col("_complete"), F.col("resume_token")))
    state = F.when(F.col("_complete"), "complete").when(F.col("reason").isin(FAILED_REASONS), "failed").when(F.col("reason") == "NOT_ATTEMPTED", "running").otherwise("partial")
    return out.withColumn("state", state).withColumnRenamed("_complete", "complete")


def violations(rows: DataFrame) -> DataFrame:
    """Receipts that break an invariant, with the rule's name; none for receipts made by ``receipts``."""
    complete, reason = F.col("complete"), F.col("reason")
    enough = (F.col("expected_source") == EXHAUSTED) | (F.col("have") >= F.col("expected"))
    rules = {
        "complete-with-reason": complete & (reason != "COMPLETE"),
        "reason-complete-only": ~complete & (reason == "COMPLETE"),
        "expected-without-source": F.col("expected").isNull() != F.col("expected_source").isNull(),
        "complete-unproven": complete & ~F.coalesce(enough, F.lit(False)),
        "complete-with-token": complete & F.col("resume_token").isNotNull(),
        "complete-at-cap": cap_binding() & (reason == "COMPLETE"),
    }
    broken = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def catalogue_receipt(tabs: DataFrame) -> DataFrame:
    """A channel's receipt from its tabs ``(channel_id, tab, present, listed, page_full)``: complete if every tab
    is, where a tab that does not exist is complete and a full page is not."""
    done = ~F.col("present") | ~F.col("page_full")
    return tabs.groupBy(F.col("channel_id").alias("target_id")).agg(F.sum(F.when(F.col("present"), F.col("listed")).otherwise(0)).alias("have"), F.bool_and(done).alias("complete"))


def details_expected(details: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Expected counts of detail receipts: the catalogue's size, only where its receipt is complete."""
    known = catalogue.filter("complete").select("target_id", F.col("have").alias("expected"))
    return details.join(known, "target_id", "left").withColumn("expected_source", F.when(F.col("expected").isNotNull(), "catalogue"))


def detail_attempts(made: DataFrame, state: DataFrame, max_videos: int, now: Column) -> DataFrame:
    """What ``receipts`` takes of detail runs, with ``note``: a row for each channel of ``state(target_id, videos, detailed,
    unreadable, remaining, catalogue_complete)``, which is the store after the run; ``made(target_id, ord, code)`` are the
    reads that were made, none for a channel whose queue was empty.

    A stopping code gives the reason; without one, unread videos at the end of the queue do. The cap binds if that many
    were read and some are left. The catalogue's size is the expected count only if the catalogue is whole."""
    stopping = F.col("code").isin(list(STOPPING))
    ran = made.groupBy("target_id").agg(F.count("*").alias("_attempted"), F.count("code").alias("_failed"), F.min_by("code", F.when(stopping, F.col("ord"))).alias("_stopped"))
    rows = state.join(ran, "target_id", "left")
    left, stopped = F.col("remaining") > 0, F.col("_stopped").isNotNull()
    failed = (F.coalesce("_failed", F.lit(0)) > 0) | (F.col("unreadable") > 0)
    why = F.coalesce(*(F.when(F.col("_stopped") == code, reason) for code, reason in STOPPING.items()))
    whole = F.coalesce("catalogue_complete", F.lit(False))
    unread = F.concat(F.format_number("unreadable", 0), F.when(F.col("unreadable") == 1, " video").otherwise(" videos"), F.lit(UNREADABLE_NOTE))
    return rows.select(
        F.lit("video-details").alias("scope"), "target_id", F.col("detailed").alias("have"), F.when(whole, F.col("videos")).alias("expected"), F.when(whole, "store:catalog").alias("expected_source"),
        F.lit(None).cast("boolean").alias("ran_to_exhaustion"), F.when((F.coalesce("_attempted", F.lit(0)) >= max_videos) & left, F.lit(max_videos)).cast("long").alias("limit_applied"),
        F.when(stopped, why).when(~left & failed, "PARTIAL_ERROR").alias("reason"), F.when(left | stopped, F.concat(F.lit("details:"), F.col("target_id").cast("string"))).alias("resume_token"),
        now.alias("harvested_at"), F.when(F.col("unreadable") > 0, unread).alias("note"),
    )


def verify(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Receipts that claim another count than is ``stored(target_id, n)``, downgraded."""
    counted = rows.join(stored, "target_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = counted.filter(F.col("n") != F.col("have")).withColumn("complete", F.lit(False)).withColumn("reason", F.lit("PARTIAL_ERROR"))
    return wrong.withColumnRenamed("n", "stored")


def summary(rows: DataFrame, now: Column) -> DataFrame:
    stale = F.col("complete") & (F.col("stale_after") < now)
    return rows.agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(stale).alias("stale"))


def sentence() -> Column:
    """A receipt's first line: the counts, the share, and the target. A stated count is an estimate."""
    percent = F.col("have") / F.col("expected") * 100
    shown = F.when((percent < 0.1) & (percent > 0), "<0.1").otherwise(to_fixed(percent, 1))
    share = F.when(F.col("expected") > 0, F.concat(F.lit(" ("), shown, F.lit("%)"))).otherwise("")
    about = F.when(F.coalesce(F.col("expected_source"), F.lit("")).isin(ESTIMATED), "about ").otherwise("")
    have = F.format_number("have", 0)
    whole = F.concat(have, F.lit(" of "), about, F.format_number("expected", 0), F.lit(" "), _unit(), share)
    of = F.when(F.col("expected").isNull(), F.concat(have, F.lit(" "), _unit())).otherwise(whole)
    return F.concat(F.lit("Coverage: "), of, F.lit(" for "), F.col("target_id").cast("string"), F.lit("."))


def _unit() -> Column:
    return F.coalesce(*(F.when(F.col("scope") == k, v) for k, v in UNITS.items()), F.lit("items"))


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text() -> Column:
    """A receipt in words: the counts; whether it is complete, or why not and what must not be said of it; the sort's
    bias; when to look again; the note. ``sort_applied`` and ``note`` may be null."""
    why = F.coalesce(*(F.when(F.col("reason") == k, v) for k, v in WHY.items()), F.col("reason"))
    bias = F.when((F.col("sort_applied") == "top") & F.col("limit_applied").isNotNull(), ', sorted by "top" (a biased prefix, not a random sample)').otherwise("")
    done = F.concat(F.lit("COMPLETE \u2014 "), why, F.lit(", harvested "), _iso(F.col("harvested_at")), F.lit("."))
    again = F.concat(F.lit("Re-check after "), _iso(F.col("stale_after")), F.lit(" (this can change upstream)."))
    what = F.when(_unit() == "comments", "comment history").otherwise("video list")
    left = F.concat(F.lit("INCOMPLETE \u2014 "), why, bias, F.lit("."))
    warning = F.concat(F.lit("Do not describe this as the full "), what, F.lit("."))
    return F.concat_ws("\n", sentence(), F.when(F.col("complete"), done).otherwise(left), F.when(F.col("complete"), again).otherwise(warning), F.when(~F.col("complete"), F.col("note")))


def report(rows: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Receipts as they stand against the store: one that claims another count of comments than ``stored(target_id, n)``
    has is incomplete, with the store's count. ``receipt_have`` is what it claimed, ``stale`` whether it is complete
    and past its date."""
    counted = rows.join(stored.select("target_id", F.col("n").alias("_n")), "target_id", "left").withColumn("receipt_have", F.col("have"))
    checked = F.when(F.col("scope").isin("comments", "video-comments"), F.coalesce("_n", F.lit(0))).otherwise(F.col("have"))
    wrong = checked != F.col("receipt_have")
    out = counted.withColumn("have", checked).withColumn("reason", F.when(wrong, "PARTIAL_ERROR").otherwise(F.col("reason"))).withColumn("complete", F.col("complete") & ~wrong)
    return out.withColumn("stale", F.col("complete") & (F.col("stale_after") < now)).drop("_n")
