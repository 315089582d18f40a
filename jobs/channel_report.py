"""A monthly report of each channel: what it published, how it was watched and discussed, and how far its comments are harvested.

    python -m jobs.channel_report --tables IN --output OUT --config jobs/channel_report.json

Reads the tables ``orders`` (videos), ``lineitem`` (comments) and ``customer`` (channels) of the folder IN and writes
``OUT/month=YYYY-MM``: a row for each channel that published in that month. ``since`` and ``until`` of the config bound the
months, inclusive; a run replaces the months that it computes and leaves all others, so running it again gives the same
files' contents. A month that has lost all its videos since the last run keeps its old rows, unless ``replace`` is set: then
the whole output is written anew.

Defined cases: videos without a date are in no month and are logged; a channel that is not in ``customer`` has no name; a video
without comments counts 0 of them; of several videos with the most views the lowest id is named; empty tables give an empty
report. All sums are of decimals and whole numbers, so they do not depend on the order of rows.
"""

from __future__ import annotations

import logging

import pyspark.sql.functions as F
from medialake.operators import coverage, query
from medialake.plans import tables
from pyspark.sql import DataFrame, SparkSession

from jobs import common

log = logging.getLogger("jobs.channel_report")

SETTINGS: dict[str, object] = {"since": None, "until": None, "replace": False}
REPORT = (
    "channel_id long, name string, videos long, views double, share double, stored_comments long, most_comments long, complete long, partial long, failed long, "
    "capped long, best_video long, first_upload date, last_upload date, month string"
)


def report(spark: SparkSession, folder: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The rows of the report, with their ``month``. Comments are counted before they meet the videos, and channels are joined
    to the sums, so one shuffle by video and one by channel carry all."""
    month = F.date_format("upload_date", "yyyy-MM")
    videos = tables.videos(spark, folder).filter("upload_date IS NOT NULL")
    bounds = [F.col("upload_date") >= F.to_date(F.lit(f"{since}-01"))] if since else []
    bounds += [F.col("upload_date") < F.add_months(F.to_date(F.lit(f"{until}-01")), 1)] if until else []
    for bound in bounds:  # on the date itself, so that it reaches the scan
        videos = videos.filter(bound)
    counted = query.stored_comment_counts(videos, tables.comments(spark, folder))
    states = coverage.receipts(tables.attempts(spark, folder)).select(F.col("target_id").alias("video_id"), "state", (F.col("reason") == "CAP_REACHED").alias("capped"))
    views = F.col("view_count").cast("decimal(18,2)")
    state = lambda name: F.count_if(F.col("state") == name).alias(name)
    by = counted.join(states, "video_id").withColumn("month", month).groupBy("month", "channel_id").agg(
        F.count("*").alias("videos"), F.sum(views).alias("views"), F.sum("stored_comments").alias("stored_comments"), F.max("stored_comments").alias("most_comments"),
        state("complete"), state("partial"), state("failed"), F.count_if("capped").alias("capped"), F.max_by("video_id", F.struct(F.coalesce(views, F.lit(-1)), -F.col("video_id"))).alias("best_video"),
        F.min("upload_date").alias("first_upload"), F.max("upload_date").alias("last_upload"),
    )
    # a row a month: bounded by the calendar
    months = videos.withColumn("month", month).groupBy("month").agg(F.sum(views).alias("month_views"))
    share = F.col("views").cast("double") / F.col("month_views").cast("double")
    named = by.join(F.broadcast(months), "month").join(tables.channels(spark, folder).select("channel_id", "name"), "channel_id", "left")
    return named.withColumns({"share": share, "views": F.col("views").cast("double")}).select(*(f.split()[0] for f in REPORT.split(", ")))


def run(spark: SparkSession, folder: str, output: str, since: str | None = None, until: str | None = None, replace: bool = False) -> int:
    """Writes the report and returns its number of rows."""
    output = output.rstrip("/")
    known = tables.videos(spark, folder).agg(F.count("*").alias("videos"), F.count_if(F.col("upload_date").isNull()).alias("undated")).first()
    log.info("read %d videos of %s, %d of them without a date; months %s to %s", known["videos"], folder, known["undated"], since or "first", until or "last")
    rows = report(spark, folder, since, until).hint("rebalance", "month")  # few files a month, and a large month in several tasks
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace else "dynamic").partitionBy("month").parquet(output)
    written = read(spark, output)
    written = written.filter(F.col("month") >= since) if since else written
    found = (written.filter(F.col("month") <= until) if until else written).agg(F.count("*").alias("n"), F.countDistinct("month").alias("months")).first()
    log.info("wrote %d rows of %d months to %s", found["n"], found["months"], output)
    return found["n"]


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def main() -> None:
    given = common.arguments(__doc__, "tables", "output", "config")
    spark = common.session("channel-report")
    try:
        run(spark, given.tables, given.output, **common.config(spark, given.config, SETTINGS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
