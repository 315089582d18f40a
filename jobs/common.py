"""What the jobs share: configs, logging and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession


def config(spark: SparkSession, path: str, known: dict[str, object]) -> dict[str, object]:
    """The settings of a JSON file, read by Spark, so that it may lie anywhere; unknown names are an error."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    given = json.loads(text)
    if unknown := given.keys() - known.keys():
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return known | given


def arguments(about: str, *names: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in names:
        parser.add_argument(f"--{name}", required=True, help=f"path of the {name}, on any file system that Spark reads")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
