"""What the operators share: a durable work folder and the word definitions."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

# The two word definitions, as Java and as Python patterns over bytes.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Byte -> 1 where the byte belongs to a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary one if the driver
    is the only executor, and an error on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="medialake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/medialake/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, and a lost
    executor costs no more than the tasks it ran."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._medialake_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that no later plan reads."""
    for df in frames:
        own = (df.sparkSession, df._medialake_path)
        _remove(*own)
        if own in _written:
            _written.remove(own)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialise(make(), name)``, after which the work files that ``make`` left are deleted."""
    mark = len(_written)
    out = materialise(make(), name)
    for own in _written[mark:-1]:
        _remove(*own)
    del _written[mark:-1]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is temporary
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


#: Input bytes, as stored, that a task of a range sort is meant to take.
TASK_BYTES = 64 << 20


def shuffle_width(df: DataFrame) -> int:
    """Tasks of a shuffle of ``df``: the session's number, or more where its files are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    stored = sum(n for n in sizes if n < 1 << 60)  # beyond that the planner does not know
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // TASK_BYTES))
