"""Work files: intermediate tables in a folder that all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and nothing but this machine computes."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="medialake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/medialake/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back, so that it is computed once and lineage ends there."""
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
        _written.remove(own)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Input bytes, as stored, that a task of a wide shuffle is meant to take.
TASK_BYTES = 16 << 20


def stored(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as far as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def width(df: DataFrame) -> int | None:
    """Tasks for a shuffle of ``df`` that grow with its files; None while the session's own number is enough."""
    n = -(-stored(df) // TASK_BYTES)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def small(df: DataFrame) -> bool:
    """Whether the files of ``df`` are so small that they are read in fewer tasks than there are cores."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return stored < spark.sparkContext.defaultParallelism * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """``df`` dealt to all cores if it is small; files of a core's share of ``maxPartitionBytes`` or more are left as the
    scan splits them, unless ``task_bytes`` says how many of their bytes a task takes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        return df.repartition(max(cores, -(-stored(df) // task_bytes)))
    return df.repartition(cores) if small(df) else df


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                continue
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is temporary
            continue
