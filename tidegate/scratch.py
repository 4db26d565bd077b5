"""Materialised intermediate results in the folder that all executors share.

``materialize`` cuts lineage by writing a Parquet table below ``spark.checkpoint.dir``; a lost executor
therefore costs no recomputation and no data. Only where that setting is absent and the session runs on one
machine (tests, bench) is a folder of our own used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidegate-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidegate-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path`` when the interpreter ends."""
    _written.append((spark, path))


def discard(df: DataFrame) -> None:
    """Remove the files behind a ``materialize`` result that nothing reads any more."""
    for spark, path in list(_written):
        if any(path.split("://")[-1] in f for f in df.inputFiles()):
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder's owner cleans up
            pass
