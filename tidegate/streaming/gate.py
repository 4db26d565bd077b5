"""The stateless checks as a Structured Streaming job: the same columns on a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.scratch import shared_folder


def run_gate(spark: SparkSession, source: str, gate: Callable[[DataFrame], DataFrame], files_per_trigger: int = 64, out: str | None = None) -> DataFrame:
    """Stream the Parquet files at ``source`` through ``gate`` into Parquet files and return a reader of them.

    Runs until all files present at the start are done (availableNow). Offsets and rows lie below ``out``: a call with
    the same folder goes on where the last one ended, repeats at most one micro-batch, and the file sink keeps rows
    exactly once. Without ``out`` a new folder below the shared one is used, and every call starts anew.
    """
    schema = spark.read.parquet(source).schema
    out = out or f"{shared_folder(spark)}/tidegate-gate-{uuid.uuid4().hex}"
    folder, _, name = source.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A single file is streamed from its folder by name; a table folder as it is.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    is_file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(source)
    judged = gate(stream)
    query = judged.writeStream.format("parquet").option("checkpointLocation", f"{out}/_offsets").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(judged.schema).parquet(f"{out}/rows")
