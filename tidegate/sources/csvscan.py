"""Typed CSV sources and the prepared-table cache.

Types are forced, never inferred: the header is checked before the scan, every feature is read as double, the label
as text, and a row that does not parse fails the job (``operators.rowparse`` sets such rows aside instead).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegate.functions.numeric import all_finite, any_of
from tidegate.operators.scan import check_drop_columns


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Trimmed column names of the first line."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return [c.strip().strip('"') for c in first[0][0].split(",")]


def read_flows(spark: SparkSession, path: str, label: str = "label", drop: Sequence[str] = (), expected: Sequence[str] | None = None) -> DataFrame:
    """One CSV or a folder of them as doubles and a label; dropped columns go first.

    A header unlike ``expected``, an unknown column to drop and a missing label column raise."""
    header = read_header(spark, path)
    if expected is not None and list(expected) != header:
        raise ValueError(f"header differs from the expected one: {header}")
    if label not in header:
        raise ValueError(f"no column {label!r} in {header}")
    check_drop_columns(header, drop)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    text = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return text.drop(*drop).select(*(F.col(f"`{c}`") if c == label else _double(c) for c in header if c not in drop))


def _double(name: str) -> Column:
    """Number, NaN or infinity in any usual spelling; a blank field is null, anything else fails the job."""
    c = F.col(f"`{name}`")
    value = c.try_cast("double")
    failed = F.raise_error(F.concat(F.lit(f"{name} is no number: "), c)).cast("double")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(None).cast("double")).when(value.isNull(), failed).otherwise(value).alias(name)


def fingerprint(source: dict, settings: dict) -> str:
    """Key of a prepared table: name and size of the source and all settings that decide its content, not its times."""
    return hashlib.sha1(json.dumps({"source": source, "settings": settings}, sort_keys=True, default=str).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def source_size(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    return {"name": p.getName(), "bytes": fs.getContentSummary(p).getLength()}


def source_state(spark: SparkSession, path: str) -> dict:
    """What changes when a file or folder is written anew: its size and time."""
    fs, p = _fs(spark, path)
    return {"bytes": fs.getContentSummary(p).getLength(), "time": fs.getFileStatus(p).getModificationTime()}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file next to a table, on whatever file system the table is."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True))


def cached(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path`` if its sidecar holds ``key``, else built, written (snappy) and read back."""
    sidecar = f"{path}.json"
    if not rebuild and exists(spark, sidecar) and exists(spark, path) and json.loads(read_text(spark, sidecar))["key"] == key:
        return spark.read.parquet(path)
    build().write.mode("overwrite").option("compression", "snappy").parquet(path)
    write_json(spark, sidecar, {"key": key})
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, features: Sequence[str], split_col: str = "split_name") -> None:
    """Scaled rows, one folder per split; rows outside [0, 1] or not finite raise before anything is written."""
    off = df.where(~all_finite(features) | any_of([(F.col(c) < 0.0) | (F.col(c) > 1.0) for c in features])).limit(1).count()
    if off:
        raise ValueError("scaled rows must be finite and within [0, 1]")
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
