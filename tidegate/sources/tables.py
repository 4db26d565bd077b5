"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder`` (one file or a folder of part files)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``max_rows`` rows, else as it is.

    The proof costs one job that stops after ``max_rows + 1`` rows; beyond the bound the optimiser is left to
    pick a shuffled join from the sizes it sees at run time.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
