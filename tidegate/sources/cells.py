"""Perturbation cells on disk: a table partitioned by attack and model that can be filled bit by bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.folds import check_cells_aligned
from tidegate.sources.csvscan import exists

BY = ["attack", "model"]


def cell_exists(spark: SparkSession, path: str, attack: str, model: str) -> bool:
    return exists(spark, f"{path}/attack={attack}/model={model}")


def save_cell(rows: DataFrame, path: str, attack: str, model: str, force: bool = False, eps: float | None = None) -> bool:
    """Write one cell unless it is there already; True if written. Rows beyond [0, 1] or eps raise.

    Columns: source_id, x_clean, x_adv, and any others."""
    spark = rows.sparkSession
    if not force and cell_exists(spark, path, attack, model):
        return False
    off = F.exists("x_adv", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    if eps is not None:
        off = off | F.exists(F.zip_with("x_adv", "x_clean", lambda a, b: F.abs(a - b) > eps + 1e-6), lambda v: v)
    if rows.where(off).limit(1).count():
        raise ValueError(f"cell {attack} x {model} has rows outside the domain")
    rows.write.mode("overwrite").parquet(f"{path}/attack={attack}/model={model}")
    return True


def load_cells(spark: SparkSession, path: str, attacks: Sequence[str] | None = None) -> DataFrame:
    """All cells as one table; only the folders of the wanted attacks are read. Cells of different rows raise."""
    cells = spark.read.parquet(path)
    if attacks is not None:
        cells = cells.where(F.col("attack").isin(list(attacks)))
    check_cells_aligned(cells, "source_id", BY)
    return cells


def check_manifest(spark: SparkSession, path: str, rows: DataFrame, id_col: str) -> None:
    """Write the source rows' ids once; later calls with other rows raise."""
    now = rows.select(F.col(id_col).cast("long").alias("id"))
    if not exists(spark, path):
        now.write.parquet(path)
        return
    then = spark.read.parquet(path)
    if now.exceptAll(then).limit(1).count() or then.exceptAll(now).limit(1).count():
        raise ValueError("these cells were made from other source rows")
