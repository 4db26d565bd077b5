"""Cleaning ledger, column decisions and the class table. Decisions read the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegate.functions.numeric import finite, signed_log1p
from tidegate.operators.order import exact_quantiles
from tidegate.operators.scan import float32, is_bad


def clean_rows(df: DataFrame, features: Sequence[str], code_col: str) -> DataFrame:
    """Rows without a null, NaN or infinite feature, exact duplicates (features and code, float32) removed.

    Which of several equal rows stays is not defined; use ``scan.vectors`` where the first is wanted."""
    keys = {f"_k{i}": c for i, c in enumerate(float32(features))}
    return df.where(~is_bad(features)).withColumns(keys).dropDuplicates([*keys, code_col]).drop(*keys)


def clean_ledger(df: DataFrame, features: Sequence[str], code_col: str) -> DataFrame:
    """Per code: rows, rows dropped as bad, rows dropped as duplicates, rows kept."""
    bad = df.groupBy(F.col(code_col).alias("code")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_bad(features)).alias("n_bad"))
    good = df.where(~is_bad(features)).select(*float32(features), F.col(code_col).alias("_code")).distinct()
    kept = good.groupBy("_code").agg(F.count(F.lit(1)).alias("n_kept"))
    joined = bad.join(kept, F.col("code").eqNullSafe(F.col("_code")), "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return joined.select("code", "n_rows", "n_bad", (F.col("n_rows") - F.col("n_bad") - F.col("n_kept")).alias("n_duplicates"), "n_kept")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, x): one row per row and column."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(F.inline(cells))


def constancy(df: DataFrame, columns: Sequence[str], tol: float = 0.0, min_non_mode_rows: int = 100) -> DataFrame:
    """Per column its spread, the rows off its most frequent value, and whether it is (nearly) constant.

    Values are counted before the shuffle, so a column with one value sends one row per task."""
    counts = long_form(df, columns).where(F.col("x").isNotNull()).groupBy("column_name", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column_name").agg((F.max("x") - F.min("x")).alias("spread"), (F.sum("n") - F.max("n")).alias("n_non_mode"))
    return per.withColumn("near_constant", (F.col("spread") <= tol) | (F.col("n_non_mode") < min_non_mode_rows))


def near_constant_columns(df: DataFrame, columns: Sequence[str], tol: float = 0.0, min_non_mode_rows: int = 100) -> list[str]:
    found = {r.column_name for r in constancy(df, columns, tol, min_non_mode_rows).where("near_constant").collect()}
    return [c for c in columns if c in found]


def tail_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column min, median, 99th percentile (exact, interpolated), max, span, positions, shares of 0 and integers."""
    long = long_form(df, columns).where(finite(F.col("x")))
    per = long.groupBy("column_name").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg((F.col("x") == 0).cast("double")).alias("frac_zero"),
        F.avg((F.col("x") == F.rint("x")).cast("double")).alias("frac_integer"), F.count_if(F.col("x") < 0).alias("n_negative"),
    )
    per = per.join(exact_quantiles(long, ["column_name"], "x", [0.5, 0.99], few_groups=True), "column_name")
    span = F.col("max") - F.col("min")
    where = lambda i: F.coalesce(F.try_divide(F.col("q")[i] - F.col("min"), span), F.lit(0.0))
    return per.select(
        "column_name", "min", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"), "max", span.alias("span"),
        where(0).alias("p50_position"), where(1).alias("p99_position"), "frac_zero", "frac_integer", "n_negative",
    )


def log1p_columns(stats: DataFrame, position: float = 0.02, min_span: float = 10.0) -> DataFrame:
    """Columns whose median sits strictly below ``position`` of a span strictly above ``min_span``."""
    return stats.where((F.col("p50_position") < position) & (F.col("span") > min_span)).select("column_name", "p50_position", "span")


def resolve_log1p(stats: DataFrame, columns: Sequence[str] | str = "auto", **rule: float) -> list[str]:
    """``'auto'`` applies the rule; a list is taken as it is, unknown names raise."""
    if columns == "auto":
        return sorted(r.column_name for r in log1p_columns(stats, **rule).collect())
    known = {r.column_name for r in stats.select("column_name").collect()}
    if unknown := sorted(set(columns) - known):
        raise KeyError(f"log1p columns that the table has not: {unknown}")
    return list(columns)


def apply_log1p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if unknown := sorted(set(columns) - set(df.columns)):
        raise KeyError(f"log1p columns that the table has not: {unknown}")
    return df.withColumns({c: signed_log1p(F.col(c)) for c in columns})


def class_table(df: DataFrame, by: Sequence[str], split_col: str, splits: Sequence[str]) -> DataFrame:
    """Rows per class and split with a total row (null class), by rollup over conditional counts."""
    counts = [F.count_if(F.col(split_col) == s).alias(f"n_{s}") for s in splits]
    return df.rollup(F.struct(*by).alias("_k")).agg(F.count(F.lit(1)).alias("n_rows"), *counts).select(*(F.col(f"_k.{c}").alias(c) for c in by), "n_rows", *(f"n_{s}" for s in splits))

