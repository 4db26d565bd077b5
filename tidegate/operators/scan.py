"""Whole-table profile of a labelled feature table: codes, bad rows, float32 identity, duplicates and conflicts.

Two rows are duplicates if their features are equal at model precision (float32, -0 = 0) and their codes are equal.
Grouping runs on the float columns themselves, so no hash can merge different rows. Counting is pre-aggregated on
the map side; nothing is collected but class-sized summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import INF, any_of
from tidegate.functions.text import slug
from tidegate.sources.tables import bounded

MAX_LABELS = 1_000_000


def check_drop_columns(columns: Sequence[str], drop: Sequence[str]) -> None:
    if unknown := sorted(set(drop) - set(columns)):
        raise ValueError(f"columns to drop that the table has not: {unknown}")


def float32(columns: Sequence[str]) -> list[Column]:
    return [(F.col(c).cast("float") + F.lit(0.0).cast("float")).alias(c) for c in columns]


def row_hash(columns: Sequence[str]) -> Column:
    """Hash at double precision."""
    return F.xxhash64(*(F.col(c) + F.lit(0.0) for c in columns))


def row_hash32(columns: Sequence[str]) -> Column:
    """Hash at model precision."""
    return F.xxhash64(*float32(columns))


def is_bad(columns: Sequence[str]) -> Column:
    """Any feature null, NaN or infinite."""
    return any_of([F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(INF)) for c in columns])


def with_codes(df: DataFrame, label_col: str, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Join name, code, binary view and category of each label by its slug; ``strict`` raises on an unknown one."""
    known = labels.select("slug", "class_name", "code", "is_attack", "category")
    joined = df.withColumn("_slug", slug(F.col(label_col))).join(bounded(known, MAX_LABELS), F.col("_slug") == F.col("slug"), "left")
    if strict:
        unknown = joined.where("slug is null").select(label_col).distinct().limit(10).collect()
        if unknown:
            raise ValueError(f"labels that the label map does not know: {sorted(str(r[0]) for r in unknown)}")
    return joined.drop("slug", "_slug")


def annotate(df: DataFrame, features: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Add ``feat_hash32``, ``feat_hash64`` and ``is_bad``; dropped columns go first, so they decide nothing."""
    check_drop_columns(df.columns, drop)
    kept = [c for c in features if c not in drop]
    return df.drop(*drop).withColumns({"feat_hash32": row_hash32(kept), "feat_hash64": row_hash(kept), "is_bad": is_bad(kept)})


def column_faults(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(column_name, n_nan, n_inf): one pass, one row back per column. A null counts as NaN."""
    counts = []
    for c in features:
        counts.append(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"nan_{c}"))
        counts.append(F.count_if(F.abs(F.col(c)) == F.lit(INF)).alias(f"inf_{c}"))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"nan_{c}").alias("n_nan"), F.col(f"inf_{c}").alias("n_inf")) for c in features))
    return df.agg(*counts).select(F.inline(rows))


def first_deliveries(df: DataFrame, identity: Sequence[str], id_col: str) -> DataFrame:
    """(identity, first id): each window once, by the smallest id."""
    return df.groupBy(*identity).agg(F.min(id_col).alias(id_col))


def vectors(df: DataFrame, features: Sequence[str], code_col: str, id_col: str) -> DataFrame:
    """Distinct (float32 features, code) with ``first_id``, ``n_rows`` and ``n_bad``."""
    bad = is_bad(features)
    keyed = df.select(*float32(features), F.col(code_col).alias("code"), F.col(id_col).alias("id"), bad.cast("long").alias("bad"))
    return keyed.groupBy(*features, "code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.sum("bad").alias("n_bad"))


def duplicate_report(df: DataFrame, features: Sequence[str], code_col: str, id_col: str) -> DataFrame:
    """Per code: rows, duplicates, bad rows, and distinct vectors that also stand under another code."""
    distinct = vectors(df, features, code_col, id_col)
    codes = distinct.groupBy(*features).agg(F.count(F.lit(1)).alias("n_codes"), F.collect_list(F.struct("code", "n_rows", "n_bad")).alias("own"))
    # A vector has at most one entry per code, so the list is as short as the label map.
    rows = codes.select("n_codes", F.inline("own"))
    return rows.groupBy("code").agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_rows") - F.count(F.lit(1))).alias("n_duplicates"),
        F.count_if(F.col("n_codes") > 1).alias("n_conflicting"), F.sum("n_bad").alias("n_bad"),
    )


def conflicts(df: DataFrame, features: Sequence[str], code_col: str, id_col: str) -> DataFrame:
    """Distinct vectors with more than one code: the smallest id and the number of codes."""
    by = vectors(df, features, code_col, id_col).groupBy(*features)
    return by.agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n_codes")).where("n_codes > 1").select("first_id", "n_codes")
