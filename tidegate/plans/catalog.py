"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.plans import pools, preparation, records, reports, robustness, scores, validation

_MODULES = [records, preparation, validation, scores, pools, robustness, reports]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Scan, label, scale, mine rules on benign training rows, calibrate on validation, judge test rows per group."""
    return QUERIES["validator_by_group"](spark, folder)
