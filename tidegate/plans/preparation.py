"""Queries: labels, scan profile, duplicates, samples, splits, column decisions, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.functions.numeric import inverse_signed_log1p, signed_log1p
from tidegate.operators import prepare, sample, scan
from tidegate.plans.base import FINITE_SQL, FLOWS_SQL, LOG1P, PARAMS_SQL, flows, log_sql, rounded, scaling, unpivot_sql
from tidegate.schema import FEATURES
from tidegate.sources.tables import bounded, read_table

SEED = 42
SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}
SPLITS = list(SHARES)


def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Rows per class by the label's slug; labels that the map does not know under null."""
    labels = read_table(spark, d, "label_map")
    rows = scan.with_codes(read_table(spark, d, "flow_scan").select("label"), "label", labels, strict=False)
    return rows.groupBy("class_name", "category", "is_attack").agg(F.count(F.lit(1)).alias("n_rows"))


def scan_profile(spark: SparkSession, d: str) -> DataFrame:
    return scan.column_faults(read_table(spark, d, "flow_scan").select(*FEATURES), FEATURES)


def scan_files_check(spark: SparkSession, d: str) -> DataFrame:
    """Windows per file, each delivery once, beside what the scan listed."""
    first = scan.first_deliveries(read_table(spark, d, "flow_scan"), ["file_path", "row_no"], "row_id")
    own = first.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_windows"))
    listed = bounded(read_table(spark, d, "scan_files").select("file_path", F.col("n_rows").alias("n_listed")), 1_000_000)
    return own.join(listed, "file_path", "left")


def dedup_float32(spark: SparkSession, d: str) -> DataFrame:
    v = scan.vectors(flows(spark, d), FEATURES, "code", "row_id")
    return v.agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("n_rows") - F.count(F.lit(1))).alias("n_duplicates"))


def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    return scan.duplicate_report(flows(spark, d), FEATURES, "code", "row_id").drop("n_bad")


def conflict_vectors(spark: SparkSession, d: str) -> DataFrame:
    return scan.conflicts(flows(spark, d), FEATURES, "code", "row_id")


def clean_ledger(spark: SparkSession, d: str) -> DataFrame:
    return prepare.clean_ledger(read_table(spark, d, "flow_scan"), FEATURES, "codes")


def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    """First occurrences, at most 100 a class, the two smallest classes whole."""
    v = scan.vectors(flows(spark, d), FEATURES, "code", "row_id").select("code", F.col("first_id").alias("row_id"))
    return sample.capped(v, "code", "row_id", 100, [22, 23], SEED)


def smoke_subsample(spark: SparkSession, d: str) -> DataFrame:
    return sample.smoke(flows(spark, d).select("row_id", "code"), "code", "row_id", 0.05, 20, SEED)


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified(flows(spark, d).select("row_id", "code"), "code", "row_id", 700, SEED)


def rows_per_category(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select("row_id", "category", "split_name")
    return sample.per_category(rows, "category", "row_id", 40, F.col("split_name") == "test", "Benign", SEED).select("row_id", "category")


def attack_rows(spark: SparkSession, d: str) -> DataFrame:
    return sample.exactly(flows(spark, d).where("y = 1").select("row_id"), "row_id", 200, SEED)


def train_fraction(spark: SparkSession, d: str) -> DataFrame:
    return sample.fraction(flows(spark, d).where("split_name = 'train'").select("row_id"), "row_id", 0.5, SEED)


def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_split(flows(spark, d).select("row_id", "code"), "code", "row_id", SHARES, SEED)


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split_assign(spark, d).groupBy("code", "split_name").agg(F.count(F.lit(1)).alias("n_rows"))


def near_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    train = flows(spark, d).where("split_name = 'train'")
    return rounded(prepare.constancy(train, FEATURES, 0.0, 700), 4)


def feature_tail_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepare.tail_stats(flows(spark, d).where("split_name = 'train'"), FEATURES))


def auto_log1p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prepare.log1p_columns(prepare.tail_stats(flows(spark, d).where("split_name = 'train'"), FEATURES)))


def signed_log1p_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per column the range after signed log1p and the greatest relative error of the way back."""
    rows = prepare.long_form(flows(spark, d), LOG1P).withColumn("x", F.col("x") - 100.0).withColumn("v", signed_log1p(F.col("x")))
    error = F.abs(inverse_signed_log1p(F.col("v")) - F.col("x")) / (F.abs("x") + 1.0)
    return rounded(rows.groupBy("column_name").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), (F.max(error) < 1e-9).alias("exact")))


def minmax_scale_clip(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on train, applied to test: mean scaled value and cells outside [0, 1] per column."""
    rows = flows(spark, d)
    s, test = scaling(rows.where("split_name = 'train'")), rows.where("split_name = 'test'")
    means = s.transform(test, as_float=False).agg(*(F.avg(c).alias(c) for c in FEATURES))
    long = means.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean_scaled")) for c in FEATURES))))
    return rounded(long.join(s.out_of_range(test), "column_name"))


def class_table_rollup(spark: SparkSession, d: str) -> DataFrame:
    return prepare.class_table(flows(spark, d), ["code", "class_name", "category"], "split_name", SPLITS)


QUERIES = {f.__name__: f for f in (
    label_normalise, scan_profile, scan_files_check, dedup_float32, duplicate_report, conflict_vectors, clean_ledger, capped_sample, smoke_subsample,
    quota_sample, rows_per_category, attack_rows, train_fraction, split_assign, split_sizes, near_constant_columns, feature_tail_stats, auto_log1p,
    signed_log1p_roundtrip, minmax_scale_clip, class_table_rollup,
)}

_F32 = ", ".join(f"{c}::FLOAT AS f{i}" for i, c in enumerate(FEATURES))
_KEYS = ", ".join(f"f{i}" for i in range(len(FEATURES)))
_VECTORS = f"v AS (SELECT {_KEYS}, code, min(row_id) AS first_id, count(*) AS n FROM (SELECT row_id, code, {_F32} FROM flows) GROUP BY {_KEYS}, code)"
_MD5 = "md5('42:' || row_id)"


def _rank(source: str, by: str = "") -> str:
    over = f"PARTITION BY {by} " if by else ""
    n = f"count(*) OVER ({'PARTITION BY ' + by if by else ''})"
    return f"(SELECT *, row_number() OVER ({over}ORDER BY {_MD5}) AS rk, {n} AS n_all FROM {source})"


_TAIL = f"""tail AS (SELECT column_name, min(x) AS min, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, max(x) AS max,
    max(x) - min(x) AS span, avg((x = 0)::INT) AS frac_zero, avg((x = round_even(x, 0))::INT) AS frac_integer, count(*) FILTER (WHERE x < 0) AS n_negative
  FROM ({unpivot_sql('flows', '', "split_name = 'train'")}) GROUP BY column_name)"""
_POS = "CASE WHEN span = 0 THEN 0 ELSE (p50 - min) / span END"
_SPLIT = f"""assigned AS (SELECT row_id, code, CASE WHEN rk <= round_even(n_all * 0.7::DOUBLE, 0) THEN 'train'
    WHEN rk <= round_even(n_all * (0.7::DOUBLE + 0.15::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split_name FROM {_rank('flows', 'code')})"""

SQL = {
    "label_normalise": """SELECT m.class_name, m.category, m.is_attack, count(*) AS n_rows FROM flow_scan f
        LEFT JOIN label_map m ON m.slug = regexp_replace(lower(f.label), '[^a-z0-9]', '', 'g') GROUP BY ALL""",
    "scan_profile": f"""SELECT column_name, count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf
        FROM ({unpivot_sql('flow_scan', '')}) GROUP BY column_name""",
    "scan_files_check": """SELECT f.file_path, count(DISTINCT coalesce(row_no, -1)) AS n_windows, any_value(s.n_rows) AS n_listed
        FROM flow_scan f LEFT JOIN scan_files s ON f.file_path = s.file_path GROUP BY f.file_path""",
    "dedup_float32": f"WITH {FLOWS_SQL}, {_VECTORS} SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM v",
    "duplicate_report": f"""WITH {FLOWS_SQL}, {_VECTORS}, w AS (SELECT *, count(*) OVER (PARTITION BY {_KEYS}) AS k FROM v)
        SELECT code, sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS n_duplicates, count(*) FILTER (WHERE k > 1) AS n_conflicting FROM w GROUP BY code""",
    "conflict_vectors": f"WITH {FLOWS_SQL}, {_VECTORS} SELECT min(first_id) AS first_id, count(*) AS n_codes FROM v GROUP BY {_KEYS} HAVING count(*) > 1",
    "clean_ledger": f"""WITH a AS (SELECT codes AS code, count(*) AS n_rows, count(*) FILTER (WHERE NOT ({FINITE_SQL})) AS n_bad FROM flow_scan GROUP BY codes),
        k AS (SELECT codes, count(*) AS n_kept FROM (SELECT DISTINCT codes, {_F32} FROM flow_scan WHERE {FINITE_SQL}) GROUP BY codes)
        SELECT code, n_rows, n_bad, n_rows - n_bad - coalesce(n_kept, 0) AS n_duplicates, coalesce(n_kept, 0) AS n_kept FROM a LEFT JOIN k ON code IS NOT DISTINCT FROM codes""",
    "capped_sample": f"""WITH {FLOWS_SQL}, {_VECTORS}, u AS (SELECT code, first_id AS row_id FROM v)
        SELECT code, row_id FROM {_rank('u', 'code')} WHERE rk <= 100 OR code IN (22, 23)""",
    "smoke_subsample": f"WITH {FLOWS_SQL} SELECT row_id, code FROM {_rank('flows', 'code')} WHERE rk <= greatest(20, floor(n_all * 0.05::DOUBLE))",
    "quota_sample": f"""WITH {FLOWS_SQL} SELECT row_id, code FROM {_rank('flows', 'code')}, (SELECT count(*) AS total FROM flows)
        WHERE total <= 700 OR rk <= greatest(1, round_even(n_all * 700::DOUBLE / total, 0))""",
    "rows_per_category": f"""WITH {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE split_name = 'test' AND category <> 'Benign')
        SELECT row_id, category FROM {_rank('t', 'category')} WHERE rk <= 40""",
    "attack_rows": f"WITH {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE y = 1) SELECT row_id FROM {_rank('t')} WHERE rk <= 200",
    "train_fraction": f"WITH {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE split_name = 'train') SELECT row_id FROM {_rank('t')} WHERE rk <= floor(n_all * 0.5::DOUBLE)",
    "split_assign": f"WITH {FLOWS_SQL}, {_SPLIT} SELECT * FROM assigned",
    "split_sizes": f"WITH {FLOWS_SQL}, {_SPLIT} SELECT code, split_name, count(*) AS n_rows FROM assigned GROUP BY ALL",
    "near_constant_columns": f"""WITH {FLOWS_SQL}, c AS (SELECT column_name, x, count(*) AS n FROM ({unpivot_sql('flows', '', "split_name = 'train'")}) GROUP BY ALL)
        SELECT column_name, round(max(x) - min(x), 4) AS spread, (sum(n) - max(n))::BIGINT AS n_non_mode, max(x) - min(x) <= 0 OR sum(n) - max(n) < 700 AS near_constant
        FROM c GROUP BY column_name""",
    "feature_tail_stats": f"""WITH {FLOWS_SQL}, {_TAIL} SELECT column_name, round(min, 6) AS min, round(p50, 6) AS p50, round(p99, 6) AS p99, round(max, 6) AS max, round(span, 6) AS span,
        round({_POS}, 6) AS p50_position, round({_POS.replace('p50', 'p99')}, 6) AS p99_position, round(frac_zero, 6) AS frac_zero, round(frac_integer, 6) AS frac_integer, n_negative FROM tail""",
    "auto_log1p": f"WITH {FLOWS_SQL}, {_TAIL} SELECT column_name, round({_POS}, 6) AS p50_position, round(span, 6) AS span FROM tail WHERE {_POS} < 0.02 AND span > 10",
    "signed_log1p_roundtrip": f"""WITH {FLOWS_SQL}, r AS (SELECT column_name, x - 100 AS x, sign(x - 100) * ln(1 + abs(x - 100)) AS v
          FROM ({unpivot_sql('flows', '')}) WHERE column_name IN ({', '.join(repr(c) for c in LOG1P)}))
        SELECT column_name, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, max(abs(sign(v) * (exp(abs(v)) - 1) - x) / (abs(x) + 1)) < 1e-9 AS exact FROM r GROUP BY column_name""",
    "minmax_scale_clip": f"WITH {FLOWS_SQL}, {PARAMS_SQL}, " + "cells AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, ({log_sql(c)} - lo_{c}) / span_{c} AS s FROM flows, params WHERE split_name = 'test'" for c in FEATURES
    ) + ") SELECT column_name, round(avg(least(greatest(s, 0.0), 1.0)), 6) AS mean_scaled, count(*) FILTER (WHERE s < 0 OR s > 1) AS n_outside FROM cells GROUP BY column_name",
    "class_table_rollup": f"""WITH {FLOWS_SQL} SELECT code, class_name, category, count(*) AS n_rows, {', '.join(f"count(*) FILTER (WHERE split_name = '{s}') AS n_{s}" for s in SPLITS)}
        FROM flows GROUP BY GROUPING SETS ((code, class_name, category), ())""",
}

