"""Queries: rule mining, calibration, the validator's four families, soft penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators import rules as R
from tidegate.plans.base import (
    CANDIDATES, CHECKED_SQL, FLOWS_SQL, GROUP_SQL, INDICATORS, PARAMS_SQL, PROFILE_SQL, TOL_SQL, _LINEAR, flows, mined, residual_sql, rounded, scaling, trusted,
)
from tidegate.schema import FEATURES


def _checked(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return R.Validator(mined(rows)).check(rows)


def group_assign(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).groupBy(R.protocol_group(INDICATORS).alias("grp"), "category").agg(F.count(F.lit(1)).alias("n_rows"))


def group_median_mad(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every group and column as the rules hold it: own where the group has 100 rows, else the global one."""
    rules = R.mine(trusted(flows(spark, d), "train"), scaling(flows(spark, d).where("split_name = 'train'")), CANDIDATES, INDICATORS)
    rows = [(g, c, p["n_rows"], p["own"], p["median"][c], p["mad"][c]) for g, p in rules.groups.items() for c in FEATURES]
    return rounded(spark.createDataFrame(rows, "grp string, column_name string, n_rows long, own boolean, med double, mad double"))


def dependency_calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.dependency_calibration(trusted(flows(spark, d), "train"), CANDIDATES))


def pruned_rules(spark: SparkSession, d: str) -> DataFrame:
    return R.dependency_calibration(trusted(flows(spark, d), "train"), CANDIDATES).where("pruned").select("rule")


def integer_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    s = scaling(rows.where("split_name = 'train'"))
    linear = [c for c in FEATURES if c in _LINEAR]
    return R.integer_columns(trusted(rows, "train"), linear, s).select("column_name", "integral", "checkable")


def distribution_threshold(spark: SparkSession, d: str) -> DataFrame:
    rules = mined(flows(spark, d))
    rows = [(g, rules.threshold_source[g], float(t)) for g, t in rules.thresholds.items()]
    return rounded(spark.createDataFrame(rows, "grp string, source string, threshold double"))


def validator_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("row_id", "grp", *(f"rej_{f}" for f in R.FAMILIES), "reject")


def validator_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.family_rates(_checked(spark, d).where("split_name = 'test'"), "category"))


def validator_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.family_rates(_checked(spark, d).where("split_name = 'test' and y = 0"), "grp"))


def sole_family(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.sole_family_rates(_checked(spark, d), "category"))


def dominant_family(spark: SparkSession, d: str) -> DataFrame:
    """Per category the family that most often rejects alone; ties go to the first in alphabetical order."""
    rates = R.sole_family_rates(_checked(spark, d), "category")
    ranked = F.array(*(F.struct(F.round(f"sole_{f}_pct", 6).alias("pct"), F.lit(-i).alias("at"), F.lit(f).alias("family")) for i, f in enumerate(sorted(R.FAMILIES))))
    top = F.array_max(ranked)
    return rates.select("category", top["family"].alias("family"), top["pct"].alias("pct"))


def soft_penalties(spark: SparkSession, d: str) -> DataFrame:
    """Mean penalty per family and category, and the share of rows with none."""
    rows = flows(spark, d)
    soft = R.SoftValidator(mined(rows))
    made = rows.withColumn("grp", soft.group())
    p = soft.penalties(F.col("grp"))
    judged = made.select("category", *(v.alias(k) for k, v in p.items()))
    return rounded(judged.groupBy("category").agg(*(F.avg(f).alias(f) for f in p), F.avg((F.col("range") + F.col("dependency") + F.col("distribution") == 0).cast("double")).alias("free")))


QUERIES = {f.__name__: f for f in (
    group_assign, group_median_mad, dependency_calibration, pruned_rules, integer_columns, distribution_threshold, validator_verdict, validator_by_category,
    validator_by_group, sole_family, dominant_family, soft_penalties,
)}

_RATES = "count(*) AS n_rows, round(100 * avg(reject::INT), 6) AS reject_pct, " + ", ".join(f"round(100 * avg(rej_{f}::INT), 6) AS {f}_pct" for f in R.FAMILIES)
_SOLE = ", ".join(f"round(100 * avg((rej_{f} AND fired = 1)::INT), 6) AS sole_{f}_pct" for f in R.FAMILIES)
_SOFT_RANGE = " + ".join(
    f"(greatest(lo_{c} - 0.01 * greatest(hi_{c} - lo_{c}, 1e-9) - {c}, 0) + greatest({c} - hi_{c} - 0.01 * greatest(hi_{c} - lo_{c}, 1e-9), 0))"
    f" / greatest(hi_{c} - lo_{c} + 0.02 * greatest(hi_{c} - lo_{c}, 1e-9), 1e-9)" for c in FEATURES
)
_SOFT_WHOLE = " + ".join(f"CASE WHEN off_{c} <= tol_{c} AND tol_{c} < 0.25 THEN pow(sin(pi() * {c}), 2) ELSE 0 END" for c in _LINEAR)
_SOFT_DEP = " + ".join(
    f"(SELECT CASE WHEN tolerance <= 0.05 THEN greatest(f.res - tolerance, 0) ELSE 0 END FROM tolerances WHERE rule = '{r.name}')".replace("f.res", residual_sql(r)) for r in CANDIDATES
)

SQL = {
    "group_assign": f"WITH {FLOWS_SQL} SELECT {GROUP_SQL} AS grp, category, count(*) AS n_rows FROM flows GROUP BY ALL",
    "group_median_mad": f"WITH {FLOWS_SQL}, {PROFILE_SQL} SELECT grp, column_name, n_rows, own, round(med, 6) AS med, round(mad, 6) AS mad FROM profiles",
    "dependency_calibration": f"""WITH {FLOWS_SQL}, {TOL_SQL} SELECT rule, round(p50, 6) AS p50, round(p99, 6) AS p99, round(p999, 6) AS p999, round(max, 6) AS max,
        round(share_positive, 6) AS share_positive, round(tolerance, 6) AS tolerance, tolerance > 0.05 AS pruned FROM tolerances""",
    "pruned_rules": f"WITH {FLOWS_SQL}, {TOL_SQL} SELECT rule FROM tolerances WHERE tolerance > 0.05",
    "integer_columns": f"WITH {FLOWS_SQL}, {PARAMS_SQL}, t AS (SELECT * FROM flows WHERE y = 0 AND split_name = 'train') " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, max(abs({c} - round_even({c}, 0)) / greatest(1e-6, 1e-6 * span_{c})) <= 1 AS integral, any_value(greatest(1e-6, 1e-6 * span_{c}) < 0.25) AS checkable FROM t, params" for c in _LINEAR
    ),
    "distribution_threshold": f"WITH {FLOWS_SQL}, {PROFILE_SQL} SELECT grp, source, round(threshold, 6) AS threshold FROM thresholds",
    "validator_verdict": f"WITH {CHECKED_SQL} SELECT row_id, grp, rej_range, rej_integrality, rej_dependency, rej_distribution, reject FROM judged",
    "validator_by_category": f"WITH {CHECKED_SQL} SELECT category, {_RATES} FROM judged WHERE split_name = 'test' GROUP BY category",
    "validator_by_group": f"WITH {CHECKED_SQL} SELECT grp, {_RATES} FROM judged WHERE split_name = 'test' AND y = 0 GROUP BY grp",
    "sole_family": f"WITH {CHECKED_SQL} SELECT category, {_SOLE} FROM judged GROUP BY category",
    "soft_penalties": f"""WITH {CHECKED_SQL}, soft AS (SELECT f.category, {_SOFT_RANGE} AS range, {_SOFT_WHOLE} AS integrality, {_SOFT_DEP} AS dependency,
          greatest(s.score - t.threshold, 0) AS distribution FROM flows f JOIN scores s ON f.row_id = s.row_id JOIN thresholds t ON s.grp = t.grp, edge, whole)
        SELECT category, round(avg(range), 6) AS range, round(avg(integrality), 6) AS integrality, round(avg(dependency), 6) AS dependency, round(avg(distribution), 6) AS distribution,
          round(avg((range + dependency + distribution = 0)::INT), 6) AS free FROM soft GROUP BY category""",
    "dominant_family": f"""WITH {CHECKED_SQL}, sole AS (SELECT category, {_SOLE} FROM judged GROUP BY category),
        long AS (SELECT category, unnest([{', '.join(f"{{'family': '{f}', 'pct': sole_{f}_pct}}" for f in R.FAMILIES)}], recursive := true) FROM sole)
        SELECT category, family, pct FROM long QUALIFY row_number() OVER (PARTITION BY category ORDER BY pct DESC, family) = 1""",
}
