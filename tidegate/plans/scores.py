"""Queries: metrics, operating points, ensembles, weights, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.operators import cascade as C, metrics as M
from tidegate.operators.rules import Validator
from tidegate.plans.base import CHECKED_SQL, FLOWS_SQL, MEMBERS, SCALED_SQL, SCORE_SQL, SCORED_SQL, flows, member, mined, rounded, scaling, scored
from tidegate.sources.tables import read_table

FPR = 0.02


def _long(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, member, p): one row per row and member."""
    return rows.select(*keep, F.inline(F.array(*(F.struct(F.lit(m).alias("member"), F.col(f"p_{m}").alias("p")) for m in MEMBERS))))


def _points(rows: DataFrame) -> dict[str, float]:
    """Per member the validation score that flagged rows must exceed to stay in the budget."""
    benign = _long(rows.where("y = 0 and split_name = 'val'"))
    return {r.member: r.flag_above for r in M.operating_points(benign, "p", FPR, ["member"]).collect()}


def _flags(points: dict[str, float]) -> dict[str, Column]:
    return {m: (F.lit(True) if points.get(m) is None else F.col(f"p_{m}") > points[m]).cast("int") for m in MEMBERS}


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per target of target_scores, rows whose score is a number in [0, 1], at a cut of one half."""
    rows = read_table(spark, d, "target_scores").where("p_attack between 0 and 1 and not isnan(p_attack)")
    return rounded(M.binary_metrics(rows, F.col("y"), (F.col("p_attack") >= 0.5).cast("int"), ["target_name"], F.col("p_attack")))


def member_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(scored(spark, d).where("split_name = 'test'"), "y")
    return rounded(M.binary_metrics(rows, F.col("y"), (F.col("p") >= 0.5).cast("int"), ["member"]))


def per_type_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("split_name = 'test'")
    return rounded(M.recall_by(rows, "class_name", F.col("y") == 0, (F.col("p_mlp") >= 0.5).cast("int")))


def per_category_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("split_name = 'test'")
    return rounded(M.recall_by(rows, "category", F.col("y") == 0, (F.col("p_cnn") >= 0.5).cast("int")))


def group_table(spark: SparkSession, d: str) -> DataFrame:
    """Category x member matrix of the correct rate, from one aggregation."""
    rows = _long(scored(spark, d).where("split_name = 'test'"), "category", "y")
    right = F.when(F.col("y") == 0, F.col("p") < 0.5).otherwise(F.col("p") >= 0.5)
    return rounded(rows.groupBy("category").pivot("member", MEMBERS).agg(F.avg(right.cast("double"))))


def threshold_for_fpr(spark: SparkSession, d: str) -> DataFrame:
    benign = _long(scored(spark, d).where("y = 0 and split_name = 'val'"))
    return rounded(M.operating_points(benign, "p", FPR, ["member"]), 9)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("split_name = 'test' and y = 1")
    return M.bootstrap_ci(rows, F.col("p_mlp") >= 0.5, ["category"])


def or_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """OR of all members at their calibrated points, per split."""
    rows = scored(spark, d)
    flag = M.or_ensemble(list(_flags(_points(rows)).values()))
    return rounded(M.binary_metrics(rows.where("split_name is not null"), F.col("y"), flag, ["split_name"]))


def or_prob(spark: SparkSession, d: str) -> DataFrame:
    both = M.or_ensemble_prob([F.col(f"p_{m}") for m in MEMBERS])
    return rounded(scored(spark, d).groupBy("category").agg(F.avg(both[0]).alias("p_benign"), F.avg(both[1]).alias("p_attack")))


def disagreement(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return rounded(M.disagreement(rows.where("split_name = 'test'"), _flags(_points(rows)), F.col("y")))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.class_weights(flows(spark, d).where("split_name = 'train'"), "y"))


def category_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.category_weights(flows(spark, d).where("split_name = 'train'"), "category", 0.5))


# -- cascade: validator, then one member as discriminator, then the OR of the others --------------------------------

CUTS = {"lstm": 0.6, "mlp": 0.7, "cnn": 0.7}


def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    rows = flows(spark, d)
    rules = mined(rows)
    s = scaling(rows.where("split_name = 'train'"))
    made = Validator(rules).check(rows).select("row_id", "category", "y", "reject", s.vector().alias("x"))
    p = {m: member(m).prob(F.col("x")) for m in MEMBERS}
    stages = {"validator": F.col("reject"), "discriminator": p["lstm"] >= CUTS["lstm"], "ensemble": (p["mlp"] >= CUTS["mlp"]) | (p["cnn"] >= CUTS["cnn"])}
    return made, stages


def cascade_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows, stages = _stages(spark, d)
    return C.Cascade(stages).decide(rows).select("row_id", "stage", "stopped")


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, stages = _stages(spark, d)
    return C.stage_counts(C.Cascade(stages).decide(rows), list(stages))


def stop_rates(spark: SparkSession, d: str) -> DataFrame:
    rows, stages = _stages(spark, d)
    return rounded(C.stop_rate(C.Cascade(stages).decide(rows), "category"))


def ablation_subsets(spark: SparkSession, d: str) -> DataFrame:
    rows, stages = _stages(spark, d)
    return rounded(C.ablate(rows, stages, by=["y"]))


def marginal_contribution(spark: SparkSession, d: str) -> DataFrame:
    rows, stages = _stages(spark, d)
    return C.marginal_contribution(rows, stages, by=["y"])


QUERIES = {f.__name__: f for f in (
    binary_metrics, member_metrics, per_type_recall, per_category_recall, group_table, threshold_for_fpr, bootstrap_ci, or_ensemble, or_prob, disagreement,
    class_weights, category_weights, cascade_verdict, stage_counts, stop_rates, ablation_subsets, marginal_contribution,
)}


def metrics_sql(source: str, by: str, y: str, pred: str, extra: str = "") -> str:
    """The usual rates from confusion counts."""
    z = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
    rec, spec, f1, f0 = z("tp", "tp + fn"), z("tn", "tn + fp"), z("2 * tp", "2 * tp + fp + fn"), z("2 * tn", "2 * tn + fn + fp")
    return f"""counts AS (SELECT {by}, count(*) FILTER (WHERE {y} = 1 AND {pred}) AS tp, count(*) FILTER (WHERE {y} = 0 AND {pred}) AS fp,
          count(*) FILTER (WHERE {y} = 1 AND NOT {pred}) AS fn, count(*) FILTER (WHERE {y} = 0 AND NOT {pred}) AS tn{extra} FROM {source} WHERE {y} IS NOT NULL GROUP BY {by})
        SELECT {by}, tp, fp, fn, tn, tp + fp + fn + tn AS n_rows, round({z('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round(({rec} + {spec}) / 2, 6) AS balanced_accuracy,
          round({z('tp', 'tp + fp')}, 6) AS precision, round({rec}, 6) AS recall, round({f1}, 6) AS f1, round((({f1}) * (tp + fn) + ({f0}) * (tn + fp)) / greatest(tp + fp + fn + tn, 1), 6) AS weighted_f1,
          round({z('fp', 'fp + tn')}, 6) AS fpr, round({z('fn', 'fn + tp')}, 6) AS fnr{', round(log_loss, 6) AS log_loss' if extra else ''} FROM counts"""


_LONG = "long AS (SELECT *, unnest([" + ", ".join(f"{{'member': '{m}', 'p': p_{m}}}" for m in MEMBERS) + "], recursive := true) FROM scored)"
_POINTS = f"""b AS (SELECT member, p, row_number() OVER (PARTITION BY member ORDER BY p DESC) AS rk, count(*) OVER (PARTITION BY member) AS n
    FROM long WHERE y = 0 AND split_name = 'val'), points AS (SELECT member, any_value(n) AS n_benign, max(p) FILTER (WHERE rk = floor(n * {FPR}::DOUBLE) + 1) AS flag_above FROM b GROUP BY member)"""
_FLAG = lambda m: f"(p_{m} > (SELECT coalesce(flag_above, -1) FROM points WHERE member = '{m}'))"
_OR = " OR ".join(_FLAG(m) for m in MEMBERS)
_RIGHT = "CASE WHEN y = 0 THEN {p} < 0.5 ELSE {p} >= 0.5 END"
_VOTES = " + ".join(f"{_FLAG(m)}::INT" for m in MEMBERS)
_CASCADE = f"""{CHECKED_SQL}, {SCALED_SQL}, {SCORED_SQL},
  stages AS (SELECT j.row_id, j.category, j.y, j.reject AS validator, s.p_lstm >= {CUTS['lstm']} AS discriminator, s.p_mlp >= {CUTS['mlp']} OR s.p_cnn >= {CUTS['cnn']} AS ensemble
    FROM judged j JOIN scored s ON j.row_id = s.row_id),
  decided AS (SELECT *, CASE WHEN validator THEN 'validator' WHEN discriminator THEN 'discriminator' WHEN ensemble THEN 'ensemble' ELSE 'allowed' END AS stage FROM stages)"""
_SUBSETS = C.subsets(C.STAGES)

SQL = {
    "binary_metrics": "WITH r AS (SELECT *, p_attack >= 0.5 AS pred FROM target_scores WHERE p_attack BETWEEN 0 AND 1 AND NOT isnan(p_attack)), "
    + metrics_sql("r", "target_name", "y", "pred", ", avg(-CASE WHEN y = 1 THEN ln(least(greatest(p_attack, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p_attack, 1e-15), 1 - 1e-15)) END) AS log_loss"),
    "member_metrics": f"WITH {SCORE_SQL}, {_LONG}, r AS (SELECT *, p >= 0.5 AS pred FROM long WHERE split_name = 'test'), " + metrics_sql("r", "member", "y", "pred"),
    "per_type_recall": f"WITH {SCORE_SQL} SELECT class_name, count(*) AS support, round(avg(({_RIGHT.format(p='p_mlp')})::INT), 6) AS correct_rate FROM scored WHERE split_name = 'test' GROUP BY class_name",
    "per_category_recall": f"WITH {SCORE_SQL} SELECT category, count(*) AS support, round(avg(({_RIGHT.format(p='p_cnn')})::INT), 6) AS correct_rate FROM scored WHERE split_name = 'test' GROUP BY category",
    "group_table": f"WITH {SCORE_SQL} SELECT category, " + ", ".join(f"round(avg(({_RIGHT.format(p='p_' + m)})::INT), 6) AS {m}" for m in MEMBERS) + " FROM scored WHERE split_name = 'test' GROUP BY category",
    "threshold_for_fpr": f"WITH {SCORE_SQL}, {_LONG}, {_POINTS} SELECT member, n_benign, round(flag_above, 9) AS flag_above FROM points",
    "or_ensemble": f"WITH {SCORE_SQL}, {_LONG}, {_POINTS}, r AS (SELECT *, {_OR} AS pred FROM scored WHERE split_name IS NOT NULL), " + metrics_sql("r", "split_name", "y", "pred"),
    "or_prob": f"WITH {SCORE_SQL} SELECT category, round(avg(1 - greatest({', '.join('p_' + m for m in MEMBERS)})), 6) AS p_benign, round(avg(greatest({', '.join('p_' + m for m in MEMBERS)})), 6) AS p_attack FROM scored GROUP BY category",
    "disagreement": f"WITH {SCORE_SQL}, {_LONG}, {_POINTS}, v AS (SELECT y, {_VOTES} AS votes, {', '.join(f'{_FLAG(m)} AS f_{m}' for m in MEMBERS)} FROM scored WHERE split_name = 'test') "
    + " UNION ALL ".join(f"SELECT '{m}' AS member, count(*) FILTER (WHERE votes = 1 AND f_{m}) AS n_alone, count(*) FILTER (WHERE votes = 1 AND f_{m} AND y = 1) AS n_catches, count(*) FILTER (WHERE votes = 1 AND f_{m} AND y = 0) AS n_false_alarms, round(avg((votes IN (0, 3))::INT), 6) AS unanimous_share FROM v" for m in MEMBERS),
    "class_weights": f"WITH {FLOWS_SQL}, c AS (SELECT y, count(*) AS n_rows FROM flows WHERE split_name = 'train' GROUP BY y) SELECT y, n_rows, round(sum(n_rows) OVER () / (2.0 * n_rows), 6) AS weight FROM c",
    "category_weights": f"""WITH {FLOWS_SQL}, c AS (SELECT category, count(*) AS n_rows FROM flows WHERE split_name = 'train' GROUP BY category),
        w AS (SELECT *, pow(sum(n_rows) OVER () / (count(*) OVER () * n_rows)::DOUBLE, 0.5) AS w FROM c)
        SELECT category, n_rows, round(w / (sum(w * n_rows) OVER () / sum(n_rows) OVER ()), 6) AS weight FROM w""",
    "cascade_verdict": f"WITH {_CASCADE} SELECT row_id, stage, stage <> 'allowed' AS stopped FROM decided",
    "stage_counts": f"WITH {_CASCADE} SELECT g.stage, count(d.stage) AS n_rows FROM (SELECT unnest(['validator', 'discriminator', 'ensemble', 'allowed']) AS stage) g LEFT JOIN decided d ON g.stage = d.stage GROUP BY g.stage",
    "stop_rates": f"WITH {_CASCADE} SELECT category, count(*) AS n_rows, round(avg((stage <> 'allowed')::INT), 6) AS stop_rate FROM decided GROUP BY category",
    "ablation_subsets": f"WITH {_CASCADE} " + " UNION ALL ".join(
        f"SELECT y, count(*) AS n_rows, '{'+'.join(c)}' AS stages, {len(c)} AS n_stages, round(avg(({' OR '.join(c)})::INT), 6) AS stop_rate FROM stages GROUP BY y" for c in _SUBSETS
    ),
    "marginal_contribution": f"WITH {_CASCADE} " + " UNION ALL ".join(
        f"SELECT y, '{s}' AS stage, round(avg((validator OR discriminator OR ensemble)::INT) - avg(({' OR '.join(o for o in C.STAGES if o != s)})::INT), 6) AS marginal FROM stages GROUP BY y" for s in C.STAGES
    ),
}

