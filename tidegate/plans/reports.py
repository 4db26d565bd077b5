"""Queries: report tables, models, the streaming gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.functions.numeric import norms, relative_error
from tidegate.operators import metrics as M, networks as N, perturb as P, report as R, scorers as S
from tidegate.operators.relate import best_stumps
from tidegate.operators.rules import Validator
from tidegate.operators.sample import ranked
from tidegate.plans.base import CHECKED_SQL, FLOWS_SQL, PARAMS_SQL, SCALED_SQL, SCORE_SQL, flows, logit_sql, member, mined, prob_sql, SAMPLE, rounded, scaling, scored, vectors
from tidegate.plans.pools import STUMP_SQL
from tidegate.schema import FEATURES
from tidegate.sources.tables import bounded, read_table
from tidegate.streaming.gate import run_gate

GROUPS = ["all", "ddos", "dos", "mirai", "recon", "spoofing", "web", "bruteforce", "pop10pkt", "pop100pkt"]


def cell_summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """One perturbation cell (FGSM on a declared scorer): ALL, populations and categories from one aggregation."""
    rows = flows(spark, d)
    s, m = scaling(rows.where("split_name = 'train'")), member("mlp")
    test = rows.where("split_name = 'test' and y = 1").select("category", "y", s.vector().alias("x"))
    moved = test.withColumn("adv", P.fgsm(F.col("x"), F.col("y"), m, 0.1)).withColumn("population", R.population(F.col("category")))
    n = norms(F.col("x"), F.col("adv"))
    return rounded(R.cell_summary(moved, m.logit(F.col("adv")) < 0, m.logit(F.col("x")) >= -1.0, n["l2"]))


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.group_pivot(R.report_lines(read_table(spark, d, "realizable_report")), "pass_and_evade_pct", GROUPS))


def tier_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.tier_table(R.report_lines(read_table(spark, d, "realizable_report")), "pass_and_evade_pct"))


def evasion_rates(spark: SparkSession, d: str) -> DataFrame:
    """Formatted mean evasion with its bounds, per spec and attack, over the ALL lines."""
    lines = R.report_lines(read_table(spark, d, "realizable_report")).where("grp = 'all'")
    means = lines.groupBy("spec", "attack").agg(*(F.avg(c).alias(c) for c in ("evasion_pct", "evasion_lo", "evasion_hi")), F.median("med_features_changed").alias("med_changed"))
    return rounded(means.select("spec", "attack", R.format_rate(F.round("evasion_pct", 6), F.round("evasion_lo", 6), F.round("evasion_hi", 6)).alias("evasion"), "med_changed"))


def catch_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Benign and attack test rows as they are and with every packet size raised by 30: what the validator rejects, and
    how much of that the change brought about."""
    rows = flows(spark, d)
    v = Validator(mined(rows))
    test = rows.where("split_name = 'test'")
    wider = test.withColumns({c: F.col(c) + 30.0 for c in ("pkt_min", "pkt_avg", "pkt_max", "tot_size")})
    before = v.check(test).select("row_id", "category", F.col("reject").alias("clean"))
    after = v.check(wider).select("row_id", F.col("reject").alias("adv"))
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    both = before.join(after, "row_id")
    return rounded(both.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), pct(F.col("adv")).alias("catch_pct"), pct(F.col("clean")).alias("clean_pct"), pct(F.col("adv") & ~F.col("clean")).alias("attributable_pct")))


def realism_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the realism classes assume, measured on test rows: benign, attack and all, from one aggregation."""
    rows = flows(spark, d).where("split_name = 'test'")
    rel = relative_error(F.col("srate"), F.col("rate"))
    share = lambda c: F.avg(c.cast("double"))
    kind = F.when(F.grouping("y") == 1, "all").when(F.col("y") == 1, "attack").otherwise("benign")
    out = R.with_totals(rows, [["y"], []], [
        kind.alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.max(rel).alias("max_rel_rate"), share(F.col("duration").between(1.0, 255.0)).alias("ttl_inside"),
        share((F.col("pkt_min") <= F.col("pkt_avg")) & (F.col("pkt_avg") <= F.col("pkt_max"))).alias("ordered"), share(F.col("rst_count") == 0).alias("no_reset"), share(F.col("pkt_max") <= 1514.0).alias("under_cap"),
    ])
    return rounded(out.drop("y"))


def eligible_rows(spark: SparkSession, d: str) -> DataFrame:
    """Attack rows of test that all members detect, per category."""
    found = [F.col(f"p_{m}") >= 0.5 for m in ("mlp", "cnn", "lstm")]
    rows = scored(spark, d).where((F.col("y") == 1) & (F.col("split_name") == "test") & found[0] & found[1] & found[2])
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"))


def cell_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Deployed verdicts of one cell (FGSM against the first member): per category who still detects it."""
    rows = scored(spark, d).where("split_name = 'test' and y = 1").withColumn("adv", P.fgsm(F.col("x"), F.col("y"), member("mlp"), 0.1))
    detects = {m: (F.col(f"p_{m}") >= 0.5, member(m).prob(F.col("adv")) >= 0.5) for m in ("mlp", "cnn", "lstm")}
    no = F.lit(False)
    made = R.evaluate_cell(rows, detects, (no, no), "mlp", (F.col("x"), F.col("adv")))
    return rounded(made.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("detected_mlp_clean").alias("n_clean"), F.count_if("evades_target").alias("n_evades_target"), F.count_if("evades_ensemble").alias("n_evades_ensemble"), F.avg("l2").alias("mean_l2")))


def integrality_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of the best single-column rules' strength sits in integer columns."""
    rows = flows(spark, d).where("split_name = 'train'")
    strength = best_stumps(rows, FEATURES, F.col("y")).select("column_name", F.round(F.col("balanced_accuracy") - 0.5, 9).alias("importance"))
    whole = ["syn_flag_number", "ack_flag_number", "http", "tcp", "udp", "icmp", "protocol_type"]
    return rounded(R.integrality_overlap(strength, whole, 8))


# -- models -----------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return flows(spark, d).select("row_id", "split_name", F.col("y").cast("double").alias("y"), "category", *FEATURES), FEATURES


def forest_fit_score(spark: SparkSession, d: str) -> DataFrame:
    """A forest fitted on a bounded sample of labelled training rows (``SAMPLE``), scored on all test rows."""
    rows, columns = _labelled(spark, d)
    train = ranked(rows.where("split_name = 'train'"), [], "row_id", F.least("n_stratum", F.lit(SAMPLE)), 42)
    model = S.fit_forest(train, columns, "y")
    return rounded(M.binary_metrics(model.transform(rows.where("split_name = 'test'")), F.col("y"), F.col("prediction")))


def topk_importance(spark: SparkSession, d: str) -> DataFrame:
    """The ten features a forest leans on most."""
    rows, columns = _labelled(spark, d)
    train = ranked(rows.where("split_name = 'train'"), [], "row_id", F.least("n_stratum", F.lit(SAMPLE)), 42)
    return spark.createDataFrame(S.top_importances(S.fit_forest(train, columns, "y"), columns, 10), "column_name string, importance double")


def tree_probe(spark: SparkSession, d: str) -> DataFrame:
    """Balanced depth-3 tree on the packet-size columns alone."""
    rows, _ = _labelled(spark, d)
    columns = ["pkt_min", "pkt_avg", "pkt_max", "pkt_std"]
    train = ranked(rows.where("split_name = 'train'"), [], "row_id", F.least("n_stratum", F.lit(SAMPLE)), 42)
    return rounded(M.binary_metrics(S.fit_tree(train, columns, "y").transform(rows.where("split_name = 'test'")), F.col("y"), F.col("prediction")))


def _trained(spark: SparkSession, d: str, kind: str) -> DataFrame:
    train, test = vectors(spark, d)
    network = N.fitted(kind, train, "row_id", "x", "y", max_rows=SAMPLE)
    return rounded(M.binary_metrics(N.scored(test, "x", network), F.col("y"), (F.col("prob") >= 0.5).cast("int"), prob=F.col("prob")))


def mlp_train_score(spark: SparkSession, d: str) -> DataFrame:
    """Dense network fitted on at most ``SAMPLE`` training rows, scored on all test rows."""
    return _trained(spark, d, "mlp")


def cnn_train_score(spark: SparkSession, d: str) -> DataFrame:
    """The same with the convolutional network."""
    return _trained(spark, d, "cnn")


def lstm_train_score(spark: SparkSession, d: str) -> DataFrame:
    """The same with the recurrent network."""
    return _trained(spark, d, "lstm")


# -- streaming --------------------------------------------------------------------------------------------------


def stream_gate(spark: SparkSession, d: str) -> DataFrame:
    """The validator as a stream over the flow files, written by a file sink, counted per category."""
    rows = flows(spark, d)
    v = Validator(mined(rows))
    labels = read_table(spark, d, "label_map").select("code", "category", F.col("is_attack").cast("int").alias("y"))

    def gate(stream: DataFrame) -> DataFrame:
        from tidegate.functions.numeric import all_finite

        known = stream.where(all_finite(FEATURES)).join(bounded(labels, 1_000_000), stream["codes"].cast("int") == labels["code"])
        return v.check(known).select("row_id", "category", "reject")

    judged = run_gate(spark, f"{d}/flow_scan.parquet", gate)
    return judged.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("reject").alias("n_rejected"))


QUERIES = {f.__name__: f for f in (
    cell_summary_grouping_sets, category_pivot, tier_table, evasion_rates, catch_attribution, realism_audit, eligible_rows, cell_verdicts, integrality_overlap, forest_fit_score, topk_importance, tree_probe, mlp_train_score,
    cnn_train_score, lstm_train_score, stream_gate,
)}

_LINES = """lines AS (SELECT run_id, spec, attack, model, regexp_replace(lower(grp), '[^a-z0-9]', '', 'g') AS grp, max(pass_and_evade_pct) FILTER (WHERE NOT isnan(pass_and_evade_pct)) AS pass_and_evade_pct,
    max(evasion_pct) FILTER (WHERE NOT isnan(evasion_pct)) AS evasion_pct, max(evasion_lo) FILTER (WHERE NOT isnan(evasion_lo)) AS evasion_lo, max(evasion_hi) FILTER (WHERE NOT isnan(evasion_hi)) AS evasion_hi,
    max(med_features_changed) FILTER (WHERE NOT isnan(med_features_changed)) AS med_features_changed FROM realizable_report WHERE grp IS NOT NULL GROUP BY ALL)"""
_ADV = "list_transform(range(1, 21), lambda i: least(greatest(x[i] - sign(w[i]) * 0.1, 0.0), 1.0))"
_TIER = "CASE " + " ".join(f"WHEN attack = '{a}' THEN '{t}'" for a, t in R.TIERS.items()) + " ELSE 'other' END"
_W = "[" + ", ".join(f"({w})::DOUBLE" for w in member("mlp").weights) + "]"

# The widened test rows join the table under negative ids and a split of their own, which no fit reads.
_BOTH = CHECKED_SQL.replace(FLOWS_SQL, FLOWS_SQL.replace("flows AS (", "flows0 AS (", 1) + """, flows AS (SELECT * FROM flows0 UNION ALL
  SELECT * REPLACE (-row_id AS row_id, 'wide' AS split_name, """ + ", ".join(f"{c} + 30 AS {c}" for c in ("pkt_min", "pkt_avg", "pkt_max", "tot_size")) + ") FROM flows0 WHERE split_name = 'test')")

SQL = {
    "catch_attribution": f"""WITH {_BOTH} SELECT c.category, count(*) AS n_rows, round(100 * avg(a.reject::INT), 6) AS catch_pct, round(100 * avg(c.reject::INT), 6) AS clean_pct,
        round(100 * avg((a.reject AND NOT c.reject)::INT), 6) AS attributable_pct FROM judged c JOIN judged a ON a.row_id = -c.row_id WHERE c.split_name = 'test' GROUP BY c.category""",
    "cell_summary_grouping_sets": f"""WITH {FLOWS_SQL}, {PARAMS_SQL}, {SCALED_SQL}, w AS (SELECT {_W} AS w), m AS (SELECT category, CASE WHEN category IN ('DDoS', 'DoS', 'Mirai') THEN 'pop:100-pkt' ELSE 'pop:10-pkt' END AS pop,
          x, {_ADV} AS adv FROM scaled, w WHERE split_name = 'test' AND y = 1),
        c AS (SELECT category, pop, {logit_sql('mlp', 'adv')} < 0 AS e, {logit_sql('mlp')} >= -1 AS p, sqrt(list_sum(list_transform(range(1, 21), lambda i: (adv[i] - x[i]) * (adv[i] - x[i])))) AS cost FROM m),
        g AS (SELECT unnest([category, pop, 'ALL']) AS grp, * FROM c)
        SELECT grp, count(*) AS n, round(100 * avg(e::INT), 6) AS evasion_pct, round(100 * avg(p::INT), 6) AS passes_pct, round(100 * avg((e AND p)::INT), 6) AS pass_and_evade_pct,
          round(median(cost) FILTER (WHERE e AND p), 6) AS med_cost FROM g GROUP BY grp""",
    "category_pivot": f"WITH {_LINES} SELECT attack, model, " + ", ".join(f"round(avg(pass_and_evade_pct) FILTER (WHERE grp = '{g}'), 6) AS \"{g}\"" for g in GROUPS) + " FROM lines GROUP BY attack, model",
    "tier_table": f"WITH {_LINES}, m AS (SELECT spec, attack, avg(pass_and_evade_pct) AS v FROM lines WHERE grp = 'all' GROUP BY ALL) SELECT {_TIER} AS tier, spec, round(max(v), 6) AS best FROM m GROUP BY ALL",
    "evasion_rates": f"""WITH {_LINES} SELECT spec, attack, printf('%.2f [%.1f, %.1f]', round(avg(evasion_pct), 6), round(avg(evasion_lo), 6), round(avg(evasion_hi), 6)) AS evasion,
        round(median(med_features_changed), 6) AS med_changed FROM lines WHERE grp = 'all' GROUP BY ALL""",
    "realism_audit": f"""WITH {FLOWS_SQL}, k AS (SELECT *, unnest(['all', CASE WHEN y = 1 THEN 'attack' ELSE 'benign' END]) AS kind FROM flows WHERE split_name = 'test')
        SELECT kind, count(*) AS n_rows, round(max(abs(srate - rate) / (abs(rate) + 1e-9)), 6) AS max_rel_rate, round(avg((duration BETWEEN 1 AND 255)::INT), 6) AS ttl_inside,
          round(avg((pkt_min <= pkt_avg AND pkt_avg <= pkt_max)::INT), 6) AS ordered, round(avg((rst_count = 0)::INT), 6) AS no_reset, round(avg((pkt_max <= 1514)::INT), 6) AS under_cap FROM k GROUP BY kind""",
    "eligible_rows": f"WITH {SCORE_SQL} SELECT category, count(*) AS n_rows, min(row_id) AS first_id FROM scored WHERE y = 1 AND split_name = 'test' AND p_mlp >= 0.5 AND p_cnn >= 0.5 AND p_lstm >= 0.5 GROUP BY category",
    "cell_verdicts": f"""WITH {SCORE_SQL}, w AS (SELECT {_W} AS w), m AS (SELECT *, {_ADV} AS adv FROM scored, w WHERE split_name = 'test' AND y = 1),
        j AS (SELECT category, p_mlp >= 0.5 AS c, {prob_sql('mlp', 'adv')} >= 0.5 AS a1, {prob_sql('cnn', 'adv')} >= 0.5 AS a2, {prob_sql('lstm', 'adv')} >= 0.5 AS a3,
          sqrt(list_sum(list_transform(range(1, 21), lambda i: (adv[i] - x[i]) * (adv[i] - x[i])))) AS l2 FROM m)
        SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE c) AS n_clean, count(*) FILTER (WHERE NOT a1) AS n_evades_target, count(*) FILTER (WHERE NOT (a1 OR a2 OR a3)) AS n_evades_ensemble, round(avg(l2), 6) AS mean_l2 FROM j GROUP BY category""",
    "integrality_overlap": STUMP_SQL + """, top AS (SELECT column_name, round(max(greatest(low, 1 - low)) - 0.5, 9) AS importance FROM b GROUP BY column_name ORDER BY importance DESC, column_name LIMIT 8)
        SELECT count(*) AS n_top, count(*) FILTER (WHERE i) AS n_integer, round(sum(importance) FILTER (WHERE i) / sum(importance), 6) AS mass FROM (SELECT *, column_name IN
          ('syn_flag_number', 'ack_flag_number', 'http', 'tcp', 'udp', 'icmp', 'protocol_type') AS i FROM top)""",
    "stream_gate": f"WITH {CHECKED_SQL} SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE reject) AS n_rejected FROM judged GROUP BY category",
}
