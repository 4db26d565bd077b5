"""Queries: overlap and leakage probes, correlations, discriminator data sets, grouped folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.functions.numeric import all_finite
from tidegate.operators import folds, networks as N, perturb as P, relate, sample
from tidegate.operators.metrics import binary_metrics, or_ensemble
from tidegate.operators.scorers import Linear, fit_forest
from tidegate.plans.base import FLOWS_SQL, SAMPLE, flows, member, rounded, scaling, unpivot_sql, vectors
from tidegate.schema import FEATURES
from tidegate.scratch import materialize
from tidegate.sources.tables import read_table

WIDE = ["flow_duration", "header_length", "rate", "srate", "tot_sum", "pkt_min", "pkt_avg", "pkt_max", "pkt_std", "tot_size", "variance"]
TINY = Linear("tiny", [1.7, -2.1, 0.9, 1.2, -1.4, 0.6, -0.8, 1.1], -0.25)  # declared scorer of the 8-value vectors
TINY_SQL = "(0.0" + "".join(f" + x_adv[{i + 1}]::DOUBLE * ({w})" for i, w in enumerate(TINY.weights)) + f" + ({TINY.bias}))"


def train_test_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return relate.overlap_by_label(rows.where("split_name = 'train'"), rows.where("split_name = 'test'"), FEATURES, "y", "class_name")


def stump_probe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relate.best_stumps(flows(spark, d).where("split_name = 'train'"), FEATURES, F.col("y")))


def correlated_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = relate.correlations(flows(spark, d).where("split_name = 'train'"), WIDE)
    return rounded(pairs.where(F.abs("r") > 0.3), 6)


def correlated_feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``correlated_pairs`` over all features; that one is bound to the columns of its SQL."""
    pairs = relate.correlations(flows(spark, d).where("split_name = 'train'"), FEATURES)
    return rounded(pairs.where(F.abs("r") > 0.3), 6)


def correlated_components(spark: SparkSession, d: str) -> DataFrame:
    pairs = relate.correlations(flows(spark, d).where("split_name = 'train'"), FEATURES)
    groups = relate.correlated_groups(pairs, FEATURES, 0.5)
    return spark.createDataFrame([(g[0], c) for g in groups for c in g], "root string, column_name string")


def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Every feature: those with |r| > 0.95 in train are shuffled together, the others alone."""
    rows, train = flows(spark, d).where("split_name = 'test'"), flows(spark, d).where("split_name = 'train'")
    flat = scaling(train).transform(rows, as_float=False)
    groups = relate.correlated_groups(relate.correlations(train, FEATURES), FEATURES, 0.95)
    score = lambda df: (member("mlp").prob([F.col(c) for c in FEATURES]) >= 0.5).cast("int")
    return relate.permutation_importance(flat, score, groups, "y", "row_id")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Test attack rows as perturbation cells of two attacks and two members."""
    rows = flows(spark, d)
    x, s = F.col("x_clean"), scaling(rows.where("split_name = 'train'"))
    test = rows.where("split_name = 'test' and y = 1").select(F.col("row_id").alias("source_id"), "y", s.vector().alias("x_clean"))
    cells = F.array(*(F.struct(F.lit(a.upper()).alias("attack"), F.lit(m).alias("model"), P.perturb(a, x, F.col("y"), member(m), eps=0.1).alias("x_adv")) for a in ("fgsm", "bim") for m in ("mlp", "cnn")))
    return test.select("source_id", "x_clean", F.inline(cells))


def discriminator_dataset(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    folds.check_cells_aligned(cells, "source_id")
    rows = flows(spark, d)
    s = scaling(rows.where("split_name = 'train'"))
    pool = rows.where("split_name in ('test', 'train')").select(F.col("row_id").alias("source_id"), s.vector().alias("x"), "y")
    made = folds.discriminator_dataset(cells, pool, "auto", True).where(F.size("x") == len(FEATURES))
    return made.groupBy("origin", "attack", "model", "y").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_key").alias("n_groups"))


def pool_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Flow rows whose id is no source of an adversarial record."""
    rows = flows(spark, d).select("row_id", "category")
    seen = read_table(spark, d, "adv_rows").where("group_key is not null").select(F.col("group_key").alias("row_id"))
    return folds.unseen(rows, seen, "row_id").groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "adv_rows")
    return raw.select("record_id", "group_key", F.lower(F.trim("attack")).alias("attack"), F.lower(F.trim("model")).alias("model"), "origin", F.col("y").cast("int").alias("y"), "x_adv", "linf")


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.grouped_holdout(_records(spark, d).select("record_id", "group_key"), "group_key", 0.3).select("record_id", "in_test")


def leave_one_out_fold(spark: SparkSession, d: str) -> DataFrame:
    fold = sample.leave_one_out(_records(spark, d), "group_key", "attack", "deepfool", F.col("y") == 1, 0.3)
    return fold.groupBy("in_test", "attack", "y").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("record_id").alias("ids"))


def catch_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Adversarial records flagged by a declared scorer, per attack and per model."""
    rows = _records(spark, d).withColumn("pred", (TINY.logit(F.col("x_adv").cast("array<double>")) >= 0).cast("int"))
    by = [folds.catch_by(rows, f).withColumnRenamed(f, "value").withColumn("field", F.lit(f)) for f in ("attack", "model")]
    return rounded(by[0].unionByName(by[1]))


def worst_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Per model the attack that is caught least."""
    rows = _records(spark, d).withColumn("pred", (TINY.logit(F.col("x_adv").cast("array<double>")) >= 0).cast("int"))
    rates = rows.where("y = 1").groupBy("model", "attack").agg(F.round(F.avg((F.col("pred") == 1).cast("double")), 6).alias("rate"))
    worst = rates.groupBy("model").agg(F.min(F.struct("rate", "attack")).alias("w"))
    return worst.select("model", "w.attack", "w.rate")


def attack_success(spark: SparkSession, d: str) -> DataFrame:
    from tidegate.operators.metrics import success_rate

    rows = _records(spark, d).where("origin = 'adv'")
    return rounded(success_rate(rows, (TINY.logit(F.col("x_adv").cast("array<double>")) >= 0).cast("int"), ["attack", "model"]))


def augment_pool(spark: SparkSession, d: str) -> DataFrame:
    """Training rows and adversarial ones worth a fifth of them, the held-out attack left out."""
    rows = flows(spark, d)
    s = scaling(rows.where("split_name = 'train'"))
    clean = rows.where("split_name = 'train'").select(F.col("row_id").alias("id"), F.slice(s.vector(), 1, 8).alias("x"), "y")
    pool = _records(spark, d).where("origin = 'adv'").select(F.col("record_id").alias("id"), F.col("x_adv").cast("array<double>").alias("x"), "attack", "model")
    made = folds.augmented(clean, folds.select_pool(pool, "mlp", ["DeepFool"]), 0.02, "id")
    return made.groupBy("origin", "attack", "model", "y").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("ids"))


def discriminator_fit(spark: SparkSession, d: str) -> DataFrame:
    """Forests that tell adversarial records from clean ones, one per hold-out: a third of the groups at random, and
    each attack and each model left out. One row per hold-out with the rates on what was held out."""
    rows = _records(spark, d).select("record_id", "group_key", "attack", "model", F.col("y").cast("double").alias("y"), *(F.col("x_adv")[i].cast("double").alias(f"x{i}") for i in range(8)))
    rows = materialize(rows.where(all_finite([f"x{i}" for i in range(8)])), "records")
    held = [("random", "")] + [("attack", a) for a in folds.attacks(rows)] + [("model", m) for m in folds.models(rows)]
    out = []
    for field, name in held:
        if field == "random":
            fold = sample.grouped_holdout(rows, "group_key", 0.3)
        else:
            fold = sample.leave_one_out(rows, "group_key", field, name, F.col("y") == 1, 0.3)
        train = sample.ranked(fold.where("not in_test"), [], "record_id", F.least("n_stratum", F.lit(SAMPLE)), 42)
        test = fit_forest(train, [f"x{i}" for i in range(8)], "y").transform(fold.where("in_test"))
        row = binary_metrics(test, F.col("y"), F.col("prediction")).first()
        out.append((field, name, row.n_rows, row.recall, row.fpr, row.balanced_accuracy))
    return rounded(spark.createDataFrame(out, "protocol string, held string, n_rows long, catch_rate double, fpr double, balanced_accuracy double"))


def retraining_rows(train: DataFrame, base: dict[str, N.Network], attacks: dict[str, dict], max_rows: int | None = None) -> DataFrame:
    """(id, x, y) that networks are trained on again: the training rows and, worth a fifth of them, attack rows perturbed
    under each of the networks by each of the attacks but deepfool; with ``max_rows`` a sample of both.

    Pool and sample are drawn by ids, which do not depend on the perturbed vectors; so the draws come first, over all
    rows, with a mark in place of each vector. Only rows that are trained on get their vectors back and are perturbed."""
    mark = F.xxhash64("row_id", "y", "x")
    light = train.where("x is not null").select("row_id", "y", mark.alias("x"))
    cells = F.array(*(F.struct(F.lit(a).alias("attack"), F.lit(m).alias("model")) for m in base for a in attacks))
    pool = folds.select_pool(light.where("y = 1").select("row_id", "x", F.inline(cells)), "mlp", ["DeepFool"])
    pool = pool.select(F.xxhash64("row_id", "attack", "model").alias("id"), "row_id", "x", "attack", "model")
    chosen = materialize(folds.augmented(light.select(F.col("row_id").alias("id"), "row_id", "x", "y"), pool, 0.2, "id", keep=["row_id"]), "augmented")
    if max_rows is not None:
        chosen = materialize(N.drawn(chosen, "id", "x", "y", max_rows), "drawn")
    keys = ["row_id", "mark"]  # a row id that stands on several rows tells them apart by the mark
    found = train.where("x is not null").select("row_id", mark.alias("mark"), "x").dropDuplicates(keys)
    rows = chosen.withColumnRenamed("x", "mark").join(found, keys).repartition(train.sparkSession.sparkContext.defaultParallelism, "id")  # a row costs far more than its size
    return N.perturbed_by(rows.select("id", "row_id", "x", "y", "attack", "model"), base, attacks, "row_id", "x", "y").select("id", "x", "y")


def ensemble_retrain(spark: SparkSession, d: str) -> DataFrame:
    """Networks trained on all clean rows and again on all rows augmented with perturbed ones (deepfool held out): rates
    on clean test rows and on perturbed ones, for each network and for the OR of the retrained."""
    train, test = vectors(spark, d)
    attacks, members = {"fgsm": {"eps": 0.1}, "pgd": {"eps": 0.1}, "deepfool": {}}, ("mlp", "cnn")
    n_tasks = N.tasks_for(spark, train.count())
    base = N.trained_on_all(members, train, "row_id", "x", "y", n_tasks)
    again = N.trained_on_all(members, retraining_rows(train, base, attacks), "id", "x", "y", n_tasks)
    moved = N.perturbed_rows(test.where("y = 1"), base["mlp"], attacks, "row_id", "x", "y")
    sets = test.select(F.lit("clean").alias("rows"), "y", "x").unionByName(moved.select(F.col("attack").alias("rows"), F.lit(1).alias("y"), F.col("x_adv").alias("x")))
    judged = sets.select("rows", "y", *((N.on_rows(F.col("x"), n.margin) >= 0).cast("int").alias(f"{w}_{m}") for w, ns in (("clean", base), ("again", again)) for m, n in ns.items()))
    judged = judged.withColumn("again_or", or_ensemble([F.col(f"again_{m}") for m in members]))
    flags = ("clean_mlp", "clean_cnn", "again_mlp", "again_cnn", "again_or")
    per = judged.select("rows", "y", F.inline(F.array(*(F.struct(F.lit(f).alias("network"), F.col(f).alias("pred")) for f in flags))))
    return rounded(binary_metrics(per, F.col("y"), F.col("pred"), ["rows", "network"]).select("rows", "network", "n_rows", "recall", "fpr"))


def linf_by_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where("origin = 'adv'")
    return rounded(rows.groupBy("attack", "model").agg(F.max("linf").alias("max_linf"), F.avg("linf").alias("mean_linf"), F.count("linf").alias("n_known")))


QUERIES = {f.__name__: f for f in (
    train_test_overlap, stump_probe, correlated_pairs, correlated_feature_pairs, correlated_components, permutation_importance, discriminator_dataset, pool_antijoin, grouped_split,
    leave_one_out_fold, catch_by_family, worst_holdout, attack_success, augment_pool, ensemble_retrain, linf_by_cell,
)}

_F32 = ", ".join(f"{c}::FLOAT AS f{i}" for i, c in enumerate(FEATURES))
_ON = " AND ".join(f"a.f{i} = b.f{i}" for i in range(len(FEATURES)))
_KEYS = ", ".join(f"f{i}" for i in range(len(FEATURES)))
_REC = "rec AS (SELECT record_id, group_key, lower(trim(attack)) AS attack, lower(trim(model)) AS model, origin, y, x_adv, linf, " + TINY_SQL + " >= 0 AS pred FROM adv_rows)"
_HELD = """held AS (SELECT r.*, t.rk <= ceil(t.n * 0.3::DOUBLE) AS in_test FROM rec r JOIN (SELECT g, row_number() OVER (ORDER BY md5('42:' || g)) AS rk, count(*) OVER () AS n
    FROM (SELECT DISTINCT coalesce('=' || group_key, '-') AS g FROM rec)) t ON t.g = coalesce('=' || r.group_key, '-'))"""
_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]]
_FEATURE_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]

STUMP_SQL = f"""WITH {FLOWS_SQL}, c AS (SELECT column_name, x, sum(y) AS pos, count(*) AS n FROM ({unpivot_sql('flows', 'y', "split_name = 'train'")}) GROUP BY column_name, x),
        r AS (SELECT column_name, x, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER o AS p, sum(n - pos) OVER o AS m FROM c
          WINDOW w AS (PARTITION BY column_name ORDER BY x ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY column_name)),
        b AS (SELECT *, (tp::DOUBLE / p + (m - fp)::DOUBLE / m) / 2 AS low FROM r)"""

SQL = {
    "train_test_overlap": f"""WITH {FLOWS_SQL}, b AS (SELECT {_KEYS}, bit_or(1::BIGINT << y) AS mask FROM (SELECT y, {_F32} FROM flows WHERE split_name = 'train') GROUP BY {_KEYS}),
        a AS (SELECT class_name, y, {_F32} FROM flows WHERE split_name = 'test'), j AS (SELECT a.class_name, a.y, b.mask FROM a LEFT JOIN b ON {_ON})
        SELECT class_name, count(*) AS n_rows, count(mask) AS n_in_train, count(*) FILTER (WHERE (mask >> y) & 1 = 1) AS n_same_label,
          count(*) FILTER (WHERE mask IS NOT NULL AND (mask >> y) & 1 = 0) AS n_other_label_only FROM j GROUP BY class_name""",
    "stump_probe": STUMP_SQL + """
        SELECT column_name, round(max(greatest(low, 1 - low)), 6) AS balanced_accuracy, count(*) AS n_distinct, max(greatest(low, 1 - low)) >= 0.99 AS suspect FROM b GROUP BY column_name""",
    "correlated_pairs": f"WITH {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE split_name = 'train'), p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM t" for a, b in _PAIRS) + ") SELECT column_a, column_b, round(r, 6) AS r FROM p WHERE abs(r) > 0.3",
    "correlated_feature_pairs": f"WITH {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE split_name = 'train'), p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM t" for a, b in _FEATURE_PAIRS) + ") SELECT column_a, column_b, round(r, 6) AS r FROM p WHERE abs(r) > 0.3",
    "correlated_components": f"WITH RECURSIVE {FLOWS_SQL}, t AS (SELECT * FROM flows WHERE split_name = 'train'), p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM t" for a, b in _FEATURE_PAIRS) + f"""), links AS (SELECT a, b FROM p WHERE abs(r) > 0.5 UNION SELECT b, a FROM p WHERE abs(r) > 0.5),
        reach AS (SELECT unnest({FEATURES}) AS c, unnest({FEATURES}) AS seen UNION SELECT r.c, l.b FROM reach r JOIN links l ON r.seen = l.a)
        SELECT min(seen) AS root, c AS column_name FROM reach GROUP BY c""",
    "discriminator_dataset": f"""WITH {FLOWS_SQL}, s AS (SELECT row_id FROM flows WHERE split_name = 'test' AND y = 1),
        pool AS (SELECT row_id, y FROM flows WHERE split_name IN ('test', 'train') AND row_id NOT IN (SELECT row_id FROM s)),
        k AS (SELECT greatest(0, 4 * count(*) - count(DISTINCT row_id)) AS extra FROM s),
        n AS (SELECT y, least(count(*), round_even(any_value(extra)::DOUBLE * count(*) / (SELECT count(*) FROM pool), 0))::BIGINT AS q FROM pool, k GROUP BY y)
        SELECT 'adv' AS origin, a AS attack, m AS model, 1 AS y, count(*) AS n_rows, count(DISTINCT row_id) AS n_groups FROM s, (SELECT unnest(['fgsm', 'bim']) AS a), (SELECT unnest(['mlp', 'cnn']) AS m) GROUP BY a, m
        UNION ALL SELECT 'twin', 'none', 'none', 0, count(*), count(*) FROM s UNION ALL SELECT 'pool', 'none', 'none', 0, sum(q)::BIGINT, sum(q)::BIGINT FROM n""",
    "pool_antijoin": f"""WITH {FLOWS_SQL} SELECT category, count(*) AS n_rows, min(row_id) AS first_id FROM flows f
        WHERE NOT EXISTS (SELECT 1 FROM adv_rows a WHERE a.group_key = f.row_id) GROUP BY category""",
    "grouped_split": f"WITH {_REC}, {_HELD} SELECT record_id, in_test FROM held",
    "leave_one_out_fold": f"""WITH {_REC}, {_HELD} SELECT in_test, attack, y, count(*) AS n_rows, sum(record_id)::BIGINT AS ids FROM held
        WHERE y <> 1 OR in_test = coalesce(attack = 'deepfool', false) GROUP BY ALL""",
    "catch_by_family": f"""WITH {_REC} SELECT 'attack' AS field, attack AS value, count(*) AS n_rows, round(avg(pred::INT), 6) AS catch_rate FROM rec WHERE y = 1 GROUP BY attack
        UNION ALL SELECT 'model', model, count(*), round(avg(pred::INT), 6) FROM rec WHERE y = 1 GROUP BY model""",
    "worst_holdout": f"""WITH {_REC}, r AS (SELECT model, attack, round(avg(pred::INT), 6) AS rate FROM rec WHERE y = 1 GROUP BY ALL)
        SELECT model, attack, rate FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY rate, attack) = 1""",
    "attack_success": f"WITH {_REC} SELECT attack, model, round(avg((NOT pred)::INT), 6) AS success_rate FROM rec WHERE origin = 'adv' GROUP BY ALL",
    "augment_pool": f"""WITH {FLOWS_SQL}, {_REC}, c AS (SELECT row_id, y FROM flows WHERE split_name = 'train'),
        p AS (SELECT *, row_number() OVER (PARTITION BY attack, model ORDER BY md5('42:' || record_id)) AS rk FROM rec WHERE origin = 'adv' AND attack <> 'deepfool'),
        q AS (SELECT floor(0.02::DOUBLE * (SELECT count(*) FROM c) / (SELECT count(DISTINCT (attack, model)) FROM p)) AS q)
        SELECT 'clean' AS origin, NULL AS attack, NULL AS model, y, count(*) AS n_rows, sum(row_id)::BIGINT AS ids FROM c GROUP BY y
        UNION ALL SELECT 'adv', attack, model, 1, count(*), sum(record_id)::BIGINT FROM p, q WHERE rk <= q GROUP BY attack, model""",
    "linf_by_cell": f"WITH {_REC} SELECT attack, model, round(max(linf), 6) AS max_linf, round(avg(linf), 6) AS mean_linf, count(linf) AS n_known FROM rec WHERE origin = 'adv' GROUP BY ALL",
}
