"""Metrics, operating points, ensembles, cascade, folds and relations on planted rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import cascade as C, folds, metrics as M, relate


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "p double")


def test_threshold_is_tight(spark):
    rng = random.Random(0)
    values = [rng.random() for _ in range(2000)]
    row = M.operating_points(scores(spark, values), "p", 0.02).first()
    t = math.nextafter(sorted(values, reverse=True)[math.floor(0.02 * len(values))], math.inf)  # smallest threshold in budget
    assert sum(v >= t for v in values) == 40 == sum(v > row.flag_above for v in values) and row.n_benign == 2000 and t == math.nextafter(row.flag_above, math.inf)


def test_threshold_ties_and_edges(spark):
    values = [1.0] * 50 + list(np.linspace(0, 0.9, 950))
    assert M.operating_points(scores(spark, values), "p", 0.02).first().flag_above == 1.0
    assert M.operating_points(scores(spark, [0.5]), "p", 1.0).first().flag_above is None


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 11 + [(None, 1)], "y int, p int")
    r = M.binary_metrics(df, F.col("y"), F.col("p")).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (6, 2, 1, 11) and r.accuracy == 0.85 and r.recall == 0.75 and r.fpr == pytest.approx(1 / 12)
    f1, f0 = 12 / 15, 22 / 25
    assert r.f1 == pytest.approx(f1) and r.weighted_f1 == pytest.approx((f1 * 8 + f0 * 12) / 20)
    none = M.binary_metrics(df.where("y = 7"), F.col("y"), F.col("p")).first()
    assert none.accuracy == none.precision == none.recall == 0.0


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", i < 900) for i in range(1800)] + [("b", i < 30) for i in range(100)], "g string, hit boolean")
    ci = {r.g: (r.ci_low, r.rate, r.ci_high) for r in M.bootstrap_ci(df, F.col("hit"), ["g"]).collect()}
    assert ci["a"][0] < 0.5 < ci["a"][2] and ci["a"][2] - ci["a"][0] < 0.06 and ci["b"][0] < 0.3 < ci["b"][2] and ci["b"][2] - ci["b"][0] < 0.2


def test_ensembles(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (1, 1, 1), (0, 1, 0)], "a int, b int, y int")
    assert [r[0] for r in df.select(M.or_ensemble([F.col("a"), F.col("b")])).collect()] == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        M.or_ensemble([])
    d = {r.member: (r.n_alone, r.n_catches, r.n_false_alarms, r.unanimous_share) for r in M.disagreement(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y")).collect()}
    assert d == {"a": (1, 1, 0, 0.5), "b": (1, 0, 1, 0.5)}
    w = {r.y: r.weight for r in M.class_weights(df, "y").collect()}
    assert w == {0: 1.0, 1: 1.0}
    cw = M.category_weights(spark.createDataFrame([("x",)] * 30 + [("z",)] * 10, "c string"), "c", 0.5).collect()
    assert sum(r.weight * r.n_rows for r in cw) / 40 == pytest.approx(1.0) and {r.c: r.weight for r in cw}["z"] > 1


def eight(spark):
    return spark.createDataFrame([(float(i),) for i in range(8)], "x double")


STAGES = {"validator": F.col, "discriminator": F.col, "ensemble": F.col}


def stages():
    return {"validator": F.col("x").isin(0.0, 1.0), "discriminator": F.col("x").isin(1.0, 2.0), "ensemble": F.col("x").isin(0.0, 5.0)}


def test_first_stop_owns_the_row(spark):
    out = {r.x: r.stage for r in C.Cascade(dict(reversed(stages().items()))).decide(eight(spark)).collect()}
    assert out == {0.0: "validator", 1.0: "validator", 2.0: "discriminator", 3.0: "allowed", 4.0: "allowed", 5.0: "ensemble", 6.0: "allowed", 7.0: "allowed"}
    decided = C.Cascade(stages()).decide(eight(spark))
    assert {r.stage: r.n_rows for r in C.stage_counts(decided, C.STAGES).collect()} == {"validator": 2, "discriminator": 1, "ensemble": 1, "allowed": 4}
    assert C.stop_rate(decided).first().stop_rate == 0.5


def test_function_stages_only_see_open_rows(spark):
    seen = []

    def model(df):
        seen.append(df.count())
        return df.withColumn("_stop", F.col("x") == 2.0)

    mixed = stages() | {"discriminator": model}
    out = {r.x: r.stage for r in C.Cascade(mixed).decide(eight(spark)).collect()}
    assert seen == [6] and out[2.0] == "discriminator" and out[1.0] == "validator" and len(out) == 8
    with pytest.raises(ValueError):
        C.Cascade({"discriminator": lambda df: df}).decide(eight(spark))
    for bad in ({}, {"nope": F.lit(True)}):
        with pytest.raises(ValueError):
            C.Cascade(bad)


def test_ablation_and_marginals(spark):
    rates = {r.stages: r.stop_rate for r in C.ablate(eight(spark), stages()).collect()}
    assert len(rates) == 7 and rates["validator"] == 0.25 and rates["validator+discriminator+ensemble"] == 0.5
    assert {r.stage: r.marginal for r in C.marginal_contribution(eight(spark), stages()).collect()} == {"validator": 0.0, "discriminator": 0.125, "ensemble": 0.125}
    assert C.marginal_contribution(eight(spark), {"validator": F.lit(True)}).first().marginal == 1.0


def cells(spark, n=60):
    rows = [(a, m, s, [float(s)], [s + 0.5]) for a in ("FGSM", "bim", "pgd", "DeepFool") for m in ("mlp", "cnn", "lstm") for s in range(n)]
    return spark.createDataFrame(rows, "attack string, model string, source_id long, x_clean array<double>, x_adv array<double>")


def test_discriminator_dataset(spark):
    pool = spark.createDataFrame([(s, [float(s)], int(s % 4 == 0)) for s in range(4000)], "source_id long, x array<double>, y int")
    made = folds.discriminator_dataset(cells(spark), pool)
    by = {r.origin: r["count"] for r in made.groupBy("origin").count().collect()}
    assert by == {"adv": 720, "twin": 60, "pool": 660} and made.where("group_key < 60").groupBy("group_key").count().select("count").distinct().collect()[0][0] == 13
    assert made.where("origin = 'pool' and group_key < 60").count() == 0 and folds.attacks(made) == ["bim", "deepfool", "fgsm", "pgd"] and folds.models(made) == ["cnn", "lstm", "mlp"]
    folds.check_cells_aligned(cells(spark), "source_id")
    with pytest.raises(ValueError):
        folds.check_cells_aligned(cells(spark).where("not (attack = 'bim' and source_id = 3)"), "source_id")


def test_pool_and_augmentation(spark):
    pool = cells(spark).withColumn("id", F.xxhash64("attack", "model", "source_id")).withColumnRenamed("x_adv", "x")
    assert folds.select_pool(pool, "MLP", ["deepfool"], "own").groupBy("attack").count().count() == 3
    with pytest.raises(ValueError):
        folds.select_pool(pool, "mlp", [], "some")
    clean = spark.createDataFrame([(i, [0.0], int(i % 10 == 0)) for i in range(500)], "id long, x array<double>, y int")
    out = folds.augmented(clean, pool, 0.24, "id")
    assert out.where("origin = 'adv'").count() == 120 and out.where("origin = 'adv' and y = 1").groupBy("attack", "model").count().select("count").distinct().collect() == [(10,)]
    assert folds.unseen(clean, clean.where("id < 100"), "id").count() == 400


def test_overlap(spark):
    train = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 0), (0.1, 1)], "x double, y int")
    test = spark.createDataFrame([(1.0, 1, "a"), (2.0, 1, "a"), (0.1 + 1e-10, 1, "b"), (9.0, 0, "b")], "x double, y int, g string")
    got = {r.g: (r.n_rows, r.n_in_train, r.n_same_label, r.n_other_label_only) for r in relate.overlap_by_label(train, test, ["x"], "y", "g").collect()}
    assert got == {"a": (2, 2, 1, 1), "b": (2, 1, 1, 0)}


def test_correlations_stumps_importance(spark):
    rng = random.Random(0)
    rows = []
    for i in range(800):
        y, z = i % 2, rng.random()
        rows.append((i, y, y + rng.random() * 0.5, 2 * z, z + 1e-6 * rng.random(), 7.0))
    df = spark.createDataFrame(rows, "id long, y int, leak double, a double, b double, flat double")
    pairs = relate.correlations(df, ["leak", "a", "b", "flat"])
    assert relate.correlated_groups(pairs, ["leak", "a", "b", "flat"]) == [("a", "b"), ("flat",), ("leak",)]
    stumps = {r.column_name: (r.balanced_accuracy, r.suspect) for r in relate.best_stumps(df, ["leak", "a", "flat"], F.col("y")).collect()}
    assert stumps["leak"] == (1.0, True) and not stumps["a"][1] and stumps["flat"][0] == 0.5
    drop = {r.column_group: r.importance for r in relate.permutation_importance(df, lambda d: (F.col("leak") >= 0.75).cast("int"), [["leak"], ["a", "b"]], "y", "id", 2).collect()}
    assert drop["leak"] > 0.3 and drop["a+b"] == 0.0
    numbers = [r._n for r in relate.numbered(df.select("id"), F.xxhash64("id")).collect()]
    assert sorted(numbers) == list(range(800))
