"""Correlations and reliance cover every feature of the flow table."""

import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from tidegate.operators import folds, networks as N
from tidegate.plans import pools
from tidegate.schema import FEATURES

DATA = "/root/testdata/sf0.01"


def test_components_hold_every_feature(spark):
    rows = pools.correlated_components(spark, DATA).collect()
    assert sorted(r.column_name for r in rows) == sorted(FEATURES)
    root = {r.column_name: r.root for r in rows}
    assert root["protocol_type"] == root["udp"] == root["tcp"] != root["rate"]


def test_feature_pairs(spark):
    compare(spark, DATA, pools.correlated_feature_pairs, pools.SQL["correlated_feature_pairs"])
    pairs = {(r.column_a, r.column_b) for r in pools.correlated_feature_pairs(spark, DATA).collect()}
    assert {("protocol_type", "udp"), ("ack_flag_number", "tcp"), ("tcp", "udp")} <= pairs


def test_importance_of_every_feature(spark):
    groups = [r.column_group.split("+") for r in pools.permutation_importance(spark, DATA).collect()]
    assert sorted(c for g in groups for c in g) == sorted(FEATURES)
    assert ["pkt_avg", "pkt_min", "tot_size"] in groups and ["rate", "srate"] in groups


def test_only_rows_that_are_trained_on_are_perturbed(spark):
    """The same rows and vectors as perturbing the whole pool before the draws, asking the networks about the drawn alone."""
    asked = spark.sparkContext.accumulator(0)

    class Counted(N.Network):
        def slope(self, x):
            asked.add(len(x))
            return N.Network.slope(self, x)

    x = np.random.default_rng(4).random((400, 3))
    train = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, y int, x array<double>")
    attacks = {"fgsm": {"eps": 0.1}, "pgd": {"eps": 0.1}, "deepfool": {}}
    base = {m: Counted.build("mlp", 3, [N.Dense(4), N.Relu(), N.Dense(2)], seed=k) for k, m in enumerate(("mlp", "cnn"))}
    got = {r.id: r for r in pools.retraining_rows(train, base, attacks, 90).collect()}
    n_moved = sum(i not in range(400) for i in got)
    assert len(got) == 90 and 5 < n_moved and 0 < asked.value <= 10 * n_moved

    cells = [N.perturbed_rows(train.where("y = 1"), n, attacks, "row_id", "x", "y").withColumn("model", F.lit(m)) for m, n in base.items()]
    pool = folds.select_pool(cells[0].unionByName(cells[1]), "mlp", ["DeepFool"]).select(F.xxhash64("row_id", "attack", "model").alias("id"), F.col("x_adv").alias("x"), "attack", "model")
    whole = folds.augmented(train.select(F.col("row_id").alias("id"), "x", "y"), pool, 0.2, "id")
    expected = {r.id: r for r in N.drawn(whole, "id", "x", "y", 90).collect()}
    assert got.keys() == expected.keys() and all(got[i].y == r.y and np.allclose(got[i].x, r.x, rtol=0, atol=1e-12) for i, r in expected.items())


def test_all_rows_are_trained_on_again(spark):
    """More training rows than the samples hold: each comes once, and a fifth of them perturbed."""
    x = F.array(F.col("id") / 21_000, F.lit(0.5))
    train = spark.range(21_000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), x.alias("x"))
    base = {m: N.Network.build("mlp", 2, [N.Dense(4), N.Relu(), N.Dense(2)], seed=k) for k, m in enumerate(("mlp", "cnn"))}
    got = pools.retraining_rows(train, base, {"fgsm": {"eps": 0.1}, "deepfool": {}}).cache()
    clean = got.where("id BETWEEN 0 AND 20999")
    assert got.count() == 25_200 and clean.select("id").distinct().count() == 21_000 == clean.where(x.eqNullSafe(F.col("x"))).count()
