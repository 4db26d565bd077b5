"""Facts planted in a toy table: duplicates, a conflict, bad rows, near-constant columns, caps, splits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions.numeric import inverse_signed_log1p, signed_log1p
from tidegate.operators import prepare, sample, scan
from tidegate.operators.order import exact_quantiles, running_sums
from tidegate.operators.scaling import Scaling

LABELS = [("benigntraffic", "BenignTraffic", 0, 0, "Benign"), ("ddosicmpflood", "DDoS-ICMP_Flood", 1, 1, "DDoS"), ("sqlinjection", "SqlInjection", 2, 1, "Web")]


def toy(spark):
    rows = [(float(i), 10.0 + i, "BenignTraffic") for i in range(50)]
    rows += [(1000.0 + i % 10, 5.0, "DDoS-ICMP_Flood") for i in range(100)]
    rows += [(2000.0 + i, 7.0, "SqlInjection ") for i in range(4)] + [(0.0, 10.0, "sql injection"), (float("nan"), 1.0, "SqlInjection")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, flow_duration double, tot_sum double, label string")
    return scan.with_codes(df, "label", spark.createDataFrame(LABELS, "slug string, class_name string, code int, is_attack int, category string"))


X = ["flow_duration", "tot_sum"]


def test_planted_facts(spark):
    df = toy(spark)
    report = {r.code: r for r in scan.duplicate_report(df, X, "code", "row_id").collect()}
    assert {c: r.n_rows for c, r in report.items()} == {0: 50, 1: 100, 2: 6}
    assert {c: (r.n_duplicates, r.n_conflicting, r.n_bad) for c, r in report.items()} == {0: (0, 1, 0), 1: (90, 0, 0), 2: (0, 1, 1)}
    assert [(r.column_name, r.n_nan, r.n_inf) for r in scan.column_faults(df, X).collect()] == [("flow_duration", 1, 0), ("tot_sum", 0, 0)]
    good = scan.vectors(df, X, "code", "row_id").where("n_bad = 0").select("code", F.col("first_id").alias("row_id"))
    kept = sample.capped(good, "code", "row_id", 8, [0]).groupBy("code").count().collect()
    assert {r[0]: r[1] for r in kept} == {0: 50, 1: 8, 2: 5}
    ledger = {r.code: (r.n_bad, r.n_duplicates, r.n_kept) for r in prepare.clean_ledger(df, X, "code").collect()}
    assert ledger == {0: (0, 0, 50), 1: (0, 90, 10), 2: (1, 0, 5)}
    assert prepare.clean_rows(df, X, "code").count() == 65


def test_float32_and_dropped_columns(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0, 0), (2, 0.1 + 1e-10, 2.0, 0), (3, -0.0, 3.0, 0), (4, 0.0, 4.0, 0)], "row_id long, a double, iat double, code int")
    assert scan.vectors(df, ["a"], "code", "row_id").count() == 2 and scan.vectors(df, ["a", "iat"], "code", "row_id").count() == 4
    marked = scan.annotate(df, ["a", "iat"], ["iat"]).collect()
    assert marked[0].feat_hash32 == marked[1].feat_hash32 != marked[2].feat_hash32 == marked[3].feat_hash32 and marked[0].feat_hash64 != marked[1].feat_hash64
    with pytest.raises(ValueError):
        scan.annotate(df, ["a"], ["nope"])


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([("mystery",)], "label string")
    labels = spark.createDataFrame(LABELS, "slug string, class_name string, code int, is_attack int, category string")
    with pytest.raises(ValueError):
        scan.with_codes(df, "label", labels)
    assert scan.with_codes(df, "label", labels, strict=False).first().code is None


def test_near_constant(spark):
    df = spark.range(1000).select(F.lit(1.0).alias("constant"), F.when(F.col("id") == 7, 1.0).otherwise(0.0).alias("one_hit"), F.when(F.col("id") < 150, 1.0).otherwise(0.0).alias("rare"), F.col("id").cast("double").alias("dense"))
    assert prepare.near_constant_columns(df, df.columns, 0.0, 100) == ["constant", "one_hit"]
    assert prepare.near_constant_columns(df, df.columns, 0.0, 0) == ["constant"]


def test_signed_log1p(spark):
    values = [-1e9, -3.5, -1.0, 0.0, 1e-9, 2.0, 8.3e7, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("y", signed_log1p(F.col("x")))
    rows = df.select("x", "y", inverse_signed_log1p(F.col("y")).alias("z")).collect()
    assert all(math.isclose(r.x, r.z, rel_tol=1e-12) for r in rows) and [r.y for r in rows] == sorted(r.y for r in rows)
    with pytest.raises(KeyError):
        prepare.apply_log1p(df, ["nope"])


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("int").alias("code"))
    out = sample.stratified_split(df, "code", "row_id", {"train": 0.7, "val": 0.15, "test": 0.15})
    assert {(r[0], r[1]): r[2] for r in out.groupBy("code", "split_name").count().collect()} == {(c, s): n for c in range(5) for s, n in (("train", 140), ("val", 30), ("test", 30))}
    assert out.select("row_id").distinct().count() == 1000
    with pytest.raises(ValueError):
        sample.stratified_split(df, "code", "row_id", {"train": 0.7, "val": 0.2, "test": 0.2})
    with pytest.raises(ValueError):
        sample.stratified_split(df.where("code > 0 or row_id < 30"), "code", "row_id", {"train": 0.7, "val": 0.15, "test": 0.15})
    with pytest.raises(ValueError):
        sample.exactly(df, "row_id", 1001)
    assert sample.exactly(df, "row_id", 10).count() == 10 and sample.fraction(df, "row_id", 0.25).count() == 250


def test_ranked_is_the_md5_order(spark):
    import hashlib

    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("code"))
    got = {}
    for r in sample.ranked(df, ["code"], "row_id", F.lit(20), 9).collect():
        got.setdefault(r.code, set()).add(r.row_id)
    for code, ids in got.items():
        own = [i for i in range(500) if (i % 3 or None) == code]
        assert ids == set(sorted(own, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:20])
    assert sorted(got, key=str) == [1, 2, None]


def test_groups_never_straddle(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), F.when(F.col("id") % 60 > 0, F.col("id") % 60).alias("g"), F.when(F.col("id") % 2 == 0, "pgd").otherwise("bim").alias("attack"))
    out = sample.grouped_holdout(df, "g", 0.3)
    assert out.groupBy("g").agg(F.count_distinct("in_test").alias("n")).agg(F.max("n")).first()[0] == 1
    assert out.where("in_test").select("g").distinct().count() == 18 and out.count() == 600
    fold = sample.leave_one_out(df, "g", "attack", "pgd", F.lit(True), 0.3)
    assert {(r.attack, r.in_test) for r in fold.select("attack", "in_test").distinct().collect()} == {("pgd", True), ("bim", False)}
    with pytest.raises(ValueError):
        sample.leave_one_out(df, "g", "attack", "nope", F.lit(True), 0.3)


@pytest.mark.parametrize("n,spread", [(1, 1), (2, 9), (1000, 5), (5000, 10**9)])
def test_exact_quantiles(spark, n, spread):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([float(rng.randrange(spread)), rng.random()])) for _ in range(n)] + [("a", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.01, 0.5, 0.99, 0.999, 1.0]
    want = df.where("not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q"), F.count("x").alias("n")).where("n > 0").collect()
    got = {r.g: (r.n_values, r.q) for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    assert set(got) == {r.g for r in want}
    for r in want:
        assert got[r.g][0] == r.n and got[r.g][1] == pytest.approx(r.q, rel=1e-12)


def test_exact_quantiles_of_large_groups(spark, monkeypatch):
    from tidegate.operators import order

    monkeypatch.setattr(order, "SMALL", 0)
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.floor(F.rand(3) * 50_000).cast("double").alias("x"))
    df = df.cache()
    probs = [0.0, 0.001, 0.5, 0.99, 1.0]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0]
    assert exact_quantiles(df, ["g"], "x", probs).first().q == pytest.approx(want)
    df.unpersist()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = random.Random(1)
    rows = [(g, float(x), rng.randrange(9)) for g in ("a", None) for x in rng.sample(range(10_000), 700)]
    got = running_sums(spark.createDataFrame(rows, "g string, x double, n int"), ["g"], "x", {"s": "n"}, descending).collect()
    for g in ("a", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending), 0
        mine = {r.x: r.s for r in got if r.g == g}
        for _, x, n in own:
            total += n
            assert mine[x] == total


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(0.0, 5.0, 3.0), (10.0, 5.0, -100.0), (1e6, 5.0, 50.0)], "a double, c double, b double")
    s = Scaling.fit(df, ["a", "b", "c"], ["a"])
    out = s.transform(df).collect()
    assert [r.a for r in out][0] == 0.0 and [r.a for r in out][2] == 1.0 and [r.c for r in out] == [0.0, 0.0, 0.0] and dict(s.transform(df).dtypes)["a"] == "float"
    back = df.select(s.raw("a", s.scaled("a", F.col("a"))).alias("a"), s.raw("b", s.scaled("b", F.col("b"))).alias("b")).collect()
    assert [r.a for r in back] == pytest.approx([0.0, 10.0, 1e6]) and [r.b for r in back] == pytest.approx([3.0, -100.0, 50.0])
    import json

    assert Scaling.from_dict(json.loads(s.to_json())) == s
    old = {"feature_names": s.names, "minmax_min": s.data_min, "minmax_range": s.data_range, "log1p_indices": [0]}
    assert Scaling.from_dict(old) == s
    wide = spark.createDataFrame([(2e6, 5.0, 60.0)], "a double, c double, b double")
    assert {r.column_name: r.n_outside for r in s.out_of_range(wide).collect()} == {"a": 1, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        Scaling.fit(df.limit(0), ["a"])


def test_class_table_total(spark):
    df = spark.createDataFrame([(0, "x", "train"), (0, "x", "val"), (1, "y", "train")], "code int, name string, split_name string")
    rows = {(r.code, r.name): (r.n_rows, r.n_train, r.n_val) for r in prepare.class_table(df, ["code", "name"], "split_name", ["train", "val"]).collect()}
    assert rows == {(0, "x"): (2, 1, 1), (1, "y"): (1, 1, 0), (None, None): (3, 2, 1)}


@pytest.mark.parametrize("spread", ["even", "heavy", "ties"])
def test_brackets_are_narrowed_until_one_task_can_rank_them(spark, monkeypatch, spread):
    """With a bracket of at most 20 values the sketch is repeated; the quantiles stay exact."""
    from tidegate.operators import order

    monkeypatch.setattr(order, "SMALL", 10)
    monkeypatch.setattr(order, "WIDEST", 20)
    rounds = []
    monkeypatch.setattr(order, "_narrowed", lambda *a, real=order._narrowed: (rounds.append(1), real(*a))[1])
    rng = np.random.default_rng(4)
    x = {"even": rng.random(30_000), "heavy": rng.lognormal(0, 4, 30_000), "ties": rng.integers(0, 5, 30_000).astype(float)}[spread]
    g = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g long, x double")
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = {r.g: r.q for r in order.exact_quantiles(df, ["g"], "x", probs).collect()}
    assert rounds and all(got[i] == pytest.approx(np.quantile(x[g == i], probs)) for i in (0, 1))
    running = order.running_sums(df.groupBy("x").agg(F.count(F.lit(1)).alias("n")), [], "x", {"upto": "n"}).agg(F.max("upto")).first()[0]
    assert running == 30_000
