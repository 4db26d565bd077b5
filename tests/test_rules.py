"""A trusted population with planted invariants, one violation per family, and the soft twin."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import rules as R
from tidegate.operators.scaling import Scaling
from tidegate.operators.search import ArrayValidator

X = ["flow_duration", "rate", "srate", "http", "tcp", "udp", "icmp", "lo", "mid", "hi", "number", "tot"]
CANDIDATES = [
    R.Rule("ordering", "lo <= mid <= hi", ["lo", "mid", "hi"]), R.Rule("equal", "srate == rate", ["srate", "rate"]), R.Rule("linear_le", "http implies tcp", lhs={"http": 1.0}, rhs={"tcp": 1.0}),
    R.Rule("linear_le", "one transport", lhs={"tcp": 1.0, "udp": 1.0, "icmp": 1.0}, const=1.0), R.Rule("product", "tot ~ number * mid", ["tot", "number", "mid"]), R.Rule("equal", "not there", ["lo", "nope"]),
]


def population(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.choices(["tcp", "udp", "icmp", "other"], [60, 35.5, 0.5, 4])[0]
        shift = {"tcp": 0, "udp": 50, "icmp": 20, "other": 90}[kind]
        lo = rng.uniform(40, 60) + shift
        mid, rate, tcp = lo + rng.uniform(0, 20), rng.uniform(1, 1000), float(kind == "tcp")
        rows.append((i, rng.expovariate(0.01), rate, rate, float(tcp and rng.random() < 0.4), tcp, float(kind == "udp"), float(kind == "icmp"), lo, mid, mid + rng.uniform(0, 30), float(rng.randrange(2, 20)), rng.uniform(100, 5000)))
    return rows


SCHEMA = "row_id long, " + ", ".join(f"{c} double" for c in X)


@pytest.fixture(scope="module")
def setup(spark):
    train = spark.createDataFrame(population(3000, 0), SCHEMA)
    val = spark.createDataFrame(population(2000, 1), SCHEMA)
    rules = R.mine(train, Scaling.fit(train, X, ["flow_duration"]), CANDIDATES, ["tcp", "udp", "icmp"])
    return train, val, R.calibrate_distribution(rules, val, 0.01, train)


def test_mined_rules(setup):
    _, _, rules = setup
    assert rules.pruned == ["tot ~ number * mid"] and [r.name for r in rules.dependencies] == ["lo <= mid <= hi", "srate == rate", "http implies tcp", "one transport"]
    assert set(rules.integral) == {"http", "tcp", "udp", "icmp", "number"}
    assert rules.groups["tcp"]["own"] and rules.groups["udp"]["own"] and not rules.groups["icmp"]["own"]
    assert rules.groups["icmp"]["median"] != rules.groups["tcp"]["median"] and rules.threshold_source["tcp"] == "val"
    assert rules.threshold_source["other"] in ("train+val", "val") and rules.threshold_source["icmp"] == "global"
    assert R.RuleSet.from_json(rules.to_json()) == rules


def test_budget_on_unseen_rows(spark, setup):
    _, _, rules = setup
    rate = R.Validator(rules).check(spark.createDataFrame(population(3000, 2), SCHEMA)).agg(F.avg(F.col("reject").cast("double")), F.avg(F.col("rej_distribution").cast("double"))).first()
    assert rate[0] < 0.03 and 0.002 < rate[1] < 0.025


BASE = dict(flow_duration=100.0, rate=500.0, srate=500.0, http=0.0, tcp=1.0, udp=0.0, icmp=0.0, lo=50.0, mid=60.0, hi=75.0, number=9.0, tot=2000.0)
CASES = {
    "clean": ({}, set()), "fractional flag": ({"http": 0.5}, {"integrality"}), "http without tcp": ({"http": 1.0, "tcp": 0.0, "udp": 1.0, "lo": 100.0, "mid": 110.0, "hi": 125.0}, {"dependency"}),
    "two transports": ({"udp": 1.0}, {"dependency"}), "order broken": ({"mid": 49.0}, {"dependency"}), "rates differ": ({"srate": 700.0}, {"dependency"}), "out of range": ({"tot": 9e6}, {"range"}),
    "nan passes comparisons": ({"tot": float("nan")}, set()),
}


@pytest.mark.parametrize("case", CASES)
def test_one_violation_each(spark, setup, case):
    change, fired = CASES[case]
    row = R.Validator(setup[2]).check(spark.createDataFrame([(1, *({**BASE, **change}[c] for c in X))], SCHEMA)).first()
    got = {f for f in R.FAMILIES if row[f"rej_{f}"]}
    assert got - {"distribution"} == fired and row.reject == bool(got)


def test_unknown_kind_and_family(spark, setup):
    with pytest.raises(ValueError):
        R.residual(R.Rule("rate", "x", ["lo"]))
    with pytest.raises(ValueError):
        R.Validator(setup[2]).check(setup[0], ["nope"])


def test_soft_is_zero_where_hard_passes(spark, setup):
    _, val, rules = setup
    soft = R.SoftValidator(rules)
    noisy = val.unionByName(val.withColumns({"srate": F.col("srate") * 1.5, "tot": F.col("tot") * 3}))
    judged = soft.check(noisy)
    p = soft.penalties(F.col("grp"))
    rows = judged.select(*(f"rej_{f}" for f in R.FAMILIES), *(v.alias(k) for k, v in p.items()), soft.total({"range": 2.0}, F.col("grp")).alias("total")).collect()
    for r in rows:
        assert all((r[f] > 1e-12) == r[f"rej_{f}"] for f in ("range", "dependency", "distribution"))
        assert r.total == pytest.approx(2 * r["range"] + r.integrality + r.dependency + r.distribution)


def test_array_validator_agrees(setup):
    _, val, rules = setup
    noisy = val.unionByName(val.withColumns({"mid": F.col("mid") + 15, "number": F.col("number") + 0.3}))
    rows = R.Validator(rules).check(noisy).select("reject", "grp", *X).collect()
    raw = {c: np.array([r[c] for r in rows]) for c in X}
    twin = ArrayValidator(rules)
    assert list(twin.rejects(raw)) == [r.reject for r in rows] and list(twin.groups(raw)) == [r.grp for r in rows]


def test_rates(spark):
    flags = [(True, False, False, False), (True, True, False, False), (False, False, False, False), (False, False, False, True)]
    df = spark.createDataFrame([(*f, any(f)) for f in flags], ", ".join(f"rej_{f} boolean" for f in R.FAMILIES) + ", reject boolean")
    assert [round(v) for v in R.sole_family_rates(df).first()] == [25, 0, 0, 25]
    assert [round(v) for v in R.family_rates(df).first()] == [4, 75, 50, 25, 0, 25]


def test_group_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4, 0.2), (0.0, 1.0), (float("nan"), 0.0)], "a double, b double")
    assert [r[0] for r in df.select(R.protocol_group(["a", "b"])).collect()] == ["a", "other", "b", "other"]
