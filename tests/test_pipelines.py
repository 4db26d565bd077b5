import random

import pytest
from pyspark.sql import functions as F

from tidegate.functions.text import column_slug, resolve_columns
from tidegate.operators import report, rules
from tidegate.plans import pipelines

LABELS = [("benigntraffic", "BenignTraffic", 0, 0, "Benign"), ("ddosicmpflood", "DDoS-ICMP_Flood", 1, 1, "DDoS"), ("sqlinjection", "SqlInjection", 2, 1, "Web")]
LABEL_SCHEMA = "slug string, class_name string, code int, is_attack int, category string"


def test_csv_to_splits_to_verdicts(spark, tmp_path):
    rng = random.Random(0)
    lines = ["a,b,flat,iat,tcp,udp,label"]
    for i in range(900):
        name = rng.choice(["BenignTraffic", "benigntraffic", "DDoS-ICMP_Flood", "SqlInjection"])
        a, tcp = rng.expovariate(0.001), i % 2
        lines += [f"{a},{rng.random()},1.0,{rng.random()},{tcp},{1 - tcp},{name}"] * (2 if i % 10 == 0 else 1)
    lines.append("nan,1,1,1,0,1,SqlInjection")
    path = str(tmp_path / "flows.csv")
    open(path, "w").write("\n".join(lines) + "\n")
    labels = spark.createDataFrame(LABELS, LABEL_SCHEMA)
    settings = pipelines.PrepareSettings(drop=["iat"], cap=150, keep_all=[0], min_non_mode_rows=20)
    done = pipelines.prepare(spark, path, labels, str(tmp_path / "out"), settings)
    assert done.features == ["a", "b", "tcp", "udp"] and done.scaling.log1p == []
    counts = {r.code: r["count"] for r in done.splits.groupBy("code").count().collect()}
    assert counts[1] == counts[2] == 150 and counts[0] > 300
    duplicates = {r.code: r.n_duplicates for r in done.report.collect()}
    assert sum(duplicates.values()) == 90
    train, n = done.splits.where("split_name = 'train'").agg(F.min("a"), F.max("a")).first(), done.splits.count()
    assert train[0] == 0.0 and train[1] == 1.0
    assert pipelines.prepare(spark, path, labels, str(tmp_path / "out"), settings).splits.count() == n  # from the cache

    raw = spark.read.parquet(str(tmp_path / "out/selected")).withColumn("split_name", F.when(F.col("row_id") % 3 == 0, "train").when(F.col("row_id") % 3 == 1, "val").otherwise("test"))
    mined, rates = pipelines.validate(raw, done.scaling, [rules.Rule("linear_le", "one", lhs={"tcp": 1.0, "udp": 1.0}, const=1.0)], ["tcp", "udp"], F.col("is_attack") == 0)
    assert [r.name for r in mined.dependencies] == ["one"] and rates.count() == 3
    stages = {"validator": rules.Validator(mined).check_range(), "ensemble": F.col("a") > 2000.0}
    decided, counts, ablation = pipelines.judge(raw, stages)
    assert decided.count() == raw.count() == counts.agg(F.sum("n_rows")).first()[0] and ablation.count() == 9


def test_small_report_helpers(spark):
    old = spark.createDataFrame([("mlp", 0.1), ("cnn", 0.2)], "model string, v double")
    new = spark.createDataFrame([("cnn", 0.9)], "model string, v double")
    assert sorted(map(tuple, report.merge_results(old, new).collect())) == [("cnn", 0.9), ("mlp", 0.1)]
    with pytest.raises(ValueError):
        report.merge_results(old, new.withColumn("w", F.lit(1)))
    top = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.0)], "column_name string, importance double")
    r = report.integrality_overlap(top, ["b", "d"], 3).first()
    assert (r.n_top, r.n_integer) == (3, 1) and r.mass == pytest.approx(0.3)
    assert report.environment(spark)["parallelism"] > 0 and column_slug("Tot sum") == "totsum"
    assert resolve_columns(["tot_sum", "AVG"], ["Tot sum", "avg"]) == ["Tot sum", "avg"] and resolve_columns(["x"], ["y"]) is None
    line = spark.createDataFrame([("mlp", 0.9, 0.8, 0.7, 0.1, 0.2)], "model string, accuracy double, balanced_accuracy double, f1 double, fpr double, fnr double").select(report.format_metrics(F.col("model"))).first()[0]
    assert line.startswith("mlp ") and "acc 0.9000" in line
