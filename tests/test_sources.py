import json

import pytest
from pyspark.sql import functions as F

from tidegate.operators.report import format_rate, markdown, report_lines
from tidegate.sources import cells, csvscan
from tidegate.streaming.gate import run_gate


def test_typed_csv(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    open(path, "w").write("flow_duration, Tot sum ,label\n1.5,2,BenignTraffic\nnan, 3 ,X Y\n")
    assert csvscan.read_header(spark, path) == ["flow_duration", "Tot sum", "label"]
    df = csvscan.read_flows(spark, path, expected=["flow_duration", "Tot sum", "label"])
    assert df.dtypes == [("flow_duration", "double"), ("Tot sum", "double"), ("label", "string")]
    assert [str(r[0]) for r in df.collect()] == ["1.5", "nan"]
    assert csvscan.read_flows(spark, path, drop=["Tot sum"]).columns == ["flow_duration", "label"]
    for bad in ({"drop": ["nope"]}, {"label": "nope"}, {"expected": ["a"]}):
        with pytest.raises(ValueError):
            csvscan.read_flows(spark, path, **bad)
    open(path, "a").write("oops,1,z\n")
    with pytest.raises(Exception):
        csvscan.read_flows(spark, path).collect()


def test_cache_follows_the_fingerprint(spark, tmp_path):
    path, built = str(tmp_path / "table"), []

    def build():
        built.append(1)
        return spark.range(5)

    key = csvscan.fingerprint({"name": "x", "bytes": 3}, {"cap": 5})
    for k in (key, key, csvscan.fingerprint({"name": "x", "bytes": 3}, {"cap": 6})):
        assert csvscan.cached(spark, path, k, build).count() == 5
    assert len(built) == 2 and json.loads(csvscan.read_text(spark, path + ".json"))["key"] != key
    assert csvscan.source_size(spark, path)["bytes"] > 0


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame([(0.5, "train"), (1.0, "test")], "a double, split_name string")
    csvscan.write_splits(df, str(tmp_path / "s"), ["a"])
    assert spark.read.parquet(str(tmp_path / "s")).where("split_name = 'train'").count() == 1
    with pytest.raises(ValueError):
        csvscan.write_splits(df.withColumn("a", F.col("a") * 2), str(tmp_path / "t"), ["a"])


def test_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = spark.createDataFrame([(i, [0.5], [0.55]) for i in range(4)], "source_id long, x_clean array<double>, x_adv array<double>")
    assert cells.save_cell(rows, path, "fgsm", "mlp", eps=0.1) and not cells.save_cell(rows, path, "fgsm", "mlp") and cells.save_cell(rows, path, "bim", "mlp")
    assert cells.load_cells(spark, path, ["bim"]).count() == 4 and cells.load_cells(spark, path).count() == 8
    for bad in ({"eps": 0.01}, {}):
        with pytest.raises(ValueError):
            cells.save_cell(rows if bad else rows.withColumn("x_adv", F.array(F.lit(1.5))), path, "pgd", "mlp", **bad)
    assert cells.save_cell(rows.limit(3), path, "pgd", "cnn")
    with pytest.raises(ValueError):
        cells.load_cells(spark, path)
    cells.check_manifest(spark, str(tmp_path / "m"), rows, "source_id")
    cells.check_manifest(spark, str(tmp_path / "m"), rows, "source_id")
    with pytest.raises(ValueError):
        cells.check_manifest(spark, str(tmp_path / "m"), rows.limit(2), "source_id")


def test_stream_gate(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).repartition(5).write.parquet(src)
    out = run_gate(spark, src, lambda s: s.select("id", (F.col("id") % 2 == 0).alias("even")), files_per_trigger=2)
    assert out.count() == 100 and out.where("even").count() == 50


def test_reports(spark):
    df = spark.createDataFrame([(1, "A", "x", "m", "ALL", 1.0), (1, "A", "x", "m", " all", 2.0), (1, "A", "x", "m", None, 9.0), (2, "A", "x", "m", "ALL", float("nan"))], "run_id long, spec string, attack string, model string, grp string, v double")
    assert sorted((r.run_id, r.grp, r.v) for r in report_lines(df).collect()) == [(1, "all", 2.0), (2, "all", None)]
    text = markdown(df.select("grp", "v").limit(2), "T", {"a": 1})
    assert text.startswith("# T\n\n| grp | v |\n| --- | --- |\n") and '`{"a": 1}`' in text
    with pytest.raises(ValueError):
        markdown(spark.range(5), "T", max_rows=4)
    assert df.limit(1).select(format_rate(F.lit(1.234), F.lit(0.0), F.lit(2.0))).first()[0] == "1.23 [0.0, 2.0]"
