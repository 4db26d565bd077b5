"""The three main flows end to end, as functions of paths and settings.

``prepare``: raw CSV to scaled splits. ``validate``: scaled splits' raw rows to rules and a report. ``judge``: rows to
cascade verdicts with ablation. Fits read training rows, calibration validation rows, reports test rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.operators import cascade, prepare as cleaning, rules, sample, scan
from tidegate.operators.scaling import Scaling
from tidegate.sources import csvscan


@dataclass
class PrepareSettings:
    label: str = "label"
    drop: Sequence[str] = ()
    cap: int = 60_000
    keep_all: Sequence[int] = ()
    seed: int = 42
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "val": 0.15, "test": 0.15})
    min_non_mode_rows: int = 100
    log1p: Sequence[str] | str = "auto"


@dataclass
class Prepared:
    splits: DataFrame
    features: list[str]
    scaling: Scaling
    report: DataFrame


def prepare(spark: SparkSession, csv: str, labels: DataFrame, out: str, settings: PrepareSettings | None = None, rebuild: bool = False) -> Prepared:
    """CSV, labels -> duplicates out, capped per class, split, near-constant columns out, log1p, min-max, Parquet.

    The selected rows are cached under ``out/selected`` by a fingerprint of the source and of all settings that decide
    them. A row's id is the hash of its content, so that another split of the files draws the same sample; of rows
    equal at model precision the one with the smallest id stays."""
    s = settings or PrepareSettings()
    raw = csvscan.read_flows(spark, csv, s.label, s.drop)
    columns = [c for c in raw.columns if c != s.label]
    content = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in raw.columns))
    coded = scan.with_codes(raw, s.label, labels).withColumn("row_id", content)
    key = csvscan.fingerprint(csvscan.source_size(spark, csv), {"cap": s.cap, "keep_all": list(s.keep_all), "seed": s.seed, "drop": list(s.drop), "labels": sorted(map(tuple, labels.select("slug", "code").collect()))})

    def select() -> DataFrame:
        # Grouping keeps the first row's own doubles; only the comparison is at model precision.
        wide = coded.where(~scan.is_bad(columns)).withColumns({f"_k{i}": c for i, c in enumerate(scan.float32(columns))})
        first = wide.groupBy(*(f"_k{i}" for i in range(len(columns))), "code").agg(F.min_by(F.struct(*columns, "class_name", "is_attack", "category"), "row_id").alias("r"), F.min("row_id").alias("row_id"))
        rows = first.select("row_id", "code", "r.*")
        return sample.capped(rows, "code", "row_id", s.cap, s.keep_all, s.seed)

    selected = csvscan.cached(spark, f"{out}/selected", key, select, rebuild)
    split = sample.stratified_split(selected, "code", "row_id", s.shares, s.seed)
    train = split.where(F.col("split_name") == "train")
    gone = cleaning.near_constant_columns(train, columns, 0.0, s.min_non_mode_rows)
    features = [c for c in columns if c not in gone]
    logs = cleaning.resolve_log1p(cleaning.tail_stats(train, features), s.log1p)
    scaling = Scaling.fit(train, features, logs)
    csvscan.write_splits(scaling.transform(split.drop(*gone)), f"{out}/splits", features)
    csvscan.write_json(spark, f"{out}/scaling.json", scaling.to_json())
    csvscan.write_json(spark, f"{out}/columns.json", {"features": features, "dropped": gone, "log1p": logs})
    report = scan.duplicate_report(coded, columns, "code", "row_id")
    return Prepared(spark.read.parquet(f"{out}/splits"), features, scaling, report)


def validate(rows: DataFrame, scaling: Scaling, candidates: Sequence[rules.Rule], indicators: Sequence[str], trusted: Column, budget: float = 0.01) -> tuple[rules.RuleSet, DataFrame]:
    """Mine on trusted training rows, calibrate on trusted validation rows, report on test rows by ``category``."""
    part = lambda name: rows.where(trusted & (F.col("split_name") == name))
    mined = rules.mine(part("train"), scaling, candidates, indicators)
    mined = rules.calibrate_distribution(mined, part("val"), budget, part("train"))
    checked = rules.Validator(mined).check(rows.where(F.col("split_name") == "test"))
    return mined, rules.family_rates(checked, "category")


def judge(rows: DataFrame, stages: dict[str, Column], by: Sequence[str] = ("category",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdict per row, rows per stage, and the ablation over all subsets."""
    decided = cascade.Cascade(stages).decide(rows)
    counts = decided.groupBy(*by, "stage").agg(F.count(F.lit(1)).alias("n_rows"))
    return decided, counts, cascade.ablate(rows, {s: stages[s] for s in cascade.STAGES if s in stages}, by=list(by))
