"""Report tables over perturbation cells and report lines: groups with totals, pivots, tiers, extremes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.text import slug

# Strategy of each attack name, for the tier table.
TIERS = {"random_walk": "untargeted", "blackbox": "black box", "feat_pgd": "white box", "prim_pgd": "white box", "adaptive_feat": "adaptive", "adaptive_prim": "adaptive"}


def with_totals(rows: DataFrame, groups: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """One aggregation over several grouping sets; ``()`` is the total. Columns of other sets are null."""
    names = sorted({c for g in groups for c in g})
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *(F.col(c) for c in names)).agg(*aggs)


def cell_summary(rows: DataFrame, evade: Column, passes: Column, cost: Column) -> DataFrame:
    """Per ALL, population and category: rows, evasion, validator passes, both, and the median cost of winning rows.

    A row needs ``population`` and ``category``; the group's name is in ``grp``."""
    named = rows.withColumns({"_e": evade, "_p": passes, "_c": cost})
    grp = F.when(F.grouping("category") == 0, F.col("category")).when(F.grouping("population") == 0, F.concat(F.lit("pop:"), F.col("population"))).otherwise(F.lit("ALL"))
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    won = F.col("_e") & F.col("_p")
    out = with_totals(named, [["category"], ["population"], []], [
        F.first(F.lit(1)).alias("_one"), grp.alias("grp"), F.count(F.lit(1)).alias("n"), pct(F.col("_e")).alias("evasion_pct"), pct(F.col("_p")).alias("passes_pct"),
        pct(won).alias("pass_and_evade_pct"), F.median(F.when(won, F.col("_c"))).alias("med_cost"),
    ])
    return out.drop("_one", "category", "population")


def population(category: Column, many: Sequence[str] = ("DDoS", "DoS", "Mirai")) -> Column:
    """Window population: floods are scanned per 100 packets, the rest per 10."""
    return F.when(category.isin(list(many)), "100-pkt").otherwise("10-pkt")


def report_lines(df: DataFrame) -> DataFrame:
    """Each (run, spec, attack, model, group) once, the group as a slug; of repeated lines the greatest values."""
    keys = ["run_id", "spec", "attack", "model"]
    values = [c for c in df.columns if c not in (*keys, "grp")]
    clean = df.where("grp is not null").withColumn("grp", slug(F.col("grp")))
    return clean.groupBy(*keys, "grp").agg(*(F.max(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))).alias(c) for c in values))


def group_pivot(lines: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """attack x model rows, a column per group with the mean of ``value``."""
    return lines.groupBy("attack", "model").pivot("grp", list(groups)).agg(F.avg(value))


def tier_table(lines: DataFrame, value: str) -> DataFrame:
    """Best mean value of any attack of a tier, per spec, over the ALL lines."""
    pairs = [x for a, t in TIERS.items() for x in (F.lit(a), F.lit(t))]
    means = lines.where("grp = 'all'").groupBy("spec", "attack").agg(F.avg(value).alias("v"))
    return means.withColumn("tier", F.coalesce(F.element_at(F.create_map(*pairs), F.col("attack")), F.lit("other"))).groupBy("tier", "spec").agg(F.max("v").alias("best"))


def format_rate(rate: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.2f [%.1f, %.1f]", rate, low, high)


def markdown(df: DataFrame, title: str, meta: dict | None = None, max_rows: int = 10_000) -> str:
    """A small result as a markdown table; a larger one raises."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report has at most {max_rows} rows")
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join([*lines, "", *([f"`{json.dumps(meta, sort_keys=True)}`", ""] if meta else [])])


def format_metrics(name: Column) -> Column:
    """One fixed-width line per row of ``binary_metrics``."""
    return F.format_string("%-16s acc %.4f  bal %.4f  f1 %.4f  fpr %.4f  fnr %.4f", name, *(F.col(c) for c in ("accuracy", "balanced_accuracy", "f1", "fpr", "fnr")))


def environment(spark) -> dict:
    """What a report says about where it was made."""
    context = spark.sparkContext
    return {"spark": context.version, "master": context.master, "parallelism": context.defaultParallelism}


def merge_results(earlier: DataFrame, now: DataFrame, key: str = "model") -> DataFrame:
    """Earlier rows that ``now`` does not replace, and all of ``now``; differing columns raise."""
    if earlier.dtypes != now.dtypes:
        raise ValueError("earlier results have other columns")
    return earlier.join(now.select(key).distinct(), key, "left_anti").select(*now.columns).unionByName(now)


def integrality_overlap(importances: DataFrame, integer_columns: Sequence[str], k: int) -> DataFrame:
    """Of the k most important columns how many hold integers, and their share of the top's importance."""
    top = importances.orderBy(F.col("importance").desc(), "column_name").limit(k)
    whole = F.col("column_name").isin(list(integer_columns)) if integer_columns else F.lit(False)
    return top.agg(F.count(F.lit(1)).alias("n_top"), F.count_if(whole).alias("n_integer"), F.coalesce(F.try_divide(F.sum(F.when(whole, F.col("importance")).otherwise(0.0)), F.sum("importance")), F.lit(0.0)).alias("mass"))


def evaluate_cell(pairs: DataFrame, detects: dict[str, tuple[Column, Column]], rejects: tuple[Column, Column], target: str, x: tuple[Column, Column]) -> DataFrame:
    """The deployed verdict of paired rows: per model and for the validator before and after, evasions, norms.

    ``detects`` maps a model to its answer on the clean and on the perturbed row, ``x`` holds both vectors."""
    from tidegate.functions.numeric import any_of, norms

    out = {f"detected_{m}_{w}": c for m, both in detects.items() for w, c in zip(("clean", "adv"), both)}
    out |= {"rejected_clean": rejects[0], "rejected_adv": rejects[1]}
    out |= {"evades_target": ~detects[target][1], "evades_ensemble": ~any_of([b for _, b in detects.values()])}
    return pairs.withColumns(out | norms(*x))
