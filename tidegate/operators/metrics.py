"""Classification metrics, operating points, ensembles and weights, each as one aggregation per report."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions.numeric import safe_divide
from tidegate.operators.order import running_sums
from tidegate.scratch import materialize
from tidegate.sources.tables import bounded


def binary_metrics(df: DataFrame, y: Column, pred: Column, by: Sequence[str] = (), prob: Column | None = None) -> DataFrame:
    """Confusion counts and the usual rates; a rate without a denominator is 0. Rows with a null y are left out."""
    rows = df.where(y.isNotNull()).select(*by, (y == 1).alias("_y"), F.coalesce(pred == 1, F.lit(False)).alias("_p"), *([prob.alias("_q")] if prob is not None else []))
    t, p = F.col("_y"), F.col("_p")
    aggs = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    if prob is not None:
        q = F.least(F.greatest(F.col("_q"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
        aggs.append(F.avg(-F.when(t, F.log(q)).otherwise(F.log(1.0 - q))).alias("log_loss"))
    c = rows.groupBy(*by).agg(*aggs)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity, precision = safe_divide(tp, tp + fn), safe_divide(tn, tn + fp), safe_divide(tp, tp + fp)
    f1, f0 = safe_divide(2 * tp, 2 * tp + fp + fn), safe_divide(2 * tn, 2 * tn + fn + fp)
    return c.withColumns({
        "n_rows": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
        "accuracy": safe_divide(tp + tn, n), "balanced_accuracy": (recall + specificity) / 2.0, "precision": precision, "recall": recall,
        "f1": f1, "weighted_f1": safe_divide(f1 * (tp + fn) + f0 * (tn + fp), n), "fpr": safe_divide(fp, fp + tn), "fnr": safe_divide(fn, fn + tp),
    })


def recall_by(df: DataFrame, group: str, benign: Column, pred: Column) -> DataFrame:
    """Per group support and the share answered rightly: benign groups want 0, others 1."""
    right = F.when(benign, pred == 0).otherwise(pred == 1)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("support"), F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("correct_rate"))


def success_rate(df: DataFrame, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows predicted benign; 0 for none."""
    return df.groupBy(*by).agg(F.coalesce(F.avg((pred == 0).cast("double")), F.lit(0.0)).alias("success_rate"))


def operating_points(benign: DataFrame, score: str, fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """Per group the (k+1)-th greatest benign score s_k, k = floor(fpr x n): flag rows with p > s_k to stay in budget.

    Found on compact (score, count) frequencies, summed up in blocks. ``flag_above`` is null where k >= n: then every
    row may be flagged."""
    freq = benign.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sums = running_sums(freq, by, "_s", {"_upto": "_n"}, descending=True)
    sizes = freq.groupBy(*(F.col(c).alias(f"_z{i}") for i, c in enumerate(by))).agg(F.sum("_n").alias("n_benign"))
    same = [F.col(c).eqNullSafe(F.col(f"_z{i}")) for i, c in enumerate(by)] or [F.lit(True)]
    k = F.floor(F.col("n_benign") * F.lit(fpr))
    joined = sums.join(bounded(materialize(sizes, "sizes"), 100_000), same)
    return joined.groupBy(*by).agg(F.max("n_benign").alias("n_benign"), F.max(F.when(F.col("_upto") > k, F.col("_s"))).alias("flag_above"))


def bootstrap_ci(df: DataFrame, hit: Column, by: Sequence[str], n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of a boolean mean per group; NaN for an empty group.

    A resample of n booleans is a binomial draw with the observed share, so only (n, hits) per group leave the
    aggregation, whatever the table's size."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_hits"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low, high = [], []
            for n, h in zip(pdf["n_rows"], pdf["n_hits"]):
                means = np.random.default_rng([seed, int(n), int(h)]).binomial(n, h / n, n_boot) / n if n else np.array([math.nan])
                low.append(float(np.quantile(means, alpha / 2)))
                high.append(float(np.quantile(means, 1 - alpha / 2)))
            yield pdf.assign(rate=pdf["n_hits"] / pdf["n_rows"], ci_low=low, ci_high=high)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(draw, f"{types}, rate double, ci_low double, ci_high double")


# -- ensembles --------------------------------------------------------------------------------------------------


def or_ensemble(preds: Sequence[Column]) -> Column:
    if not preds:
        raise ValueError("an ensemble needs at least one member")
    return F.greatest(*preds) if len(preds) > 1 else preds[0]


def or_ensemble_prob(probs: Sequence[Column]) -> Column:
    """(1 - max p, max p)."""
    top = or_ensemble(probs)
    return F.array(1.0 - top, top)


def disagreement(df: DataFrame, members: dict[str, Column], y: Column) -> DataFrame:
    """Per member the rows that it alone flags, split into catches and false alarms, and the unanimous share."""
    flags = {m: F.col(f"_f{i}") for i, m in enumerate(members)}
    rows = df.select(*(c.cast("int").alias(f"_f{i}") for i, c in enumerate(members.values())), y.alias("_y"))
    votes = sum(flags.values(), F.lit(0))
    per = F.array(*(F.struct(F.lit(m).alias("member"), ((votes == 1) & (f == 1)).alias("alone")) for m, f in flags.items()))
    long = rows.select(F.inline(per), F.col("_y"), ((votes == 0) | (votes == len(members))).alias("unanimous"))
    return long.groupBy("member").agg(
        F.count_if("alone").alias("n_alone"), F.count_if(F.col("alone") & (F.col("_y") == 1)).alias("n_catches"),
        F.count_if(F.col("alone") & (F.col("_y") == 0)).alias("n_false_alarms"), F.avg(F.col("unanimous").cast("double")).alias("unanimous_share"),
    )


# -- weights ----------------------------------------------------------------------------------------------------


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (2 n_c) per binary class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("weight", F.sum("n_rows").over(Window.partitionBy(F.lit(0))) / (2.0 * F.col("n_rows")))


def category_weights(df: DataFrame, category: str, power: float = 0.5) -> DataFrame:
    """(N / (K n_k))^power per category, divided by the mean over rows."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n_rows"))
    every = Window.partitionBy(F.lit(0))  # one row per category
    raw = F.pow(F.sum("n_rows").over(every) / (F.count(F.lit(1)).over(every) * F.greatest(F.col("n_rows"), F.lit(1))), F.lit(power))
    counts = counts.withColumn("_w", raw)
    mean = F.sum(F.col("_w") * F.col("n_rows")).over(every) / F.sum("n_rows").over(every)
    return counts.withColumn("weight", F.col("_w") / mean).drop("_w")


# -- perturbation summaries -------------------------------------------------------------------------------------


def perturbation_summary(cells: DataFrame, by: Sequence[str] = ("attack", "model")) -> DataFrame:
    """Per cell: rows, accuracy clean and perturbed, evasion among rows found clean, success, flips, mean and max norms.

    Columns: y, pred_clean, pred_adv, linf, l2, n_changed."""
    y, a, b = F.col("y"), F.col("pred_clean"), F.col("pred_adv")
    found = (y == 1) & (a == 1)
    rate = lambda c: F.avg(c.cast("double"))
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), rate(a == y).alias("acc_clean"), rate(b == y).alias("acc_adv"),
        F.coalesce(F.avg(F.when(found, (b == 0).cast("double"))), F.lit(0.0)).alias("evasion"),
        F.coalesce(F.avg(F.when(y == 1, (b == 0).cast("double"))), F.lit(0.0)).alias("success_rate"), F.count_if(a != b).alias("n_flipped"),
        F.avg("linf").alias("mean_linf"), F.max("linf").alias("max_linf"), F.avg("l2").alias("mean_l2"), F.avg("n_changed").alias("mean_changed"),
    )
