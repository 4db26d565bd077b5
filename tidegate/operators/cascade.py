"""First-stop decision cascade and its ablation.

Stages are named columns, tried in order; the first that stops a row owns it. Expression stages compile to one CASE.
A stage that needs a model outside the JVM is given as a function of a DataFrame and only sees rows that earlier
stages let through.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.numeric import any_of

STAGES = ["validator", "discriminator", "ensemble"]
ALLOWED = "allowed"
Stage = Column | Callable[[DataFrame], DataFrame]


class Cascade:
    """``stages`` in the order they are tried; names outside ``order`` raise, and so does an empty cascade."""

    def __init__(self, stages: dict[str, Stage], order: Sequence[str] = STAGES) -> None:
        if not stages:
            raise ValueError("a cascade needs at least one stage")
        if unknown := set(stages) - set(order):
            raise ValueError(f"unknown stages: {sorted(unknown)}")
        self.stages = {s: stages[s] for s in order if s in stages}

    def decide(self, df: DataFrame) -> DataFrame:
        """Add ``stage`` (the stopping one or 'allowed') and ``stopped``. A null answer lets the row pass."""
        if all(isinstance(s, Column) for s in self.stages.values()):
            return verdict(df, self.stages)
        done, open_rows = None, df
        for name, stage in self.stages.items():
            if isinstance(stage, Column):
                judged = open_rows.withColumn("_stop", F.coalesce(stage, F.lit(False)))
            else:
                judged = stage(open_rows)
                if "_stop" not in judged.columns:
                    raise ValueError(f"stage {name} must add the boolean column _stop")
            stopped = judged.where("_stop").drop("_stop").withColumn("stage", F.lit(name))
            done = stopped if done is None else done.unionByName(stopped)
            open_rows = judged.where("not coalesce(_stop, false)").drop("_stop")
        out = done.unionByName(open_rows.withColumn("stage", F.lit(ALLOWED)))
        return out.withColumn("stopped", F.col("stage") != ALLOWED)


def first_stop(stages: dict[str, Column]) -> Column:
    out = F.lit(ALLOWED)
    for name, stop in reversed(list(stages.items())):
        out = F.when(F.coalesce(stop, F.lit(False)), name).otherwise(out)
    return out


def verdict(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    return df.withColumn("stage", first_stop(stages)).withColumn("stopped", F.col("stage") != ALLOWED)


def stop_rate(decided: DataFrame, *by: str) -> DataFrame:
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("stopped").cast("double")).alias("stop_rate"))


def stage_counts(decided: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Rows per stage and 'allowed', zero-filled, from one aggregation without a shuffle of rows."""
    names = [*stages, ALLOWED]
    counts = decided.agg(*(F.count_if(F.col("stage") == s).alias(s) for s in names))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_rows")) for s in names))))


def subsets(names: Sequence[str], least: int = 1) -> list[tuple[str, ...]]:
    return [c for n in range(least, len(names) + 1) for c in combinations(names, n)]


def ablate(df: DataFrame, stages: dict[str, Column], least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Stop rate of every subset of the stages: one pass, the subsets' answers are columns of the same row."""
    flags = {s: f"_stop_{s}" for s in stages}
    rows = df.select(*by, *(F.coalesce(c, F.lit(False)).alias(flags[s]) for s, c in stages.items()))
    sets = subsets(list(stages), least)
    rates = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.avg(any_of([F.col(flags[s]) for s in c]).cast("double")).alias(f"r{i}") for i, c in enumerate(sets)))
    cells = F.array(*(F.struct(F.lit("+".join(c)).alias("stages"), F.lit(len(c)).alias("n_stages"), F.col(f"r{i}").alias("stop_rate")) for i, c in enumerate(sets)))
    return rates.select(*by, "n_rows", F.inline(cells))


def marginal_contribution(df: DataFrame, stages: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Per stage the stop rate of all stages less that of all others, rounded to six digits."""
    flags = {s: f"_stop_{s}" for s in stages}
    rows = df.select(*by, *(F.coalesce(c, F.lit(False)).alias(flags[s]) for s, c in stages.items()))
    rate = lambda names: F.avg(any_of([F.col(flags[s]) for s in names]).cast("double"))
    rates = rows.groupBy(*by).agg(rate(list(stages)).alias("_all"), *(rate([o for o in stages if o != s]).alias(f"_no_{s}") for s in stages))
    cells = F.array(*(F.struct(F.lit(s).alias("stage"), F.round(F.col("_all") - F.col(f"_no_{s}"), 6).alias("marginal")) for s in stages))
    return rates.select(*by, F.inline(cells))
