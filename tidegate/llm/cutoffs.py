"""Score cutoffs that keep a target share of every source's records.

Scores are first reduced to compact frequencies (distinct score, count) per target and source. The cutoff is where
their descending cumulative sum would pass the allowed number. A source may hold any share of all rows and its scores
any part of [0, 1], so the sum never runs over a whole source at once: it descends through the parts of a double, the
power of two (about 1,100), then twice 20 bits of the fraction, each a bounded window, and only then over the
distinct scores of one interval, of which there are at most 2^12.

Defined cases: of several rows of one (target, record) the latest counts, on equal times the one with the greatest
id; null times come first. A score that is null, NaN or outside [0, 1] and a null source are left out. Equal scores
are kept or dropped together. A target that is unknown or has a null share keeps nothing. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

GROUP = ["target_name", "source"]
FINE = 1 << 20  # intervals of a level
MAX_BROADCAST = 200_000  # rows of the cutoff table that are sent to every executor


@dataclass
class Cutoffs:
    """``scores``: the records that count; ``drops``: per target and source the highest score that is not kept
    (null: all are kept); ``report``: cutoffs and sizes."""

    scores: DataFrame
    drops: DataFrame
    report: DataFrame

    def kept(self) -> DataFrame:
        drops = bounded(self.drops.select(*GROUP, "drop_at"), MAX_BROADCAST)
        return self.scores.join(drops, GROUP).where("drop_at is null or score > drop_at").drop("drop_at")


def latest_scores(df: DataFrame) -> DataFrame:
    """One row per (target, record): the latest, by a maximum that is pre-aggregated before the shuffle."""
    newest = F.max(F.struct("scored_at", "score_id", "source", "p_attack")).alias("s")
    score = F.col("s.p_attack")
    return (
        df.groupBy("target_name", "row_id").agg(newest)
        .where(score.between(0.0, 1.0) & ~F.isnan(score) & F.col("s.source").isNotNull())
        .select("target_name", F.col("s.source").alias("source"), F.col("s.score_id").alias("score_id"), (score + 0.0).alias("score"))
    )


def intervals(score: Column) -> dict[str, Column]:
    """b0, b1, b2: power of two of a score and 20 + 20 bits of its fraction; (b0, b1, b2, score) orders like score.

    Only monotony matters: where the logarithm of a score just below a power of two is rounded up, its fraction is
    below 1, and it still stands before the others of that power. Scaling by powers of two is exact."""
    power = F.when(score > 0, F.floor(F.log2(score))).otherwise(F.lit(-(1 << 20)))
    half = F.floor(power / 2)
    two = F.lit(2.0)
    scaled = F.when(score > 0, score * F.pow(two, -half) * F.pow(two, half - power)).otherwise(F.lit(0.0)) * FINE
    return {"b0": power.cast("int"), "b1": F.floor(scaled), "b2": F.floor((scaled - F.floor(scaled)) * FINE)}


def _crossing(freq: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the first row, by descending ``keys[-1]``, at which the running count passes ``may_keep``."""
    order = Window.partitionBy(*GROUP).orderBy(F.col(keys[-1]).desc())
    running = freq.withColumn("_upto", F.col("above") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = running.where("_upto > may_keep and _upto - n <= may_keep")
    return first.withColumn("above", F.col("_upto") - F.col("n")).drop("_upto", "n")


def cutoffs(scores: DataFrame, targets: DataFrame) -> Cutoffs:
    """Cutoffs of every target and source; ``targets`` has ``target_name``, ``keep_ppm`` and ``threshold``."""
    rows = materialize(latest_scores(scores), "scores")
    freq = rows.groupBy(*GROUP, "score").agg(F.count(F.lit(1)).alias("n"))
    freq = freq.withColumns(intervals(F.col("score")))
    freq = materialize(freq, "frequencies")

    plan = targets.where("target_name is not null").select("target_name", "keep_ppm", F.col("threshold").alias("earlier"))
    share = F.greatest(F.lit(0), F.least(F.lit(1_000_000), F.coalesce("keep_ppm", F.lit(0)))).cast("decimal(10,0)")
    sizes = (
        freq.groupBy(*GROUP).agg(F.sum("n").alias("n_records"))
        .join(bounded(plan, MAX_BROADCAST), "target_name")
        .withColumn("may_keep", F.floor(F.col("n_records").cast("decimal(20,0)") * share / 1_000_000).cast("long"))
    )
    sizes = materialize(sizes, "sizes")

    levels = ["b0", "b1", "b2", "score"]
    last = sizes.select(*GROUP, "may_keep", F.lit(0).cast("long").alias("above"))
    for i, level in enumerate(levels):
        counts = freq.groupBy(*GROUP, *levels[: i + 1]).agg(F.sum("n").alias("n"))
        inside = counts.join(last, [*GROUP, *levels[:i]]).select(*GROUP, "may_keep", "above", *levels[: i + 1], "n")
        last = _crossing(inside, [*GROUP, level])
    last = last.select(*GROUP, F.col("score").alias("drop_at"))
    drops = materialize(sizes.join(last, GROUP, "left").select(*sizes.columns, "drop_at"), "cutoffs")

    kept = (
        freq.join(bounded(drops.select(*GROUP, "drop_at"), MAX_BROADCAST), GROUP)
        .where("drop_at is null or score > drop_at")
        .groupBy(*GROUP).agg(F.sum("n").alias("n_kept"), F.min("score").alias("cutoff"))
    )
    report = drops.join(kept, GROUP, "left").select(
        *GROUP, "n_records", "keep_ppm", "earlier", "may_keep", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "cutoff"
    )
    return Cutoffs(rows, drops, report)
