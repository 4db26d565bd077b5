"""Data sets for a perturbation discriminator and for retraining: unions with provenance, without leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegate.operators.sample import ranked


def check_cells_aligned(cells: DataFrame, source_col: str, by: Sequence[str] = ("attack", "model")) -> None:
    """Raise unless every cell holds the same source rows; compared by order-free sums of hashes, not by lists."""
    marks = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(source_col).cast("decimal(38,0)")).alias("h"), F.count_distinct(source_col).alias("d"))
    if marks.select("n", "h", "d").distinct().limit(2).count() > 1:
        raise ValueError("cells are made from different source rows")


def discriminator_dataset(cells: DataFrame, pool: DataFrame, extra: int | str = "auto", stratify: bool = True, seed: int = 42) -> DataFrame:
    """Positives of all cells, their clean twins once, and extra negatives from a pool that excludes the sources.

    ``cells``: source_id, attack, model, x_adv, x_clean; ``pool``: source_id, x, y. Result: x, y, group_key, attack,
    model, origin. 'auto' asks for as many negatives as positives; stratified draws keep the pool's label shares,
    capped by what a label has."""
    positives = cells.select(F.col("x_adv").alias("x"), F.lit(1).alias("y"), F.col("source_id").alias("group_key"), F.lower("attack").alias("attack"), F.lower("model").alias("model"), F.lit("adv").alias("origin"))
    twins = cells.groupBy("source_id").agg(F.first("x_clean").alias("x"))
    twins = twins.select("x", F.lit(0).alias("y"), F.col("source_id").alias("group_key"), F.lit("none").alias("attack"), F.lit("none").alias("model"), F.lit("twin").alias("origin"))
    rest = pool.join(cells.select("source_id").distinct(), "source_id", "left_anti")
    if extra == "auto":
        sizes = cells.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("s")).first()
        extra = max(0, sizes.n - sizes.s)
    if stratify:
        whole = max(1, rest.count())
        quota = F.least("n_stratum", F.rint(F.lit(float(extra)) * F.col("n_stratum") / F.lit(float(whole))))
        drawn = ranked(rest, ["y"], "source_id", quota, seed)
    else:
        drawn = ranked(rest, [], "source_id", F.lit(extra), seed)
    negatives = drawn.select("x", F.lit(0).alias("y"), F.col("source_id").alias("group_key"), F.lit("none").alias("attack"), F.lit("none").alias("model"), F.lit("pool").alias("origin"))
    return positives.unionByName(twins).unionByName(negatives)


def attacks(dataset: DataFrame) -> list[str]:
    return [r[0] for r in dataset.where("y = 1").select("attack").distinct().orderBy("attack").collect()]


def models(dataset: DataFrame) -> list[str]:
    return [r[0] for r in dataset.where("y = 1").select("model").distinct().orderBy("model").collect()]


def catch_by(dataset: DataFrame, field: str, pred: str = "pred") -> DataFrame:
    """Per value of ``field`` the positives and the share of them flagged."""
    return dataset.where("y = 1").groupBy(field).agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.col(pred) == 1).cast("double")).alias("catch_rate"))


def select_pool(cells: DataFrame, model: str, holdout: Sequence[str] = (), sources: str = "all") -> DataFrame:
    """Cells whose attack is not held out (case does not matter), of all models or of ``model`` only."""
    if sources not in ("all", "own"):
        raise ValueError(f"sources must be 'all' or 'own', not {sources!r}")
    kept = cells.where(~F.lower("attack").isin([h.lower() for h in holdout])) if holdout else cells
    return kept if sources == "all" else kept.where(F.lower("model") == model.lower())


def augmented(clean: DataFrame, pool: DataFrame, share: float, id_col: str, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Clean training rows and share x (clean rows) perturbed ones, drawn evenly from the pool's cells, labelled 1.

    Both sides have ``id_col``, x and y; the result has ``origin`` and the pool's attack and model (null for clean), and
    the columns in ``keep``, which both sides have. The draw is by id, so x may be perturbed after it."""
    cells = max(1, pool.select("attack", "model").distinct().count())
    quota = F.least("n_stratum", F.floor(F.lit(share * clean.count() / cells)))
    drawn = ranked(pool, ["attack", "model"], id_col, quota, seed).select(id_col, "x", F.lit(1).alias("y"), "attack", "model", F.lit("adv").alias("origin"), *keep)
    none = F.lit(None).cast("string")
    return clean.select(id_col, "x", F.col("y").cast("int").alias("y"), none.alias("attack"), none.alias("model"), F.lit("clean").alias("origin"), *keep).unionByName(drawn)


def unseen(rows: DataFrame, seen: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id a model was not trained on."""
    return rows.join(seen.select(id_col).distinct(), id_col, "left_anti")
