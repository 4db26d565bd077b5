"""Connected components of records that share keys, by alternating star contractions.

Nothing is gathered per key or per component: each round is made of minima (pre-aggregated before the shuffle) and
equi-joins whose hot keys the adaptive join can split. Rounds grow with the logarithm of a component's diameter.
Every round is written to the shared folder, so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.scratch import discard, materialize


def edges_by_keys(memberships: DataFrame) -> DataFrame:
    """(u, v), u > v: every record to the smallest record of each key it has; ``memberships`` is (kind, key, id)."""
    roots = memberships.groupBy("kind", "key").agg(F.min("id").alias("v"), F.max("id").alias("_top")).where("v < _top")
    return memberships.join(roots, ["kind", "key"]).where("id > v").select(F.col("id").alias("u"), "v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root): for every record that is not the smallest of its component, that smallest one."""
    state, before = materialize(edges, "edges"), None
    for _ in range(max_rounds):
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
        grown = materialize(_small_star(_large_star(state)), "edges")
        discard(state)
        state, before = grown, mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
