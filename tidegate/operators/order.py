"""Order statistics and running sums of groups of any size: exact, and never one group in one task.

A sketch (bounded, merged map-side) brackets what is looked for; a bracket that still holds more than ``WIDEST`` values
is sketched again, as often as that takes; one more pass counts what lies below a bracket and gathers the few values
inside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.functions.numeric import finite
from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

ACCURACY = 2_000
MARGIN = 4.0 / ACCURACY  # ranks that a bracket reaches beyond its quantile on either side
SMALL = 10_000  # a group of up to so many values is ranked whole
WIDEST = 2_000_000  # values that one task ranks
GRID = 1_000  # quantiles of a bracket's next sketch
BLOCKS, MOST_BLOCKS = 64, 8_192  # powers of two
MAX_BROADCAST = 100_000


def _on(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)] or [F.lit(True)]


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, probs: Sequence[float], few_groups: bool = False) -> DataFrame:
    """(by, n_values, q): interpolated quantiles of the finite values per group, as ``percentile`` gives them.

    A first bracket holds about 0.4 % of a group's values (equal ones counted as one; all of a small group), a further
    one 0.5 % of those, until no more than ``WIDEST`` are left, which is what one task ranks; all else is counted
    map-side. ``few_groups`` says that the number of groups follows from the schema
    (columns, rules): the brackets then go to every executor without being counted first. Groups without a finite
    value are absent."""
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(g) for c, g in zip(by, names)), F.col(x).cast("double").alias("_x")).where(finite(F.col("_x")))
    ends = [(max(0.0, p - MARGIN), min(1.0, p + MARGIN)) for p in probs]
    k = len(probs)
    sketch = materialize(rows.groupBy(*names).agg(
        F.percentile_approx("_x", [a for a, _ in ends] + [b for _, b in ends], ACCURACY).alias("_ends"),
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
    ), "sketch")
    keys = [f"_k{i}" for i in range(len(by))]
    small = F.col("_n") <= SMALL  # ranks next to each other may leave a bracket of few values
    low = [F.col("_min") if a == 0.0 else F.when(small, F.col("_min")).otherwise(F.col("_ends")[i]) for i, (a, _) in enumerate(ends)]
    high = [F.col("_max") if b == 1.0 else F.when(small, F.col("_max")).otherwise(F.col("_ends")[k + i]) for i, (_, b) in enumerate(ends)]
    sides = [v.alias(f"_{side}{i}") for side, vs in (("lo", low), ("hi", high)) for i, v in enumerate(vs)]
    brackets = sketch.select(*(F.col(g).alias(c) for g, c in zip(names, keys)), *sides, "_n", small.alias("_small"))
    held = (sketch.agg(F.max("_n")).first()[0] or 0) * 2 * MARGIN
    while held > WIDEST:
        brackets, before = _narrowed(rows, brackets, names, keys, probs), held
        held = brackets.agg(F.max("_held")).first()[0]
        brackets = brackets.drop("_held")
        if held >= before:
            break  # one value makes up the rest
    joined = rows.join(F.broadcast(brackets) if few_groups else bounded(brackets, MAX_BROADCAST), _on(names, keys)).drop(*keys)
    x = F.col("_x")
    # Counted below each bracket by one aggregation; only what lies inside one goes on, from a small group once for
    # all quantiles (-1), from a large one per bracket.
    below = joined.groupBy(*names).agg(F.max("_n").alias("n_values"), *(F.count_if(x < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(k)))
    inside = [(x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")) for i in range(k)]
    near = joined.where(reduce(lambda p, q: p | q, inside))
    hits = F.array_compact(F.array(*(F.when(c, i) for i, c in enumerate(inside))))
    sent = near.select(*names, x.alias("_v"), F.explode(F.when(F.col("_small"), F.array(F.lit(-1))).otherwise(hits)).alias("_i"))
    counts = sent.groupBy(*names, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    base = below.select(*(F.col(g).alias(c) for g, c in zip(names, keys)), "n_values", *(f"_below{i}" for i in range(k)))
    ranked = counts.withColumn("_upto", upto).join(F.broadcast(base) if few_groups else bounded(base, MAX_BROADCAST), _on(names, keys)).drop(*keys)
    place = [F.lit(float(p)) * (F.col("n_values") - 1) for p in probs]

    def at(i: int, rank: Column) -> Column:
        return F.min(F.when(F.col("_i").isin(-1, i) & (F.col(f"_below{i}") + F.col("_upto") > rank), F.col("_v")))

    found = ranked.groupBy(*names, "n_values").agg(*(at(i, F.floor(h)).alias(f"_a{i}") for i, h in enumerate(place)), *(at(i, F.ceil(h)).alias(f"_b{i}") for i, h in enumerate(place)))
    q = F.array(*(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (h - F.floor(h)) for i, h in enumerate(place)))
    return found.select(*(F.col(g).alias(c) for g, c in zip(names, by)), "n_values", q.alias("q"))


def _narrowed(rows: DataFrame, brackets: DataFrame, names: Sequence[str], keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The brackets sketched again: each becomes the few steps of its own grid around the rank looked for. ``_held``:
    about how many values the widest holds."""
    k, x = len(probs), F.col("_x")
    joined = rows.join(bounded(brackets, MAX_BROADCAST), _on(names, keys)).drop(*keys).where(~F.col("_small"))
    marks = F.array(*(F.struct(F.lit(i).alias("i"), (x < F.col(f"_lo{i}")).alias("under"), ((x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}"))).alias("inside")) for i in range(k)))
    near = joined.select(*names, "_x", "_n", F.explode(F.filter(marks, lambda m: m.under | m.inside)).alias("_m"))
    own = near.groupBy(*names, F.col("_m.i").alias("_i")).agg(
        F.max("_n").alias("_n"), F.count_if("_m.under").alias("_under"), F.count_if("_m.inside").alias("_in"),
        F.percentile_approx(F.when(F.col("_m.inside"), x), [j / GRID for j in range(GRID + 1)], ACCURACY).alias("_grid"),
    )
    p = F.element_at(F.array(*(F.lit(float(v)) for v in probs)), F.col("_i") + 1)
    rank = p * (F.col("_n") - 1) - F.col("_under")  # of the value looked for, inside the bracket
    step = lambda r: r / F.col("_in") * GRID
    at = lambda j: F.element_at("_grid", F.least(F.greatest(j, F.lit(0)), F.lit(GRID)).cast("int") + 1)
    own = own.withColumn("_a", at(F.floor(step(rank - 1)) - 2)).withColumn("_b", at(F.ceil(step(rank + 2)) + 2)).withColumn("_held", F.col("_in") * 6 / GRID)
    pick = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c)))
    wide = own.groupBy(*names).agg(*(pick(c, i).alias(f"_{n}{i}") for i in range(k) for n, c in (("na", "_a"), ("nb", "_b"))), F.max("_held").alias("_held"))
    wide = wide.withColumnsRenamed({n: f"_w{i}" for i, n in enumerate(names)})
    out = brackets.join(wide, _on(keys, [f"_w{i}" for i in range(len(names))]), "left")
    sides = [F.coalesce(f"_n{s}{i}", f"_{n}{i}").alias(f"_{n}{i}") for n, s in (("lo", "a"), ("hi", "b")) for i in range(k)]
    return materialize(out.select(*keys, *sides, "_n", "_small", F.coalesce("_held", F.lit(0.0)).alias("_held")), "brackets")


def running_sums(df: DataFrame, by: Sequence[str], order: str, values: dict[str, str], descending: bool = False, few_groups: bool = False) -> DataFrame:
    """Add, for each of ``values`` (new name -> summed column), the running sum by ``order`` within the groups.

    ``order`` must be unique in a group (aggregate first). Groups are cut into blocks at sketched quantiles, 64 or, from
    64 times ``WIDEST`` rows on, as many more as keep a block at that size (up to 8,192); the blocks' totals are summed
    up across blocks and the rows' sums within a block. The input is read three times
    and therefore written first. ``few_groups``: see ``exact_quantiles``."""
    small = F.broadcast if few_groups else lambda d: bounded(d, MAX_BROADCAST)
    df = materialize(df, "running")
    blocks = min(MOST_BLOCKS, max(BLOCKS, 1 << max(0, df.count() // WIDEST).bit_length()))
    names = [f"_g{i}" for i in range(len(by))]
    keyed = df.withColumns({g: F.col(c) for c, g in zip(by, names)})
    cuts = keyed.groupBy(*names).agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], max(1000, 10 * blocks)).alias("_cuts"))
    keys = [f"_k{i}" for i in range(len(by))]
    cuts = materialize(cuts.select(*(F.col(g).alias(k) for g, k in zip(names, keys)), "_cuts"), "cuts")
    rows = keyed.join(small(cuts), _on(names, keys)).drop(*keys)
    # Binary search for the number of cuts below the value.
    steps = F.array(*(F.lit(blocks >> s) for s in range(1, blocks.bit_length())))
    step = lambda i, s: i + F.when(F.get("_cuts", i + s - 1) < F.col(order), s).otherwise(0)
    rows = rows.withColumn("_block", F.aggregate(steps, F.lit(0), step)).drop("_cuts")
    way = F.col("_block").desc() if descending else F.col("_block").asc()
    totals = rows.groupBy(*names, "_block").agg(*(F.sum(v).alias(f"_t_{n}") for n, v in values.items()))
    before = Window.partitionBy(*names).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*(F.col(g).alias(k) for g, k in zip(names, keys)), F.col("_block").alias("_kb"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values))
    rows = rows.join(small(materialize(offset, "offsets")), [*_on(names, keys), F.col("_block") == F.col("_kb")])
    down = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*names, "_block").orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.col(f"_o_{n}") + F.sum(v).over(inside) for n, v in values.items()})
    return out.select(*df.columns, *values)
