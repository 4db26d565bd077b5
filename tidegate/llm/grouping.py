"""Train, validation and test splits that keep related records together.

Records tied by a shared key, directly or through others, form a component (``components``). Components are balanced
into many equal bins by largest differencing, bins are given whole to the splits by target proportion.

The balance is made per stratum (a component's most frequent combination of the spread columns), so that every bin
gets its share of each, and per shard of a stratum, which bounds what one task sees. Within a shard equal weights are
dealt to the bins in whole rounds; only the remainders (fewer than one round per weight) are differenced: the two
partitions of greatest spread are combined, fullest bin with emptiest, until one is left. The shards' partitions are
then combined the same way, as a tree: ``FAN`` of one stratum at a time, then ``FAN`` strata at a time, until one
partition is left. A task of the tree sees ``FAN`` x bins numbers, whatever the number of shards and strata.

Defined cases: a null key, or for text keys one that expresses absence, ties nothing; keys are compared without case
and surrounding blanks; a record without ties is a component of its own; repeated ids are one record; null spread
values count as a value; an empty table gives empty results. A component larger than a bin is never cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegate.llm.components import components, edges_by_keys
from tidegate.scratch import materialize

# Ways to write that a session is not known (lower case).
ABSENT = ["", "unknown", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "missing", "undefined", "not available", "-", "--", "?"]
FAN = 128  # partitions that one task of the tree combines, on average
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u202f\u3000"


def text_key(value: Column) -> Column:
    """A text key without case and surrounding blanks; null where it expresses absence."""
    plain = F.lower(F.btrim(value, F.lit(BLANKS)))
    return F.when(~plain.isin(ABSENT), plain)


def ties(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(kind, key, id): the keys each record has, absent ones left out."""
    have = [F.struct(F.lit(i).alias("kind"), k.cast("string").alias("key")) for i, k in enumerate(keys.values())]
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(*have)).alias("k")).where("k.key is not null").select("k.kind", "k.key", "id")


def tied_records(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(id, root) of every record that is not the smallest of its component."""
    return components(edges_by_keys(ties(df.where(F.col(id_col).isNotNull()), id_col, keys)))


# -- largest differencing ---------------------------------------------------------------------------------------


def difference(weights: Sequence[float], bins: int) -> np.ndarray:
    """Bin of each weight by the largest differencing method with ``bins`` bins."""
    return combine([{0: float(w)} for w in weights], bins)[:, 0] if len(weights) else np.zeros(0, dtype=int)


def combine(parts: list[dict[int, float]], bins: int) -> np.ndarray:
    """Combine partitions (bin -> weight) into one; ``[i, b]`` is the bin that part i's bin b ends in."""
    heap = []
    for i, part in enumerate(parts):
        sums = np.zeros(bins)
        for b, w in part.items():
            sums[b] = w
        order = np.argsort(-sums, kind="stable")
        heap.append((-(sums.max() - sums.min()), i, sums[order], [[(i, int(b))] for b in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, members = heapq.heappop(heap)
        _, j, b, others = heapq.heappop(heap)
        sums = a + b[::-1]
        joined = []
        for x, y in zip(members, reversed(others)):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            joined.append(x)
        order = np.argsort(-sums, kind="stable")
        heapq.heappush(heap, (-(sums.max() - sums.min()), min(i, j), sums[order], [joined[k] for k in order]))
    to = np.zeros((len(parts), bins), dtype=int)
    for at, members in enumerate(heap[0][3] if heap else []):
        for i, b in members:
            to[i, b] = at
    return to


def allocate(bin_weights: Sequence[float], shares: Sequence[float]) -> list[int]:
    """Split of each bin: fullest first, each to the split that lacks most of its share."""
    left = np.array(shares, dtype=float) * sum(bin_weights)
    out = [0] * len(bin_weights)
    for b in np.argsort(-np.array(bin_weights, dtype=float), kind="stable"):
        s = int(left.argmax())
        out[b], left[s] = s, left[s] - bin_weights[b]
    return out


NODE = ["stratum", "shard"]


def _merge(nodes: DataFrame, sums: DataFrame, place: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """One level of the tree. ``nodes`` adds ``parent_stratum`` and ``parent_shard`` to each node; ``sums`` is (node,
    bin, weight), ``place`` (leaf, node, bin). Returns both for the parents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(key, dict(zip(g["bin"], g["weight"].astype(float)))) for key, g in pdf.groupby(NODE, sort=True)]
        moves = combine([p for _, p in parts], bins)
        return pd.DataFrame([(*key, b, int(moves[i, b])) for i, (key, _) in enumerate(parts) for b in range(bins)], columns=[*NODE, "bin", "to"])

    parents = ["parent_stratum", "parent_shard"]
    moved = sums.join(nodes, NODE).groupBy(*parents).applyInPandas(run, "stratum string, shard long, bin long, to long")
    moved = materialize(moved.join(nodes, NODE), "moves")
    new = {"parent_stratum": "stratum", "parent_shard": "shard", "to": "bin"}
    step = [*NODE, "bin"]
    sums = moved.join(sums, step).groupBy(*parents, "to").agg(F.sum("weight").alias("weight")).withColumnsRenamed(new)
    place = place.join(moved, step).drop(*step).withColumnsRenamed(new)
    return materialize(sums, "sums"), materialize(place, "places")


def _tree(sums: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """(weights of the final bins, final bin of every leaf's bin: leaf_stratum, leaf_shard, leaf_bin, bin)."""
    leaf = {"stratum": "leaf_stratum", "shard": "leaf_shard", "bin": "leaf_bin"}
    place = sums.select("stratum", "shard", "bin", *(F.col(c).alias(n) for c, n in leaf.items()))
    while True:
        shards, strata = sums.agg(F.max("shard") + 1, F.count_distinct("stratum")).first()
        if not strata or (shards == 1 and strata == 1):
            return sums, place.select(*leaf.values(), "bin")
        nodes = sums.select(*NODE).distinct()
        if shards > 1:
            up = F.col("stratum"), F.pmod(F.xxhash64(F.lit(shards), "shard"), F.lit(-(-shards // FAN)))
        else:
            up = F.concat(F.lit("#"), F.pmod(F.xxhash64(F.lit(strata), "stratum"), F.lit(-(-strata // FAN))).cast("string")), F.lit(0).cast("long")
        sums, place = _merge(nodes.withColumns(dict(zip(("parent_stratum", "parent_shard"), up))), sums, place, bins)


def assign_splits(
    df: DataFrame,
    id_col: str,
    keys: dict[str, Column],
    spread: dict[str, Column],
    splits: dict[str, float],
    bins: int = 20,
    shard_components: int = 200_000,
) -> DataFrame:
    """(record_id, root_id, split_name), one row per distinct id.

    Shares of the bins must be able to express the splits' proportions (20 bins for 70/15/15)."""
    base = df.where(F.col(id_col).isNotNull())
    combo = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in spread.values()))
    records = base.select(F.col(id_col).alias("record_id"), combo.alias("combo")).groupBy("record_id").agg(F.min("combo").alias("combo"))
    roots = tied_records(base, id_col, keys).select(F.col("id").alias("record_id"), F.col("root").alias("root_id"))
    records = records.join(roots, "record_id", "left").withColumn("root_id", F.coalesce("root_id", "record_id"))
    records = materialize(records, "records")

    comps = records.groupBy("root_id", "combo").agg(F.count(F.lit(1)).alias("n"))
    comps = comps.groupBy("root_id").agg(F.sum("n").alias("weight"), F.max(F.struct("n", "combo")).alias("top"))
    comps = materialize(comps.select("root_id", "weight", F.col("top.combo").alias("stratum")), "components")
    shards = max(1, -(-comps.count() // shard_components))

    same = Window.partitionBy(*NODE, "weight")
    dealt = (
        comps.withColumn("shard", F.pmod(F.xxhash64("root_id"), F.lit(shards)))
        .withColumn("at", F.row_number().over(same.orderBy(F.xxhash64(F.lit(1), "root_id"), "root_id")) - 1)
        .withColumn("rounds", F.floor(F.count(F.lit(1)).over(same) / bins))
        .withColumn("bin", F.when(F.col("at") < F.col("rounds") * bins, F.col("at") % bins).cast("long"))
        .select("root_id", *NODE, "weight", "bin")
    )
    dealt = materialize(dealt, "dealt")

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "root_id"], ascending=[False, True], kind="stable")
        return pdf.assign(bin=difference(pdf["weight"].tolist(), bins).astype("int64"))

    rest = dealt.where("bin is null").groupBy(*NODE).applyInPandas(balance, dealt.schema)
    placed = materialize(dealt.where("bin is not null").unionByName(rest), "placed")
    sums = materialize(placed.groupBy(*NODE, "bin").agg(F.sum("weight").alias("weight")), "sums")
    final, where = _tree(sums, bins)

    weights = {r.bin: r.weight for r in final.groupBy("bin").agg(F.sum("weight").alias("weight")).collect()}  # one row per bin
    names, order = list(splits), sorted(weights)
    chosen = allocate([weights[b] for b in order], list(splits.values()))
    split = F.element_at(F.create_map(*(F.lit(v) for b, s in zip(order, chosen) for v in (b, names[s]))), F.col("bin")) if order else F.lit(None).cast("string")
    leaf = where.select(F.col("leaf_stratum").alias("stratum"), F.col("leaf_shard").alias("shard"), F.col("leaf_bin").alias("bin"), split.alias("split_name"))
    roots = placed.join(leaf, [*NODE, "bin"]).select("root_id", "split_name")
    return records.join(roots, "root_id").select("record_id", "root_id", "split_name")
