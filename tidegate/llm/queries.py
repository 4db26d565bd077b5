"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import cutoffs as c2, grouping as g4, leakage as l7, lookalike as a8, overlap as o3, packing as k6, quotas as q5
from tidegate.schema import FEATURES
from tidegate.sources.tables import bounded, read_table

SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}


# 2: cutoffs -----------------------------------------------------------------------------------------------------


def _cutoffs(spark: SparkSession, d: str) -> c2.Cutoffs:
    return c2.cutoffs(read_table(spark, d, "target_scores"), read_table(spark, d, "targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d).kept().select("score_id")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d).report.select("target_name", "source", "n_records", "keep_ppm", "may_keep", "n_kept", "cutoff")


# 3: overlaps ----------------------------------------------------------------------------------------------------


def _overlap(spark: SparkSession, d: str, *carry: str) -> o3.Overlap:
    return o3.cross_split_overlap(read_table(spark, d, "flow_scan"), "row_id", "split_name", FEATURES, carry=carry)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pair = F.col("train_id"), F.col("eval_id")
    return _overlap(spark, d).pairs().select(F.least(*pair).alias("row_a"), F.greatest(*pair).alias("row_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with feat_hash and codes of both rows."""
    return _overlap(spark, d, "feat_hash", "codes").pairs("feat_hash", "codes")


def p3_overlap(spark: SparkSession, d: str) -> DataFrame:
    return o3.overlap_report(_overlap(spark, d, "split_name", "device"), "split_name", "device")


# 4: splits ------------------------------------------------------------------------------------------------------


def _keys() -> dict:
    return {"group_key": F.col("group_key"), "clean_hash": F.col("clean_hash"), "capture_id": g4.text_key(F.col("capture_id"))}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tied = g4.tied_records(read_table(spark, d, "adv_rows"), "record_id", _keys())
    return tied.select(F.col("root").alias("root_id"), F.col("id").alias("record_id"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    spread = {"attack": F.lower(F.trim("attack")), "model": F.lower(F.trim("model"))}
    return g4.assign_splits(read_table(spark, d, "adv_rows"), "record_id", _keys(), spread, SPLITS)


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Records per split, attack and model, and their share of the attack and model."""
    rows = read_table(spark, d, "adv_rows").select("record_id", F.lower(F.trim("attack")).alias("attack"), F.lower(F.trim("model")).alias("model"))
    counts = rows.join(p4_split(spark, d), "record_id").groupBy("split_name", "attack", "model").agg(F.count(F.lit(1)).alias("n_records"))
    totals = counts.groupBy("attack", "model").agg(F.sum("n_records").alias("n_all"))
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.attack").eqNullSafe(F.col("t.attack")) & F.col("c.model").eqNullSafe(F.col("t.model")))
    return joined.select("split_name", "c.attack", "c.model", "n_records", (F.col("n_records") / F.col("n_all")).alias("share"))


def p4_properties(spark: SparkSession, d: str) -> DataFrame:
    """What the assignment must keep, as numbers: every record in one split, no component cut, shares met."""
    spread = F.lower(F.trim("attack")).alias("attack"), F.lower(F.trim("model")).alias("model")
    rows = read_table(spark, d, "adv_rows").select("record_id", *spread).dropDuplicates(["record_id"])
    given = g4.materialize(rows.join(p4_split(spark, d), "record_id", "left"), "given")
    cut = given.groupBy("root_id").agg(F.count_distinct("split_name").alias("n")).where("n > 1")
    n, target = F.count(F.lit(1)), F.element_at(F.create_map(*(F.lit(v) for kv in SPLITS.items() for v in kv)), F.col("split_name"))
    off = lambda *by: given.groupBy(*by).agg(*(F.count_if(F.col("split_name") == s).alias(s) for s in SPLITS), n.alias("n"))
    worst = lambda df: df.select(F.greatest(*(F.abs(F.col(s) / F.col("n") - w) for s, w in SPLITS.items())).alias("off"))
    parts = {
        "records": given.agg(n.alias("value")),
        "records without a known split": given.where(target.isNull()).agg(n.alias("value")),
        "components in two splits": cut.agg(n.alias("value")),
        "splits off by more than one percent": worst(off()).agg(F.count_if(F.col("off") > 0.01).alias("value")),
        "large attack and model pairs off by more than five percent": worst(off("attack", "model").where("n >= 200")).agg(F.count_if(F.col("off") > 0.05).alias("value")),
    }
    out = [df.select(F.lit(name).alias("property"), "value") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


# 5: samples -----------------------------------------------------------------------------------------------------


def _populations(spark: SparkSession, d: str) -> DataFrame:
    finite = F.lit(True)
    for f in FEATURES:
        finite = finite & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != F.lit(float("inf")))
    labels = bounded(read_table(spark, d, "label_map").groupBy("code").agg(F.min("category").alias("category")), 100_000)
    flows = read_table(spark, d, "flow_scan").where(finite).select("file_path", "row_no", "row_id", "split_name", "codes")
    flows = flows.join(labels, flows["codes"] == labels["code"])
    flows = q5.population(flows, "flow_scan", [F.col("file_path"), F.col("row_no")], F.col("row_id"), F.col("category"), F.col("split_name"))
    report = read_table(spark, d, "realizable_report").where("grp is not null").withColumn("_slug", q5.slug(F.col("grp")))
    line = [F.col(c) for c in ("run_id", "spec", "attack", "model", "_slug")]
    # A report line has no id of its own: its key, written out, serves as one.
    report = q5.population(report, "realizable_report", line, F.xxhash64(*line), F.col("grp"), F.col("model"))
    return flows.unionByName(report)


def p5_quotas(spark: SparkSession, d: str) -> DataFrame:
    return q5.quotas(q5.availability(_populations(spark, d)), read_table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return q5.unmet(p5_quotas(spark, d)).select("plan_id", "grp_slug")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = q5.materialize(_populations(spark, d), "population")
    quota = q5.quotas(q5.availability(rows), read_table(spark, d, "sample_targets"))
    return q5.draw(rows, quota)


def p5_margins(spark: SparkSession, d: str) -> DataFrame:
    """Per plan and group: rows asked for and there, and whether the quotas' sum is the target rounded down or up, at
    least the minimum, as far as there are rows."""
    quota = p5_quotas(spark, d)
    line = ["plan_id", "grp_slug", "grp", "min_rows", "needed", "available"]
    per = quota.groupBy(*line, "target").agg(F.sum("quota").alias("quota"))
    low = F.greatest("min_rows", F.floor(F.col("target") + 1e-9))
    kept = F.col("quota").between(F.least(low, "available"), F.least("needed", "available"))
    return per.select("plan_id", "grp_slug", "needed", "available", kept.alias("kept"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn per plan, all different."""
    drawn = p5_sample(spark, d)
    return drawn.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("population", "id").alias("n_different"))


# 6: containers --------------------------------------------------------------------------------------------------


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return k6.pack(read_table(spark, d, "documents"), read_table(spark, d, "pack_bins"), k6.byte_tokens(F.col("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut = p6_assignment(spark, d).where("pieces > 1")
    return cut.groupBy("bin_kind", "doc_id").agg(F.count(F.lit(1)).alias("n")).select("bin_kind", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers per kind, tokens in them and the share of capacity used."""
    fill = k6.fills(p6_assignment(spark, d))
    return fill.groupBy("bin_kind").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity")).alias("fill")
    )


def p6_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: documents and tokens in containers, none of them too full, only too long documents cut, and whether
    99 in 100 tokens of the capacity are used."""
    placed = k6.materialize(p6_assignment(spark, d), "placed")
    docs = placed.groupBy("bin_kind", "doc_id").agg(F.sum("size").alias("tokens"), F.max("pieces").alias("pieces"), F.first("capacity").alias("capacity"), F.count(F.lit(1)).alias("n"))
    whole = (F.col("pieces") == F.ceil(F.col("tokens") / F.col("capacity"))) & (F.col("n") == F.col("pieces"))
    per = docs.groupBy("bin_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("tokens"), F.count_if(~whole).alias("n_wrongly_cut"))
    fill = k6.fills(placed).groupBy(F.col("bin_kind").alias("k")).agg(
        F.count_if(F.col("unused") < 0).alias("n_too_full"), ((F.sum("used") / F.sum("capacity")) >= 0.99).alias("filled")
    )
    return per.join(fill, per["bin_kind"] == fill["k"]).drop("k")


# 7: leaks -------------------------------------------------------------------------------------------------------


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return l7.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("in_order").select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: documents that hold them in order, and most words of the passage in one of them."""
    held = p7_leaks(spark, d).where("in_order")
    return held.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("n_words"))


def p7_stages(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that tiles cover enough, by whether they keep the order too, and how much of the passage is covered."""
    found = p7_leaks(spark, d)
    return found.groupBy("in_order").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("covered").alias("least_covered"), F.avg("coverage").alias("coverage"))


# 8: look-alikes -------------------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return a8.look_alike_pairs(read_table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return a8.canonical_texts(read_table(spark, d, "documents"))
