"""What the queries share: the labelled flow table, a declared rule catalogue, fitted parameters, declared scorers.

Each has a twin in SQL, written independently of the columns, from which the queries' SQL is put together.
"""

from __future__ import annotations

import math
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.functions.numeric import all_finite
from tidegate.operators.rules import Rule, RuleSet, calibrate_distribution, mine
from tidegate.operators.scaling import Scaling
from tidegate.operators.scorers import Linear
from tidegate.schema import FEATURES
from tidegate.scratch import remember, shared_folder
from tidegate.sources.csvscan import exists, fingerprint, read_text, source_state, write_text
from tidegate.sources.tables import bounded, read_table

# Columns under signed log1p, indicator columns of protocol groups, and the rule candidates.
LOG1P = ["flow_duration", "header_length", "rate", "srate", "rst_count", "tot_sum", "pkt_max", "pkt_std", "variance"]
INDICATORS = ["tcp", "udp", "icmp"]
CANDIDATES = [
    Rule("ordering", "pkt_min <= pkt_avg <= pkt_max", ["pkt_min", "pkt_avg", "pkt_max"]),
    Rule("equal", "srate == rate", ["srate", "rate"]),
    Rule("linear_le", "http implies tcp", lhs={"http": 1.0}, rhs={"tcp": 1.0}),
    Rule("linear_le", "syn implies tcp", lhs={"syn_flag_number": 1.0}, rhs={"tcp": 1.0}),
    Rule("linear_le", "ack implies tcp", lhs={"ack_flag_number": 1.0}, rhs={"tcp": 1.0}),
    Rule("linear_le", "tcp + udp + icmp <= 1", lhs={"tcp": 1.0, "udp": 1.0, "icmp": 1.0}, const=1.0),
    Rule("linear_le", "6 tcp + 17 udp + icmp <= protocol_type", lhs={"tcp": 6.0, "udp": 17.0, "icmp": 1.0}, rhs={"protocol_type": 1.0}),
    Rule("product", "tot_sum ~= tot_size * pkt_avg", ["tot_sum", "tot_size", "pkt_avg"]),
]
MEMBERS = ["mlp", "cnn", "lstm"]
SAMPLE = 20_000  # labelled rows that a model is fitted on


def flows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Finite, labelled rows: row_id, split_name, class_name, code, y (attack), category, the features, ``more``."""
    known = bounded(read_table(spark, d, "label_map").select("class_name", "code", F.col("is_attack").cast("int").alias("y"), "category"), 1_000_000)
    raw = read_table(spark, d, "flow_scan").where(all_finite(FEATURES)).select("row_id", "split_name", F.col("codes").cast("int").alias("codes"), *FEATURES, *more)
    return raw.join(known, raw["codes"] == known["code"]).drop("codes")


FINITE_SQL = " AND ".join(f"{c} IS NOT NULL AND isfinite({c})" for c in FEATURES)
FLOWS_SQL = f"""flows AS (SELECT f.*, m.class_name, m.code, m.is_attack AS y, m.category
  FROM flow_scan f JOIN label_map m ON f.codes = m.code WHERE {FINITE_SQL})"""

# -- scaling ----------------------------------------------------------------------------------------------------


def scaling(train: DataFrame) -> Scaling:
    return Scaling.fit(train, FEATURES, LOG1P)


def log_sql(c: str) -> str:
    return f"sign({c}) * ln(1 + abs({c}))" if c.split(".")[-1] in LOG1P else c


PARAMS_SQL = "params AS (SELECT " + ", ".join(f"min({log_sql(c)}) AS lo_{c}, max({log_sql(c)}) - min({log_sql(c)}) AS span_{c}" for c in FEATURES) + " FROM flows WHERE split_name = 'train')"
SCALED_SQL = "scaled AS (SELECT row_id, split_name, class_name, code, y, category, [" + ", ".join(
    f"least(greatest(CASE WHEN span_{c} = 0 THEN 0 ELSE ({log_sql(c)} - lo_{c}) / span_{c} END, 0.0), 1.0)" for c in FEATURES
) + "] AS x FROM flows, params)"

# -- scorers ----------------------------------------------------------------------------------------------------


def member(name: str, threshold: float = 0.5) -> Linear:
    """Declared logistic scorer of a member; weights follow from a rule, not from data."""
    m = MEMBERS.index(name) + 1
    return Linear(name, [round(3 * math.sin(m * (j + 1)), 3) for j in range(len(FEATURES))], round(math.cos(m), 3), threshold)


def logit_sql(name: str, x: str = "x") -> str:
    s = member(name)
    return "(0.0" + "".join(f" + {x}[{j + 1}] * ({w})" for j, w in enumerate(s.weights)) + f" + ({s.bias}))"


def prob_sql(name: str, x: str = "x") -> str:
    return f"(1.0 / (1.0 + exp(-{logit_sql(name, x)})))"


def scored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Flows with the scaled vector ``x`` and each member's probability ``p_<member>``."""
    rows = flows(spark, d, *more)
    s = scaling(rows.where("split_name = 'train'"))
    out = rows.select("row_id", "split_name", "class_name", "code", "y", "category", *more, s.vector().alias("x"))
    return out.withColumns({f"p_{m}": member(m).prob(F.col("x")) for m in MEMBERS})


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scaled vectors ``x`` of training and of test rows."""
    rows = flows(spark, d)
    s = scaling(rows.where("split_name = 'train'"))
    made = rows.select("row_id", "split_name", "category", "y", s.vector().alias("x"))
    return made.where("split_name = 'train'"), made.where("split_name = 'test'")


SCORED_SQL = "scored AS (SELECT *, " + ", ".join(f"{prob_sql(m)} AS p_{m}" for m in MEMBERS) + " FROM scaled)"
SCORE_SQL = f"{FLOWS_SQL}, {PARAMS_SQL}, {SCALED_SQL}, {SCORED_SQL}"

# -- rules ------------------------------------------------------------------------------------------------------


def trusted(rows: DataFrame, split: str) -> DataFrame:
    return rows.where((F.col("y") == 0) & (F.col("split_name") == split))


def mined(rows: DataFrame) -> RuleSet:
    """``mine_all`` once per content of the tables behind ``rows``: the rules are stored as JSON in the shared folder,
    under a key of the files' folders, sizes and times and of what is mined."""
    spark = rows.sparkSession
    folders = sorted({f if f.endswith(".parquet") else f.rpartition("/")[0] for f in rows.inputFiles()})
    key = fingerprint({f: source_state(spark, f) for f in folders}, {"rules": [asdict(r) for r in CANDIDATES], "log1p": LOG1P, "groups": INDICATORS, "columns": FEATURES})
    path = f"{shared_folder(spark)}/tidegate-rules-{key}.json"
    if exists(spark, path):
        return RuleSet.from_json(read_text(spark, path))
    rules = mine_all(rows)
    write_text(spark, path, rules.to_json())
    remember(spark, path)
    return rules


def mine_all(rows: DataFrame) -> RuleSet:
    """Rules of benign training rows, thresholds from benign validation rows (training rows for small groups)."""
    train, val = trusted(rows, "train"), trusted(rows, "val")
    rules = mine(train, scaling(rows.where("split_name = 'train'")), CANDIDATES, INDICATORS)
    return calibrate_distribution(rules, val, 0.01, train)


def residual_sql(r: Rule) -> str:
    if r.kind == "ordering":
        lo, mid, hi = r.columns
        return f"greatest({lo} - {mid}, {mid} - {hi}, 0.0) / (abs({hi}) + 1)"
    if r.kind == "equal":
        return f"abs({r.columns[0]} - {r.columns[1]}) / (abs({r.columns[1]}) + 1)"
    if r.kind == "product":
        a, b, c = r.columns
        return f"abs({a} - {b} * {c}) / (abs({b} * {c}) + 1)"
    left = " + ".join(f"{c} * {k}" for c, k in r.lhs.items())
    bound = " + ".join([*(f"{c} * {k}" for c, k in r.rhs.items()), str(r.const)])
    return f"greatest({left} - ({bound}), 0.0) / (abs({bound}) + 1)"


GROUP_SQL = "CASE WHEN greatest(tcp, udp, icmp) < 0.5 THEN 'other' WHEN tcp >= greatest(udp, icmp) THEN 'tcp' WHEN udp >= icmp THEN 'udp' ELSE 'icmp' END"
_QUOTED = {r.name: r.name.replace("'", "''") for r in CANDIDATES}
RESIDUALS_SQL = "[" + ", ".join(f"{{'rule': '{_QUOTED[r.name]}', 'r': {residual_sql(r)}}}" for r in CANDIDATES) + "]"
TOL_SQL = f"""residuals AS (SELECT unnest({RESIDUALS_SQL}, recursive := true) FROM flows WHERE y = 0 AND split_name = 'train'),
  tolerances AS (SELECT rule, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.99) AS p99, quantile_cont(r, 0.999) AS p999, max(r) AS max,
    avg((r > 0)::INT) AS share_positive, greatest(10 * quantile_cont(r, 0.999), 1e-6) AS tolerance FROM residuals GROUP BY rule)"""


def unpivot_sql(source: str, keys: str, where: str = "true") -> str:
    """(keys, column_name, x) of every feature."""
    cells = "[" + ", ".join(f"{{'column_name': '{c}', 'x': {c}}}" for c in FEATURES) + "]"
    return f"SELECT {keys + ', ' if keys else ''}unnest({cells}, recursive := true) FROM {source} WHERE {where}"


PROFILE_SQL = f"""cells AS (SELECT *, CASE WHEN split_name = 'train' AND y = 0 THEN 'train' WHEN split_name = 'val' AND y = 0 THEN 'val' ELSE 'rest' END AS part
    FROM ({unpivot_sql('(SELECT *, ' + GROUP_SQL + ' AS grp FROM flows)', 'row_id, y, split_name, category, grp')})),
  centre AS (SELECT grp, column_name, median(x) AS med, max(x) - min(x) AS span, count(*) AS n FROM cells WHERE part = 'train' GROUP BY grp, column_name
    UNION ALL SELECT NULL, column_name, median(x), max(x) - min(x), count(*) FROM cells WHERE part = 'train' GROUP BY column_name),
  spread AS (SELECT k.grp, k.column_name, median(abs(c.x - k.med)) AS dev FROM centre k JOIN cells c ON c.part = 'train' AND c.column_name = k.column_name
    AND (k.grp IS NULL OR k.grp = c.grp) GROUP BY k.grp, k.column_name),
  fitted AS (SELECT k.grp, k.column_name, k.n, k.med, greatest(1.4826 * s.dev, 1e-3 * greatest(k.span, 1e-9)) AS mad
    FROM centre k JOIN spread s ON k.column_name = s.column_name AND k.grp IS NOT DISTINCT FROM s.grp),
  profiles AS (SELECT g.grp, a.column_name, coalesce(o.n, 0) AS n_rows, coalesce(o.n, 0) >= 100 AS own,
      CASE WHEN coalesce(o.n, 0) >= 100 THEN o.med ELSE a.med END AS med, CASE WHEN coalesce(o.n, 0) >= 100 THEN o.mad ELSE a.mad END AS mad
    FROM (SELECT unnest(['tcp', 'udp', 'icmp', 'other']) AS grp) g JOIN fitted a ON a.grp IS NULL LEFT JOIN fitted o ON o.grp = g.grp AND o.column_name = a.column_name),
  scores AS (SELECT c.row_id, any_value(c.y) AS y, any_value(c.category) AS category, any_value(c.split_name) AS split_name, any_value(c.part) AS part, any_value(c.grp) AS grp,
      avg(least(abs(c.x - p.med) / p.mad, 50)) AS score FROM cells c JOIN profiles p ON c.grp = p.grp AND c.column_name = p.column_name GROUP BY c.row_id),
  thresholds AS (SELECT g.grp, CASE WHEN count(*) FILTER (WHERE s.part = 'val') >= 200 THEN 'val' WHEN count(s.score) >= 100 THEN 'train+val' ELSE 'global' END AS source,
      CASE WHEN count(*) FILTER (WHERE s.part = 'val') >= 200 THEN quantile_cont(s.score, 0.99) FILTER (WHERE s.part = 'val')
           WHEN count(s.score) >= 100 THEN quantile_cont(s.score, 0.99)
           ELSE (SELECT quantile_cont(score, 0.99) FROM scores WHERE part = 'val') END AS threshold
    FROM (SELECT unnest(['tcp', 'udp', 'icmp', 'other']) AS grp) g LEFT JOIN scores s ON s.grp = g.grp AND s.part IN ('train', 'val') GROUP BY g.grp)"""

_TRAIN = "FROM flows WHERE y = 0 AND split_name = 'train'"
_EDGE = "edge AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES) + f" {_TRAIN})"
_RANGE = " OR ".join(f"{c} < lo_{c} - 0.01 * greatest(hi_{c} - lo_{c}, 1e-9) OR {c} > hi_{c} + 0.01 * greatest(hi_{c} - lo_{c}, 1e-9)" for c in FEATURES)
_LINEAR = [c for c in FEATURES if c not in LOG1P]
WHOLE_SQL = "whole AS (SELECT " + ", ".join(f"greatest(1e-6, 1e-6 * span_{c}) AS tol_{c}, max(abs(t.{c} - round_even(t.{c}, 0))) AS off_{c}" for c in _LINEAR) + " FROM (SELECT * " + _TRAIN + ") t, params GROUP BY ALL)"
_INTEGRAL = " OR ".join(f"(off_{c} <= tol_{c} AND tol_{c} < 0.25 AND abs({c} - round_even({c}, 0)) > tol_{c})" for c in _LINEAR)
_DEPEND = " OR ".join(f"((SELECT tolerance FROM tolerances WHERE rule = '{_QUOTED[r.name]}') <= 0.05 AND {residual_sql(r)} > (SELECT tolerance FROM tolerances WHERE rule = '{_QUOTED[r.name]}'))" for r in CANDIDATES)
CHECKED_SQL = f"""{FLOWS_SQL}, {PARAMS_SQL}, {TOL_SQL}, {PROFILE_SQL}, {_EDGE}, {WHOLE_SQL},
  checked AS (SELECT f.row_id, f.y, f.category, f.split_name, s.grp, ({_RANGE}) AS rej_range, ({_INTEGRAL}) AS rej_integrality, ({_DEPEND}) AS rej_dependency,
      s.score > t.threshold AS rej_distribution, s.score, t.threshold
    FROM flows f JOIN scores s ON f.row_id = s.row_id JOIN thresholds t ON s.grp = t.grp, edge, whole),
  judged AS (SELECT *, rej_range OR rej_integrality OR rej_dependency OR rej_distribution AS reject,
      rej_range::INT + rej_integrality::INT + rej_dependency::INT + rej_distribution::INT AS fired FROM checked)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same value; -0 becomes 0."""
    return df.select(*((F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
