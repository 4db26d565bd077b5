"""Typed loading of delimited records with a stated reason for every record that cannot be loaded.

The parse is the cheapest one in a space of edits: quotes and delimiters may be inserted or deleted, a quote edit
outweighing any number of delimiter edits. Most records cost nothing, and whether one does is decided by built-in
expressions: cut at its quotes, the pieces outside quotes must begin and end with a delimiter where they touch a
quoted piece. Only the others reach the dynamic program, whose edit operations state the reason:

* a quote edit         -> ``quoting``
* delimiter edits only -> ``column_count``
* no edit              -> the fields are checked by type: ``nan``, ``inf`` or ``invalid``, one row per failing field

Defined cases: a null record counts as an empty one (one empty field); records that repeat are judged one by one;
an empty table gives empty results; columns of the input other than the id and the record are carried to the loaded
rows under ``in_<name>`` where they would clash with a field's name. A field of digits loads as decimal(38,0); where
it has more digits they stand, whole, in ``<field>_digits``, which is null otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.text import slug
from tidegate.sources.tables import bounded

# Words for a missing value and for an infinite one (lower case; an optional sign is allowed).
NAN_WORDS = ["nan", "na", "n/a", "n.a.", "null", "none", "nil", "missing"]
INF_WORDS = ["inf", "infinity", "infinite", "∞"]
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u2009\u200a\u202f\u3000"
NUMBER = r"\A[+-]?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?\z"
MAX_DIGITS = 38
FAULTS = "array<struct<reason:string,column_name:string,edits:string>>"


@dataclass(frozen=True)
class RecordFormat:
    """Fields of a record in order; ``kinds`` maps a field to its check (others are free text)."""

    fields: list[str]
    kinds: dict[str, str] = field(default_factory=dict)  # feature | digits | time | label
    label_rows: int = 1_000_000  # up to so many known labels are sent to every executor


@dataclass
class ParsedRecords:
    """``judged``: the input with its ``_values`` and ``_faults`` (reason, column_name, edits), from one pass."""

    judged: DataFrame
    fmt: RecordFormat
    id_col: str
    line_col: str

    @property
    def failures(self) -> DataFrame:
        """(id, reason, column_name, edits), one row per record and failure."""
        # Outer, since for the inner form the optimiser parses the records once more to filter those without faults.
        return self.judged.select(self.id_col, F.inline_outer("_faults")).where("reason is not null")

    @property
    def loaded(self) -> DataFrame:
        """Typed rows of the records without a failure, with the input's other columns."""
        fields = {}
        for i, f in enumerate(self.fmt.fields):
            value = F.col("_values")[i]
            fields[f] = _typed(self.fmt.kinds.get(f), value)
            if self.fmt.kinds.get(f) == "digits":
                fields[f"{f}_digits"] = F.when(F.length(F.ltrim(value, F.lit("0"))) > MAX_DIGITS, value)
        lower = {f.lower() for f in fields}
        other = [c for c in self.judged.columns if c not in (self.line_col, "_values", "_faults")]
        kept = [F.col(f"`{c}`").alias(f"in_{c}" if c.lower() in lower else c) for c in other]
        return self.judged.where(F.size("_faults") == 0).select(*kept, *(v.alias(f) for f, v in fields.items()))


def split_quotes(line: Column) -> Column:
    return F.split(line, '"', -1)


def quoting_holds(line: Column) -> Column:
    """True where the record's quoting needs no edit."""
    pieces = split_quotes(line)
    last = F.size(pieces) - 1

    def fits(piece: Column, i: Column) -> Column:
        opens = (i == 0) | piece.startswith(",")
        closes = (i == last) | piece.endswith(",")
        return (i % 2 == 1) | (piece == "") | (opens & closes)

    return ~line.contains('"') | ((last % 2 == 0) & F.forall(F.transform(pieces, lambda p, i: fits(p, i)), lambda ok: ok))


def outside_delimiters(line: Column) -> Column:
    """Number of delimiters outside quotes, for a record whose quoting holds."""
    outside = F.when(
        line.contains('"'), F.array_join(F.filter(split_quotes(line), lambda p, i: i % 2 == 0), "")
    ).otherwise(line)
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit("")))


def field_values(line: Column) -> Column:
    """The fields of a record whose quoting holds, enclosing quotes removed and doubled ones halved.

    Delimiters outside quotes become U+0001; that character and U+0002 are escaped first, so any text survives.
    """
    r = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    pieces = split_quotes(r(r(line, "\x02", "\x02b"), "\x01", "\x02a"))
    last = F.size(pieces) - 1
    marked = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 1, p)
        .when((p == "") & (i > 0) & (i < last), F.lit('"'))
        .otherwise(F.replace(p, F.lit(","), F.lit("\x01"))),
    )
    quoted = F.transform(
        F.split(F.array_join(marked, ""), "\x01", -1), lambda v: r(r(v, "\x02a", "\x01"), "\x02b", "\x02")
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


# -- the dynamic program ---------------------------------------------------------------------------------------

# A cost is a pair compared in order: quote edits, then delimiter edits * _D + inserted quotes. A line has fewer than
# 2^31 characters, so neither part overflows.
_D = np.int64(1) << 32
_NEVER = np.int64(1) << 61
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
_TOKEN = re.compile(r'[^",]+|,|"')
Cost = tuple[np.ndarray, np.ndarray]


def edit_costs(lines: list[str], n_fields: int) -> np.ndarray:
    """Least edits that make each line a record of ``n_fields``: columns quote inserts, quote deletes, delimiter
    inserts, delimiter deletes.

    State: position in a field (at its start, in plain text, in quotes, after a closing quote) x delimiters counted.
    A run of ordinary characters is one token. A deleted delimiter joins the two fields' values; inserting one is
    charged at the record's end, since its place changes no other cost. A line without quotes has one path only.
    """
    out = np.zeros((len(lines), 4), dtype=np.int64)
    for i, s in enumerate(lines):
        if '"' not in s:
            missing = n_fields - 1 - s.count(",")
            out[i, 2], out[i, 3] = max(0, missing), max(0, -missing)
    quoted = [i for i, s in enumerate(lines) if '"' in s]
    kinds = {i: np.array([1 if t == "," else 2 if t == '"' else 0 for t in _TOKEN.findall(lines[i])], dtype=np.int8) for i in quoted}
    order = sorted(quoted, key=lambda i: len(kinds[i]))
    for at in range(0, len(order), 512):
        rows = order[at : at + 512]
        tokens = np.full((len(rows), len(kinds[rows[-1]])), 3, dtype=np.int8)
        for j, i in enumerate(rows):
            tokens[j, : len(kinds[i])] = kinds[i]
        out[rows] = _edits(tokens, n_fields)
    return out


def _least(a: Cost, b: Cost) -> Cost:
    take = (b[0] < a[0]) | ((b[0] == a[0]) & (b[1] < a[1]))
    return np.where(take, b[0], a[0]), np.where(take, b[1], a[1])


def _edits(tokens: np.ndarray, n_fields: int) -> np.ndarray:
    """States are arrays (part of the cost, row, delimiters) so that a step is a few operations on all of them."""
    shape = (2, len(tokens), n_fields)
    states = [np.full(shape, _NEVER, dtype=np.int64) for _ in range(4)]
    states[_START][:, :, 0] = 0
    for step in tokens.T:
        _insert_quotes(states)
        whole = step[0] == step[-1] and (step == step[0]).all()
        for kind, move in ((0, _ordinary), (1, _delimiter), (2, _quote)):
            if whole and step[0] == kind:
                states = move(states)
            elif not whole and len(rows := np.flatnonzero(step == kind)):
                for state, new in zip(states, move([x[:, rows] for x in states])):
                    state[:, rows] = new
    _insert_quotes(states)
    missing = np.arange(n_fields - 1, -1, -1, dtype=np.int64)
    quotes, rest = _ended(states)
    rest = rest + missing * _D
    fewest = quotes.min(axis=1)
    rest = np.where(quotes == fewest[:, None], rest, _NEVER << 1)
    k = rest.argmin(axis=1)
    delimiters, inserted = rest[np.arange(len(rest)), k] // _D, rest[np.arange(len(rest)), k] % _D
    return np.stack([inserted, fewest - inserted, missing[k], delimiters - missing[k]], axis=1)


def _ended(states: list[np.ndarray]) -> Cost:
    return _least(_least(tuple(states[_START]), tuple(states[_PLAIN])), tuple(states[_CLOSED]))


def _insert_quotes(states: list[np.ndarray]) -> None:
    for a, b in ((_START, _QUOTED), (_QUOTED, _CLOSED), (_CLOSED, _QUOTED)):
        states[b] = np.stack(_least(tuple(states[b]), (states[a][0] + 1, states[a][1] + 1)))


def _ordinary(s: list[np.ndarray]) -> list[np.ndarray]:
    never = np.full_like(s[0], _NEVER)
    return [never, np.stack(_least(tuple(s[_START]), tuple(s[_PLAIN]))), s[_QUOTED], never.copy()]


def _delimiter(s: list[np.ndarray]) -> list[np.ndarray]:
    never = np.full_like(s[0], _NEVER)
    quotes, rest = _ended(s)
    counted = np.full_like(never, _NEVER)
    counted[0, :, 1:], counted[1, :, 1:] = quotes[:, :-1], rest[:, :-1]
    return [np.stack(_least(tuple(counted), (quotes, rest + _D))), never, s[_QUOTED], never.copy()]


def _quote(s: list[np.ndarray]) -> list[np.ndarray]:
    deleted = [(x[0] + 1, x[1]) for x in s]
    opened = _least(_least(deleted[_QUOTED], tuple(s[_START])), tuple(s[_CLOSED]))
    closed = _least(deleted[_CLOSED], tuple(s[_QUOTED]))
    return [np.stack(x) for x in (deleted[_START], deleted[_PLAIN], opened, closed)]


def _explained(n_fields: int, line: Column) -> Column:
    """(reason, column_name, edits) of a record that needs an edit; null for a null one."""

    @F.pandas_udf("reason string, column_name string, edits string")
    def explain(lines: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(None, index=lines.index, columns=["reason", "column_name", "edits"], dtype=object)
        broken = lines[lines.notna()]
        edits = edit_costs(broken.tolist(), n_fields)
        out.loc[broken.index, "reason"] = np.where(edits[:, 0] + edits[:, 1] > 0, "quoting", "column_count")
        out.loc[broken.index, "column_name"] = ""
        out.loc[broken.index, "edits"] = [f"quotes +{a} -{b}, delimiters +{c} -{d}" for a, b, c, d in edits]
        return out

    return explain(line)


# -- type checks -----------------------------------------------------------------------------------------------


def feature_text(value: Column) -> Column:
    return F.lower(F.btrim(value, F.lit(BLANKS)))


def feature_fault(value: Column) -> Column:
    """'nan', 'inf', 'invalid' or null for one feature field."""
    text = feature_text(value)
    word = F.regexp_replace(text, r"\A[+-]", "")
    return (
        F.when((text == "") | word.isin(NAN_WORDS), "nan")
        .when(word.isin(INF_WORDS), "inf")
        .when(~text.rlike(NUMBER), "invalid")
        .when(F.abs(text.try_cast("double")) == F.lit(float("inf")), "inf")
    )


def time_value(value: Column) -> Column:
    exact = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    return F.when(exact, value.try_cast("timestamp_ntz"))


def _fault(kind: str | None, value: Column, known: Column) -> Column:
    if kind == "feature":
        return feature_fault(value)
    if kind == "digits":
        return F.when(~value.rlike(r"\A[0-9]+\z"), "invalid")
    if kind == "time":
        return F.when(time_value(value).isNull(), "invalid")
    if kind == "label":
        return F.when(known.isNull(), "invalid")
    return F.lit(None).cast("string")


def _typed(kind: str | None, value: Column) -> Column:
    if kind == "feature":
        return feature_text(value).try_cast("double")
    if kind == "digits":
        return value.try_cast(f"decimal({MAX_DIGITS},0)")
    return time_value(value) if kind == "time" else value


def parse_records(df: DataFrame, fmt: RecordFormat, labels: DataFrame, id_col: str = "raw_id", line_col: str = "raw_line") -> ParsedRecords:
    """Parse ``line_col`` of ``df``; ``labels`` has the known labels' slugs in column ``slug``.

    One pass over the records for all results, no shuffle: the labels' lookup is a broadcast join up to
    ``fmt.label_rows`` labels, and only the text of records that need an edit leaves the JVM.
    """
    n = len(fmt.fields)
    at = {name: i for i, name in enumerate(fmt.fields)}
    line = F.coalesce(F.col(line_col), F.lit(""))
    costless = quoting_holds(F.col("_line")) & (outside_delimiters(F.col("_line")) == n - 1)
    rows = df.withColumn("_line", line).withColumn("_costless", costless)
    rows = rows.withColumn("_edit", _explained(n, F.when(~F.col("_costless"), F.col("_line"))))
    rows = rows.withColumn("_values", F.when(F.col("_costless"), field_values(F.col("_line"))))

    known = bounded(labels.select(F.col("slug").alias("_slug")).where("_slug is not null").distinct(), fmt.label_rows)
    label = next((f for f, k in fmt.kinds.items() if k == "label"), None)
    rows = rows.withColumn("_label", slug(F.col("_values")[at[label]]) if label else F.lit(None).cast("string"))
    rows = rows.join(known, F.col("_label") == F.col("_slug"), "left")
    faults = [
        F.when(fault.isNotNull(), F.struct(fault.alias("reason"), F.lit(name).alias("column_name"), F.lit("").alias("edits")))
        for name, kind in fmt.kinds.items()
        for fault in [_fault(kind, F.col("_values")[at[name]], F.col("_slug"))]
    ]
    typed = F.filter(F.array(*faults), lambda f: f.isNotNull()) if faults else F.array()
    rows = rows.withColumn("_faults", F.when(F.col("_costless"), typed.cast(FAULTS)).otherwise(F.array("_edit").cast(FAULTS)))
    return ParsedRecords(rows.select(*(F.col(f"`{c}`") for c in df.columns), "_values", "_faults"), fmt, id_col, line_col)


def scan_result(parsed: ParsedRecords, file_col: str = "file_path") -> DataFrame:
    """Per file: records, bad ones (any NaN or infinite field), all set aside, and NaN / infinite fields by column.

    One pass: faults are counted per file, reason and column before the shuffle, so a file of any size is
    pre-aggregated on the map side; a null file is a group of its own.
    """
    counted = F.exists("_faults", lambda f: f.reason.isin("nan", "inf"))
    rows = parsed.judged.select(file_col, counted.alias("_bad"), F.posexplode_outer("_faults").alias("_i", "_f"))
    once = F.coalesce(F.col("_i"), F.lit(0)) == 0
    cells = rows.groupBy(file_col, F.col("_f.reason").alias("_reason"), F.col("_f.column_name").alias("_column")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(once).alias("_rows"), F.count_if(once & F.col("_bad")).alias("_bad"),
        F.count_if(F.col("_i") == 0).alias("_failed"),
    )

    def counts(reason: str) -> Column:
        entry = F.when(F.col("_reason") == reason, F.struct("_column", "_n"))
        return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"{reason}_by_column")

    return cells.groupBy(file_col).agg(
        F.sum("_rows").alias("n_rows"), F.sum("_bad").alias("n_bad"), F.sum("_failed").alias("n_failed"), counts("nan"), counts("inf")
    )
