import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from oracle import compare
from tidegate.operators.rowparse import (
    RecordFormat, _least, edit_costs, field_values, outside_delimiters, parse_records, quoting_holds, scan_result,
)
from tidegate.plans import records

GRAMMAR = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
FMT = RecordFormat(["n", "t", "x", "lab", "note"], {"n": "digits", "t": "time", "x": "feature", "lab": "label"})
OK = "1,2025-01-02 03:04:05,1.5,Tcp,fine"


def fields_of(line):
    return [v[1:-1].replace('""', '"') if v.startswith('"') else v for v in re.findall(r',("(?:[^"]|"")*"|[^",]*)', "," + line)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a,"', max_size=14), min_size=1, max_size=6))
def test_edits_name_the_broken_part(lines):
    costs = edit_costs(lines, 3)
    for line, (qi, qd, di, dd) in zip(lines, costs):
        holds = GRAMMAR.fullmatch(line) is not None
        assert (qi + qd == 0) == holds, line
        if holds:
            assert di - dd == 3 - len(fields_of(line)) and min(di, dd) == 0, line


def test_least_edits_against_search():
    """Breadth-first search over single quote edits agrees on the number of quote edits."""

    def quote_edits(line):
        level, seen = {line}, {line}
        for n in range(6):
            if any(GRAMMAR.fullmatch(x) for x in level):
                return n
            level = {y for x in level for i in range(len(x) + 1) for y in (x[:i] + '"' + x[i:], x[:i] + x[i + 1 :] if x[i : i + 1] == '"' else x)} - seen
            seen |= level

    for line in ['"a', 'a"b', '"a"b,c', '"a,"b",c', '"""', 'x,"y,z', '"a" "b"', 'a"', '"a""b', ',"', '"x" ,y']:
        qi, qd, _, _ = edit_costs([line], 3)[0]
        assert qi + qd == quote_edits(line), line


def test_edits_beyond_two_to_the_21():
    """Millions of edits in one line are counted, not only the first 2^21."""
    assert edit_costs(["," * 2_097_300], 14).tolist() == [[0, 0, 0, 2_097_300 - 13]]
    n = 70_000  # every quote after text is deleted; one more than 2^16 of each kind of edit
    assert edit_costs(['a"' * n + "," * n], 3).tolist() == [[0, n, 0, n - 2]]
    a, b = _least((np.array([1 << 40]), np.array([5])), (np.array([1 << 40]), np.array([4])))
    assert (a[0], b[0]) == (1 << 40, 4)


def test_quoting_and_fields_in_the_jvm(spark):
    lines = ["", "a", '""', '"a"', '"a""b",c', 'a"b', '"a', '"a"x', ',"",', '"a,b",c', '"\n",x', '"""a"', '"\x01\x02,",\x01', ',,', '"a","b"', "é" * 5000 + ',"' + '""' * 5000 + '"']
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    for s, ok, n, f in df.select("s", quoting_holds(F.col("s")), outside_delimiters(F.col("s")), field_values(F.col("s"))).collect():
        assert ok == (GRAMMAR.fullmatch(s) is not None), s[:50]
        if ok:
            assert f == fields_of(s) and n == len(f) - 1, s[:50]


def failures(spark, lines, fmt=FMT):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id long, raw_line string")
    labels = spark.createDataFrame([("tcp",), (None,), ("tcp",)], "slug string")
    got = parse_records(df, fmt, labels)
    return sorted((r.raw_id, r.reason, r.column_name) for r in got.failures.collect()), got


@pytest.mark.parametrize(
    "change,reason,column",
    [
        ((2, " -NaN "), "nan", "x"), ((2, ""), "nan", "x"), ((2, "+n/a"), "nan", "x"), ((2, "None"), "nan", "x"),
        ((2, "-∞"), "inf", "x"), ((2, "Infinity"), "inf", "x"), ((2, "-7.2E+999"), "inf", "x"), ((2, '" inf"'), "inf", "x"),
        ((2, "1_000"), "invalid", "x"), ((2, "２５"), "invalid", "x"), ((2, "2e"), "invalid", "x"), ((2, "0x1"), "invalid", "x"), ((2, "+-"), "invalid", "x"),
        ((0, "3.0"), "invalid", "n"), ((0, " 3"), "invalid", "n"), ((0, ""), "invalid", "n"), ((0, "٣"), "invalid", "n"),
        ((1, "2025-02-30 00:00:00"), "invalid", "t"), ((1, "2025-01-02 25:00:00"), "invalid", "t"), ((1, "2025-01-02"), "invalid", "t"),
        ((3, "udp"), "invalid", "lab"), ((3, ""), "invalid", "lab"),
    ],
)
def test_reasons(spark, change, reason, column):
    parts = OK.split(",")
    parts[change[0]] = change[1]
    assert failures(spark, [",".join(parts)])[0] == [(0, reason, column)]


def test_loads_and_separates(spark):
    lines = [OK, OK, None, "", OK + ",more", OK + '"', '1,2025-01-02 03:04:05," +1.5E1 ","T-C P","a ""b"",\nc"', "x,y,z,w,v", "9" * 30 + OK[1:], "000" + "7" * 41 + OK[1:], "0" * 60 + "7" + OK[1:]]
    found, got = failures(spark, lines)
    assert found == [(2, "column_count", ""), (3, "column_count", ""), (4, "column_count", ""), (5, "quoting", ""),
                     (7, "invalid", "lab"), (7, "invalid", "n"), (7, "invalid", "t"), (7, "invalid", "x")]
    loaded = {r.raw_id: r for r in got.loaded.collect()}
    assert sorted(loaded) == [0, 1, 6, 8, 9, 10]
    assert loaded[6].x == 15.0 and loaded[6].note == 'a "b",\nc' and str(loaded[6].t) == "2025-01-02 03:04:05"
    assert loaded[8].n == int("9" * 30) and loaded[8].n_digits is None and loaded[6].n == 1  # beyond a long
    assert loaded[9].n is None and loaded[9].n_digits == "0" * 3 + "7" * 41 and loaded[10].n == 7 and loaded[10].n_digits is None
    edits = {r.raw_id: r.edits for r in got.failures.collect()}
    assert edits[4] == "quotes +0 -0, delimiters +0 -1" and edits[5] == "quotes +0 -1, delimiters +0 -0"


def test_empty_long_and_clashing(spark):
    assert failures(spark, [])[0] == []
    long = '"' + "a,b" * 200_000 + "x,y"
    assert failures(spark, [long, OK[:-4] + "z" * 300_000])[0] == [(0, "quoting", "")]
    df = spark.createDataFrame([(1, OK, "kept", 5)], "raw_id long, raw_line string, note string, `a.b` int")
    row = parse_records(df, FMT, spark.createDataFrame([("tcp",)], "slug string")).loaded.collect()[0]
    assert row.in_note == "kept" and row.note == "fine" and row["a.b"] == 5


def test_scan_result(spark):
    lines = [("f", OK), ("f", OK.replace("1.5", "nan")), ("f", OK.replace("1.5", "inf")), (None, OK.replace("1.5", "")), ("f", '"')]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lines)], "raw_id long, file_path string, raw_line string")
    got = parse_records(df, FMT, spark.createDataFrame([("tcp",)], "slug string"))
    res = {r.file_path: r for r in scan_result(got).collect()}
    assert (res["f"].n_rows, res["f"].n_bad, res["f"].n_failed) == (4, 2, 3)
    assert res["f"].nan_by_column == {"x": 1} and res["f"].inf_by_column == {"x": 1}
    assert res[None].nan_by_column == {"x": 1} and res[None].inf_by_column == {}


@pytest.mark.parametrize("name", sorted(records.QUERIES))
def test_against_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", records.QUERIES[name], records.SQL[name])
