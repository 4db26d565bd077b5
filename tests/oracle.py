"""Compare a query with its SQL on the same Parquet tables, as sets of rows with multiplicities."""

import math
import os
from collections import Counter

import duckdb


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            path = os.path.join(folder, name)
            path = path + "/*.parquet" if os.path.isdir(path) else path
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    return db


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


def compare(spark, folder, query, sql):
    got = query(spark, folder)
    cols = sorted(got.columns)
    a = Counter(tuple(_plain(r[c]) for c in cols) for r in got.collect())
    res = connect(folder).execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    b = Counter(tuple(_plain(r[i]) for i in at) for r in res.fetchall())
    assert a == b, f"{sum(a.values())} rows, SQL {sum(b.values())}; only query {list((a - b).items())[:4]}; only SQL {list((b - a).items())[:4]}"
    return sum(a.values())
