"""Run a registered query in Spark and its oracle in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

from metasift.plans.catalog import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


TIMES: dict[str, float] = {}

KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int",
    "hugeint": "huge", "string": "str", "varchar": "str", "double": "float", "float": "float",
    "boolean": "bool", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts",
}


def compare(spark, con, entry, sf_dir):
    """Return an error text, or None when both engines agree."""
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    TIMES[entry.key] = time.time() - t0
    gc, gr = rows_of(df.columns, got)
    if entry.oracle is None:
        return None if got else "no rows"
    cur = con.execute(entry.oracle)
    oc, orows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gc != oc:
        return f"columns differ: spark={gc} oracle={oc}"
    if not orows:
        return "oracle returned no rows"
    st = {n: KINDS.get(t.split("(")[0], t) for n, t in df.dtypes}
    ot = {d[0]: KINDS.get(str(d[1]).lower().split("(")[0], str(d[1]).lower()) for d in cur.description}
    bad = {n: (st[n], ot[n]) for n in gc if st[n] != ot[n]}
    if bad:
        return f"types differ (spark, oracle): {bad}"
    if gr != orows:
        a, b = set(map(repr, gr)), set(map(repr, orows))
        return (f"rows differ: spark {len(gr)} oracle {len(orows)} cols={gc}\n"
                f" only spark: {sorted(a - b)[:3]}\n only oracle: {sorted(b - a)[:3]}")
    return None
