"""Compare registered queries with their SQL in DuckDB.

As a script: ``python -m tests.oracle [sf_dir] [name part ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

SF_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(f"{float(v):.9g}") + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


# Type names of the two engines that mean the same.
SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def compare(df, con, sql):
    """None when equal, otherwise a short description of the difference."""
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    wrong = [f"{c}: {t} vs {kinds[c]}" for c, t in df.dtypes if SAME_TYPES.get(t, t) != kinds[c]]
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {list(set(got) - set(want))[:2]}; missing {list(set(want) - set(got))[:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


def main(argv):
    from finlake.plans.catalogue import ORACLE, QUERIES
    from finlake.session import local_session

    sf_dir = argv[0] if argv else SF_DIR
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if len(argv) > 1 and not any(part in name for part in argv[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = compare(fn(spark, sf_dir), con, ORACLE[name])
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                n = fn(spark, sf_dir).count()
                status = f"rows {n}" if n else "EMPTY"
        except Exception as e:  # noqa: BLE001 - report and go on
            status = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += status.startswith(("DIFF", "ERROR", "EMPTY"))
        print(f"{name:36s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
