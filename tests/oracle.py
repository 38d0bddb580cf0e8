"""Run registered queries against their SQL on DuckDB and compare all rows.

    python tests/oracle.py [name-part ...] [--sf 0.01]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


TIMES: dict[str, float] = {}


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    start = time.time()
    df = fn(spark, sf_dir)
    records = [tuple(r) for r in df.collect()]
    TIMES["spark"] = time.time() - start
    ours = rows_of(df.columns, records)
    res = con.execute(sql)
    theirs = rows_of([c[0] for c in res.description], res.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} vs {len(theirs[1])}"
    diff = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if diff:
        cut = lambda t: tuple(x[:80] for x in t)
        return f"{len(diff)} rows differ, first {cut(diff[0][0])} vs {cut(diff[0][1])}"
    return None if ours[1] else "no rows"


def main() -> int:
    from seqlab.runtime import get_spark

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = get_spark("oracle"), connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, fn, sqls[name])
                kind = "match"
            else:
                n = len(fn(spark, sf_dir).collect())
                problem, kind = (None if n else "no rows"), f"rows={n}"
        except Exception as e:  # noqa: BLE001
            problem, kind = "".join(traceback.format_exception_only(e))[:1500], ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:42s} {time.time() - start:6.2f}s (spark {TIMES.pop('spark', 0):5.2f}s) {problem or kind}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
