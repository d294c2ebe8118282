"""Compare registered queries with their SQL statements; also a command line.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {d[0]: str(d[1]) for d in cur.description}
    alike = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"}, "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"}}
    odd = [f"{c}: {types[c]} / {duck[c]}" for c in types if duck[c] not in alike.get(types[c], set())]
    if odd:
        return False, f"types {odd}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return False, f"\n  spark {g}\n  sql   {w}"
    return True, f"{len(got)} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from auditlake.session import local_session

    spark = local_session()
    con = connect(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    print("statements without a query:", sorted(set(oracle) - set(queries)))
    for name, query in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in oracle:
                ok, said = compare(spark, con, query, oracle[name], args.sf)
            else:
                ok, said = True, f"{query(spark, args.sf).count()} rows, no statement"
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {said[:2500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
