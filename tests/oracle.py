"""Runs named queries in Spark and their SQL in DuckDB and compares them: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings jobs target_server heartbeats challenges rate_cfg eval_items pack_capacity".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def cell(v) -> str:
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def compare(spark, con, name: str, sf: str, query, sql: str) -> str:
    """Empty if both give the same columns, types and rows."""
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours = [tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.execute(sql)
    named = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    if sorted(named) != cols:
        return f"columns: {cols} and {sorted(named)}"
    at = [named.index(c) for c in cols]
    theirs = [tuple(cell(r[i]) for i in at) for r in rel.fetchall()]
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if not (same.get(t, t) == kinds[c] or kinds[c] == "NUMBER" or kinds[c] == "STRING")]
    a, b = sorted(ours), sorted(theirs)
    if a != b:
        only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"rows: {len(a)} and {len(b)}; only ours {only[0]}; only theirs {only[1]}"
    return f"types: {odd}" if odd else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from convoy.session import local_session

    spark, sf = local_session(8), sys.argv[1]
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            why = compare(spark, con, name, sf, queries[name], sql[name]) if name in sql else f"no SQL, {queries[name](spark, sf).count()} rows"
        except Exception as e:
            why = "error: " + str(e)[:1500]
        bad += bool(why)
        print(f"{name}: {why or 'same'} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bad > 0)
