"""Run registered queries next to their SQL: python tests/check_queries.py [sf] [prefix ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def family(kind: str) -> str:
    kind = str(kind).lower()
    if kind in ("bigint", "integer", "int", "smallint", "hugeint", "long"):
        return "int"
    return {"varchar": "string", "string": "string", "double": "double", "float": "float", "boolean": "boolean"}.get(kind, kind)


def compare(spark, con, name, fn, sql, folder):
    """None when rows, names and type families agree, else what differs."""
    began = time.time()
    df = fn(spark, folder)
    left_names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = [tuple(r[c] for c in left_names) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows", len(rows)
    compare.spark_seconds = time.time() - began
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    place = [names.index(c) for c in sorted(names)]
    if sorted(names) != left_names:
        return f"columns {left_names} / {sorted(names)}", len(rows)
    other = [tuple(r[i] for i in place) for r in cur.fetchall()]
    off = [(c, types[c], kinds[c]) for c in left_names if family(types[c]) != family(kinds[c])]
    if off:
        return f"types {off}", len(rows)
    a, b = Counter(map(repr, rows)), Counter(map(repr, other))
    if a != b:
        return f"rows {len(rows)}/{len(other)}: only spark {list((a - b))[:3]} only sql {list((b - a))[:3]}", len(rows)
    return (None if rows else "no rows"), len(rows)


compare.spark_seconds = 0.0


def main():
    from corefold.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # report and go on with the next query
            problem, n = "error " + str(e)[:700], -1
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {'sql' if name in oracles else 'rows-only'} {compare.spark_seconds:.1f}s of {time.time() - start:.1f}s {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print("failures:", bad)


if __name__ == "__main__":
    main()
