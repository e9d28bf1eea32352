"""Runs a registered query in Spark and its SQL in DuckDB and compares the two as sorted rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(table, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str):
    """(problem or None, rows)."""
    got = query(spark, sf_dir)
    got_columns, got_rows = canon(got.columns, [tuple(r) for r in got.collect()])
    relation = con.execute(sql)
    columns, rows = canon([d[0] for d in relation.description], relation.fetchall())
    if got_columns != columns:
        return f"columns {got_columns} != {columns}", len(got_rows)
    if len(got_rows) != len(rows):
        return f"rows {len(got_rows)} != {len(rows)}", len(got_rows)
    bad = [(a, b) for a, b in zip(got_rows, rows) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None), len(got_rows)


def main(names, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), database(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem, n = compare(spark, con, query, sql[name], sf_dir)
            else:
                problem, n = None, query(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        print(f"{'FAIL' if problem else 'ok  '} {name} {n} rows {time.time() - start:.1f}s"
              f"{'' if name in sql else ' (no SQL)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(len(failed), "failed", failed)


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = [a for a in args if a.startswith("/")]
    main([a for a in args if not a.startswith("/")], *folder)
