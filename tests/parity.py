"""Compare registered queries with their check SQL; also a small command line.

python -m tests.parity <data folder> [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, [tuple(plain(v.asDict(True) if hasattr(v, "asDict") else v) for v in r) for r in rows]


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]


def sort_key(row):
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def difference(spark, con, entry, folder) -> tuple[str | None, int]:
    """None when equal, else a short account of the first difference."""
    from tidemark.registry import runner

    names, rows = spark_rows(runner(entry)(spark, folder))
    if entry.check_sql is None:
        return None, len(rows)
    other_names, other = duck_rows(con, entry.check_sql)
    if names != other_names:
        return f"columns {names} / {other_names}", len(rows)
    if len(rows) != len(other):
        return f"rows {len(rows)} / {len(other)}", len(rows)
    for a, b in zip(sorted(rows, key=sort_key), sorted(other, key=sort_key)):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]
            return f"values {bad[:3]} in {a}"[:700], len(rows)
        kinds = [(n, x, y) for n, x, y in zip(names, a, b) if type(x) is not type(y)]
        if kinds:
            return f"kinds {kinds[:3]}", len(rows)
    return None, len(rows)


def main() -> int:
    from tidemark.registry import entries
    from tidemark.session import local_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark, con, bad = local_session(), duck(folder), 0
    for name, entry in entries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem, n = difference(spark, con, entry, folder)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        took = time.time() - start
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        if problem is not None or took > 6 or n == 0 or entry.check_sql is None:
            print(f"{mark} {name:32} rows={n} {took:5.1f}s {'' if entry.check_sql else '(no sql)'} {problem or ''}", flush=True)
    print("bad:", bad, "of", len(entries()))
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
