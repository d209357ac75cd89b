"""Run registered queries beside their SQL in an in-process DuckDB and compare."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """(message or None, spark seconds, row count)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return (None if got else "no rows"), took, len(got)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", took, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", took, len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {bad[:3]}", took, len(got)
    return None, took, len(got)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from docketry.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            message, took, n = compare(spark, con, query, oracles.get(name), sf)
        except Exception as error:  # noqa: BLE001
            message, took, n = f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0
        flag = "ok  " if message is None else "FAIL"
        print(f"{flag} {name:32s} {took:6.2f}s rows={n} {'' if oracles.get(name) else '(rows only)'} {message or ''}", flush=True)
