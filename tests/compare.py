"""Runs registered queries beside their SQL in DuckDB: python tests/compare.py SF_DIR [name ...]."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, con, sf, f, sql):
    """None, or what differs."""
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows: {[x for x in got if x not in set(want)][:2]} | {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows, such as {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    q, o, con = e.queries(), e.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(s, con, sys.argv[1], q[name], o[name]) if name in o else f"rows only: {q[name](s, sys.argv[1]).count()}"
        except Exception as x:
            said = f"ERROR {type(x).__name__} {str(x)[:500]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
