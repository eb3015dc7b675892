"""Compare queries with their SQL: python tests/compare.py SF_DIR [name ...]."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(root):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}") if v % 1 else int(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differs(df, con, sql):
    """What is different, or ''."""
    rel = con.sql(sql)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(list(rel.columns), rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    norm = lambda t: [tuple(int(x) if isinstance(x, float) and x == int(x) else x for x in r) for r in t]
    a, b = norm(a), norm(b)
    if sorted(a, key=repr) == sorted(b, key=repr):
        return ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"{len(a)} and {len(b)} rows; only Spark {list(sa - sb)[:2]}; only SQL {list(sb - sa)[:2]}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory",
        "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress",
        "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    root, names = sys.argv[1], sys.argv[2:]
    con, q, sql = connect(root), e.queries(), e.oracle_sql()
    bad = 0
    for n in names or q:
        t = time.time()
        try:
            said = differs(q[n](spark, root), con, sql[n]) if n in sql else f"rows only: {q[n](spark, root).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:300]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{'ok  ' if not said else '    '}{n} {time.time() - t:.1f}s {said[:600]}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
