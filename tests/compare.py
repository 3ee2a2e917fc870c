"""Run queries beside their SQL: python tests/compare.py SF_DIR [name...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if v is not None and type(v).__name__ in ("Decimal",):
        return float(f"{float(v):.9g}")
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differ(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got = bag(df.columns, df.collect())
    rel = con.sql(sql)
    want = bag(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if got != want:
        return f"{sum(got.values())} rows, {sum(want.values())} wanted; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    con, bad = connect(sys.argv[1]), 0
    for name, sql in e.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            what = differ(s, con, e.queries()[name], sql, sys.argv[1])
        except Exception as x:  # noqa: BLE001
            what = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(what)
        print(f"{name}: {'ok' if not what else what[:700]} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bad)
