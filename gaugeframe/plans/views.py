"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and
DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPECS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
  CASE l_linenumber
    WHEN 1 THEN concat('Ø', q, '.', cc, '±0.', tt) WHEN 2 THEN concat('R', q, '.', cc)
    WHEN 3 THEN concat(q, '°', cast(l_partkey % 60 AS string), chr(39), cast(l_suppkey % 60 AS string), chr(34))
    WHEN 4 THEN concat(q, '.', cc, ' max') WHEN 5 THEN concat(q, ' ~ ', q5)
    WHEN 6 THEN concat(q, ',', cc, '0.', tt) ELSE concat('FINISH ', l_returnflag) END AS value,
  CASE l_suppkey % 3 WHEN 0 THEN concat('+0.', tt, ', -0.', tt) WHEN 1 THEN concat('±0.', tt) ELSE '' END AS tolerance
FROM (SELECT *, cast(cast(l_quantity AS int) AS string) AS q, cast(cast(l_quantity AS int) + 5 AS string) AS q5,
  lpad(cast(l_partkey % 100 AS string), 2, '0') AS cc, lpad(cast(l_suppkey % 25 + 1 AS string), 2, '0') AS tt FROM {lineitem}) AS l
"""
ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
BOXES = f"""
SELECT l_orderkey AS page_id, cast({ROW} AS bigint) AS box_id, cast((l_partkey * 37) % 600 AS double) AS x, cast((l_suppkey * 53) % 400 AS double) AS y,
  cast(10 + l_partkey % 40 AS double) AS w, cast(10 + l_linenumber * 7 AS double) AS h FROM {{lineitem}}
"""
CANDIDATES = """
SELECT user_id AS crop_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS seq,
  concat(cast(user_id AS string), '.', lpad(cast((event_id * 31) % 4 AS string), 2, '0')) AS text,
  cast((event_id * 7919) % 955 AS double) / 1000 AS conf,
  cast((event_id * 13) % 300 AS double) AS x, cast((event_id * 29) % 90 AS double) AS y, cast(8 + event_id % 9 AS double) AS w,
  cast(5 + user_id % 60 AS double) AS h FROM {events}
"""
ANNOTATIONS = f"""
SELECT concat('P', cast(p_partkey % 7 AS string)) AS project_id, concat('L', cast(p_partkey AS string)) AS id, p_partkey AS number, 'label' AS kind, p_type AS label,
  CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS value, 'Note' AS type, cast(NULL AS string) AS label_id, '' AS range,
  CASE p_size % 3 WHEN 0 THEN 'Measure' WHEN 1 THEN '' ELSE NULL END AS method, CASE p_size % 4 WHEN 0 THEN 'Caliper' WHEN 1 THEN 'A & "B" <C>' ELSE NULL END AS tool,
  cast(p_partkey % 3 + 1 AS int) AS page, cast(p_size AS double) / 64 AS confidence, cast(p_partkey % 900 AS double) / 4 AS x, cast(p_size * 5 AS double) AS y, cast(60 AS double) AS w, cast(p_size AS double) / 2 AS h, cast(p_size % 4 * 90 AS int) AS rotation
FROM {{part}} WHERE p_size <= 40
UNION ALL
SELECT concat('P', cast(l_partkey % 7 AS string)), concat('D', cast(l_orderkey AS string), '-', cast(rn AS string)), l_orderkey * 100 + rn, CASE WHEN l_linenumber = 2 THEN NULL ELSE 'dimension' END,
  l_returnflag, value, l_linestatus, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('L', cast(l_partkey AS string)) END, tolerance,
  CASE l_suppkey % 4 WHEN 0 THEN 'Inspect' WHEN 1 THEN '' ELSE NULL END, CASE l_suppkey % 5 WHEN 0 THEN 'Gauge' ELSE '' END,
  cast(l_suppkey % 3 + 1 AS int), cast(l_suppkey % 65 AS double) / 64, cast(l_partkey % 600 AS double), cast(l_suppkey % 400 AS double) / 2, cast(10 + l_partkey % 40 AS double), cast(10 + rn * 7 AS double), cast(l_linenumber % 4 * 90 AS int)
FROM (SELECT *, cast({ROW} AS bigint) AS rn FROM ({SPECS}) AS s) AS d
"""
TABLES = {"specs": (SPECS, ["lineitem"]), "boxes": (BOXES, ["lineitem"]), "candidates": (CANDIDATES, ["events"]), "annotations": (ANNOTATIONS, ["lineitem", "part"])}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, needs = TABLES[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needs})


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    sql, needs = TABLES[name]
    for t in needs:
        sql = sql.replace("{" + t + "}", t)
    return f"({sql})"
