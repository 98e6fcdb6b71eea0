"""Relations derived from the driver's tables: the same SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_DEM = """
SELECT CASE WHEN a.v >= 0 THEN 'g0' END AS grid_id, CAST(a.v AS INT) AS r, CAST(b.v AS INT) AS c,
 CASE WHEN (a.v*7+b.v*3)%97=0 THEN CAST('NaN' AS DOUBLE)
  ELSE CAST(200+1.5*(47-a.v)+2*abs(b.v-24)+0.25*coalesce(q.b,0) AS DOUBLE) END AS z
FROM (SELECT DISTINCT l_partkey%48 AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_partkey%48 AS v FROM lineitem) b LEFT JOIN
 (SELECT l_partkey%48 AS rr, l_orderkey%48 AS cc, CAST(sum(l_quantity) AS BIGINT)%16 AS b FROM lineitem GROUP BY 1,2) q
 ON q.rr=a.v AND q.cc=b.v
"""
FX_ATT = """
SELECT o_orderkey AS id, CAST((o_orderkey*37)%10000 AS DOUBLE) AS x, CAST((o_orderkey*101)%10007 AS DOUBLE) AS y,
 CAST((o_custkey*17+o_orderkey)%360 AS DOUBLE) AS strike, CAST(o_orderkey%90 AS DOUBLE) AS dip, o_orderstatus AS region FROM orders
"""
FX_VERT = """
SELECT o_custkey AS trace_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq,
 CAST(10+((o_orderkey*13)%4600)/10.0 AS DOUBLE) AS x, CAST(10+((o_orderkey*29)%4600)/10.0 AS DOUBLE) AS y FROM orders
"""
FX_SCENE = """
SELECT o_orderkey AS ord, o_custkey%20 AS aoi, CAST(o_orderdate AS DATE) AS d, CAST((o_orderkey*31)%100 AS DOUBLE) AS cloud FROM orders
"""
FX_SCORE = """
SELECT event_id, CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS pos, value AS v FROM events WHERE event_type IN ('purchase','error')
"""
FX_FLAG = """
SELECT o_orderkey AS trace_id, o_orderstatus AS region, CAST((o_orderkey*7)%101 AS DOUBLE)/100 AS overlap, CAST((o_orderkey*13)%101 AS DOUBLE)/100 AS aligned, CAST((o_orderkey*29)%101 AS DOUBLE)/100 AS monotonicity,
 CAST((o_custkey*3)%977 AS DOUBLE)-400 AS curvature, CAST(1+(o_custkey*31)%400 AS DOUBLE) AS length, o_orderkey%3=0 AS is_drainage FROM orders
"""
VIEWS = {"fx_dem": FX_DEM, "fx_att": FX_ATT, "fx_vert": FX_VERT, "fx_scene": FX_SCENE, "fx_score": FX_SCORE, "fx_flag": FX_FLAG}
SOURCES = ("orders", "lineitem", "events", "embeddings")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived relations as DataFrames."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    return {name: spark.sql(_bound(sql), **{t: read[t] for t in read if _uses(sql, t)}) for name, sql in VIEWS.items()}


def _uses(sql: str, table: str) -> bool:
    return f" {table}" in sql.replace("\n", " ")


def _bound(sql: str) -> str:
    for t in SOURCES:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return sql


def oracle(sql: str) -> str:
    """sql with the derived relations that it names as common table expressions."""
    used = [(n, v) for n, v in VIEWS.items() if n in sql]
    heads = ", ".join(f"{n} AS ({v.strip()})" for n, v in used)
    body = sql.strip()
    if not used:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
