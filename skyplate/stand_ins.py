"""Chart relations made from the driver's tables, for queries that are held against SQL.

Each function gives the Spark frame; SQL holds the same relation as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APT = """apt AS (SELECT s_suppkey AS apt_id, 25 + CAST((s_suppkey * 7919) % 24000 AS DOUBLE) / 1000 AS lat,
 -125 + CAST((s_suppkey * 104729) % 58000 AS DOUBLE) / 1000 AS lon FROM supplier)"""
FEAT = """feat AS (SELECT c_custkey AS feat_id, c_mktsegment AS db_type, CAST(floor(c_acctbal) AS BIGINT) AS height,
 25 + CAST((c_custkey * 6151) % 24000 AS DOUBLE) / 1000 AS f_lat,
 -125 + CAST((c_custkey * 92821) % 58000 AS DOUBLE) / 1000 AS f_lon FROM customer)"""
CAT = """cat AS (SELECT o_orderkey AS rec_id, concat('P', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN '_deleted' ELSE '' END, '.PDF') AS pdf_name,
 CASE o_orderstatus WHEN 'F' THEN 'IAP' WHEN 'O' THEN 'APD' ELSE 'MIN' END AS chart_code,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'C' WHEN '3' THEN 'D' WHEN '4' THEN '' ELSE NULL END AS user_action,
 CASE WHEN o_custkey % 5 = 0 THEN 'M' WHEN o_custkey % 5 = 1 THEN 'm' ELSE 'N' END AS military_use,
 CASE o_orderkey % 6 WHEN 0 THEN 'HI-TACAN RWY 04' WHEN 1 THEN 'ILS RWY 22' WHEN 2 THEN 'Visual 13' WHEN 3 THEN 'hi-ILS 31' ELSE 'VOR A' END AS chart_name,
 concat('A', CAST(o_custkey % 97 AS VARCHAR)) AS faa_code, concat('S', CAST(o_custkey % 13 AS VARCHAR)) AS state_id FROM orders)"""
GEO = """geo AS (SELECT concat('P', CAST(l_orderkey AS VARCHAR), CASE WHEN l_orderkey % 11 = 0 THEN '_deleted' ELSE '' END, '.PDF') AS pdf_name, l_linenumber AS line,
 CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'AUTOBAD' WHEN 3 THEN 'AUTOGOOD' WHEN 4 THEN 'MANUALGOOD' WHEN 5 THEN 'ADDEDCHANGED' WHEN 6 THEN 'MANUALBAD' ELSE 'NOGEOREF' END AS status,
 CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '12abc' WHEN 2 THEN NULL WHEN 3 THEN ' 1.5e1x' ELSE CAST(l_suppkey % 6 AS VARCHAR) END AS gcp_count,
 CAST(l_partkey % 12 AS VARCHAR) AS pdftotext, CAST(l_tax AS VARCHAR) AS target_ratio,
 CASE l_suppkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE CAST(l_discount AS VARCHAR) END AS ratio,
 CASE l_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '-.5' ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS x_scale,
 CASE l_suppkey % 4 WHEN 0 THEN '0.0' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS y_scale,
 CASE l_suppkey % 3 WHEN 0 THEN '0' ELSE '0.25' END AS x_skew, '0' AS y_skew FROM lineitem)"""
ICON = """icon AS (SELECT vec_id AS icon_id, label AS page, 600 * CAST(embedding[{0}] AS DOUBLE) AS ix, 600 * CAST(embedding[{1}] AS DOUBLE) AS iy,
 CASE vec_id % 3 WHEN 0 THEN 'VORTAC' WHEN 1 THEN 'NDB' ELSE 'fix' END AS icon_type FROM embeddings WHERE vec_id % 2 = 0)"""
BOX = """box AS (SELECT vec_id AS box_id, label AS page, 600 * CAST(embedding[{0}] AS DOUBLE) AS bx, 600 * CAST(embedding[{1}] AS DOUBLE) AS by_,
 CASE vec_id % 4 WHEN 0 THEN 'VORTAC' WHEN 1 THEN 'NDB' ELSE 'fix' END AS db_type FROM embeddings WHERE vec_id % 2 = 1)"""
LINES = """lines AS (SELECT vec_id AS line_id, label AS page, 600 * CAST(embedding[{0}] AS DOUBLE) AS x1, 600 * CAST(embedding[{1}] AS DOUBLE) AS y1,
 600 * CAST(embedding[{2}] AS DOUBLE) AS x2, 600 * CAST(embedding[{3}] AS DOUBLE) AS y2 FROM embeddings)"""
STREAM = """stream AS (SELECT l_orderkey AS page, l_linenumber AS stream_no, CAST(l_quantity AS INTEGER) AS w, CAST(floor(l_extendedprice) AS BIGINT) % 700 AS x, l_partkey % 500 AS y,
 CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE CAST(l_suppkey % 40 AS INTEGER) - 20 END AS h FROM lineitem)"""
WORD = """word AS (SELECT l_orderkey AS page, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS line_no, CAST(l_partkey % 500 AS DOUBLE) AS x_min, CAST(l_suppkey % 300 AS DOUBLE) AS y_min,
 CAST(l_partkey % 500 + 10 + l_linenumber AS DOUBLE) AS x_max, CAST(l_suppkey % 300 + 8 AS DOUBLE) AS y_max,
 CASE l_partkey % 5 WHEN 0 THEN concat(CAST(l_partkey % 90 + 10 AS VARCHAR), '-') WHEN 1 THEN concat(CAST(l_suppkey % 60 AS VARCHAR), '.5''') WHEN 2 THEN 'N'
 WHEN 3 THEN CAST(l_partkey * 7 AS VARCHAR) ELSE 'ABCDE' END AS text FROM lineitem)"""
GCP = """gcp AS (SELECT vec_id AS key, label AS pdf_name, 1613 * (CAST(embedding[{0}] AS DOUBLE) + 1) / 2 AS px, 2475 * (CAST(embedding[{1}] AS DOUBLE) + 1) / 2 AS py,
 -71 + 0.0004 * 1613 * (CAST(embedding[{0}] AS DOUBLE) + 1) / 2 + 0.002 * CAST(embedding[{2}] AS DOUBLE) AS lon,
 43 - 0.0003 * 2475 * (CAST(embedding[{1}] AS DOUBLE) + 1) / 2 + 0.002 * CAST(embedding[{3}] AS DOUBLE) AS lat,
 CAST(1613 AS DOUBLE) AS width, CAST(2475 AS DOUBLE) AS height, 42.5 AS airport_lat FROM embeddings)"""

ALL = {"apt": APT, "feat": FEAT, "cat": CAT, "geo": GEO, "icon": ICON, "box": BOX, "lines": LINES, "stream": STREAM, "word": WORD, "gcp": GCP}
BASES = {"apt": "supplier", "feat": "customer", "cat": "orders", "geo": "lineitem", "stream": "lineitem", "word": "lineitem"}


def with_sql(*names: str) -> str:
    """WITH clause for DuckDB, whose lists start at 1."""
    return "WITH " + ", ".join(ALL[n].format(1, 2, 3, 4) for n in names)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same select run by Spark over the parquet table; its lists start at 0."""
    base = BASES.get(name, "embeddings")
    head = name + " AS ("
    body = ALL[name].format(0, 1, 2, 3).removeprefix(head)[:-1].replace("VARCHAR", "STRING").replace("'.5'''", r"'.5\''")
    return spark.sql(body.replace(f"FROM {base}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
