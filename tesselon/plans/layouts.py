"""Planar layouts of the plain tables, as SQL that Spark and DuckDB read alike.

The tables have no geometry, so that places are worked out from keys, in whole numbers. Every layout spreads over tiles
of 5,000 units a side as keys grow: density, and so the work for a row, stays the same at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid

TILE = 5000


def _tile(key: str, keys: int) -> str:
    return f"{TILE} * CAST(floor({key} / {keys}e0) AS BIGINT)"


POINTS = f"""SELECT CAST(p_partkey AS BIGINT) AS id, (p_partkey * 7919) % {TILE} + {_tile("p_partkey", 2000)} AS x, (p_partkey * 104729) % {TILE} AS y, p_brand AS category_1, p_type AS category_2, p_size AS size FROM part"""
BOXES = f"""SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, ((o_orderkey - o_orderkey % 2) * 6151) % {TILE} + 12 * (o_orderkey % 2) + {_tile("o_orderkey", 4000)} AS x0, ((o_orderkey - o_orderkey % 2) * 3571) % {TILE} + 7 * (o_orderkey % 2) AS y0, CAST(5 + o_orderkey % 36 AS BIGINT) AS w, CAST(5 + (o_orderkey * 7) % 31 AS BIGINT) AS h FROM orders)"""
NODES = f"""SELECT id, chain, j, (chain * 1733) % 4000 + 20 * CAST(floor((j + 1) / 2e0) AS BIGINT) + {_tile("chain", 20)} AS x, (chain * 2749) % 4000 + 20 * CAST(floor(j / 2e0) AS BIGINT) AS y
FROM (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(floor(c_custkey / 100e0) AS BIGINT) AS chain, CAST(c_custkey % 100 AS BIGINT) AS j FROM customer)"""
LINKS = f"""SELECT a.id AS id, a.id AS from_node, b.id AS to_node, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM ({NODES}) a JOIN ({NODES}) b ON b.id = a.id + 1 AND b.chain = a.chain"""
STREETS = f"""SELECT id, xa, ya, xa + (id * 37) % 161 - 80 AS xb, ya + (id * 53) % 141 - 70 AS yb FROM (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 6007) % {TILE} + {_tile("c_custkey", 2000)} AS xa, (c_custkey * 3203) % {TILE} AS ya FROM customer)"""
DISTRICTS = """SELECT CAST(n_nationkey AS BIGINT) AS district, n_name AS name, CAST(n_nationkey % 5 AS BIGINT) AS cx, CAST(floor(n_nationkey / 5e0) AS BIGINT) AS cy,
CASE WHEN n_nationkey % 5 < 3 THEN 'train' WHEN n_nationkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM nation"""
LAYOUTS = {"points": (POINTS, "part"), "boxes": (BOXES, "orders"), "nodes": (NODES, "customer"), "links": (LINKS, "customer"), "streets": (STREETS, "customer"), "districts": (DISTRICTS, "nation")}


def layout(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "links":
        return _links(layout(spark, sf_dir, "nodes"))
    sql, table = LAYOUTS[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _links(nodes: DataFrame) -> DataFrame:
    """``LINKS`` of nodes. As SQL the join would broadcast the nodes, however many, and leave the links in as few tasks as the
    file has row groups; here both sides are exchanged, and the links lie in as many as shuffles have."""
    a = grid.spread_out(nodes.withColumn("next", F.col("id") + 1), "next", "chain").alias("a")
    b = grid.spread_out(nodes, "id", "chain").alias("b")
    joined = a.join(b.hint("merge"), (F.col("b.id") == F.col("a.next")) & (F.col("b.chain") == F.col("a.chain")))
    return joined.select("a.id", F.col("a.id").alias("from_node"), F.col("b.id").alias("to_node"), F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb"))


def with_layouts(sql: str) -> str:
    """DuckDB SQL that may name the layouts as tables. SQL that begins with ", name AS (" goes on with the WITH clause."""
    import re

    sql = sql.strip()
    used = [f"{n} AS ({s})" for n, (s, _) in LAYOUTS.items() if re.search(rf"\b{n}\b", sql)]
    own = sql.startswith(",")
    if not used:
        return sql if sql.split(None, 1)[0].upper() in ("SELECT", "(SELECT") else "WITH " + sql.lstrip(", ")
    if not own and sql.split(None, 1)[0].upper() not in ("SELECT", "(SELECT"):
        sql, own = ", " + sql, True
    return "WITH " + ", ".join(used) + (sql if own else " " + sql)
