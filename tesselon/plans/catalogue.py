"""All registered queries and their SQL. The SQL states each result plainly, by range joins and windows; the queries use the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, geometry, grid, ids, near, text
from ..operators import audits, observations, planning, profiles, relations, spatial, splits, zonal
from ..sources import layers, mapping
from .layouts import TILE, layout, with_layouts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL, which may name the layouts as tables."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = with_layouts(sql)
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Windows of the points, and of the boxes, as SQL: every index that could reach, then the plain test.
NUMBERS = "numbers AS (SELECT unnest(range(-2, CAST((SELECT 3 + max(p_partkey) / 2000 FROM part) * 20 AS BIGINT))) AS i)"
WINDOWED = """SELECT p.*, c.i AS col, r.i AS row FROM points p JOIN numbers c ON p.x BETWEEN c.i * 250 - 250 AND c.i * 250 + 250 JOIN numbers r ON p.y BETWEEN r.i * 250 - 250 AND r.i * 250 + 250"""
WIDE = "wide AS (SELECT unnest(range(-2, CAST((SELECT 3 + max(o_orderkey) / 4000 FROM orders) * 20 AS BIGINT))) AS i)"
CLIPPED = """SELECT id, col, row, greatest(x0, col * 250 - 250) AS cx0, greatest(y0, row * 250 - 250) AS cy0, least(x1, col * 250 + 250) AS cx1, least(y1, row * 250 + 250) AS cy1, x0, y0, x1, y1
FROM (SELECT b.*, c.i AS col, r.i AS row FROM boxes b JOIN wide c ON b.x0 < c.i * 250 + 250 AND b.x1 > c.i * 250 - 250 JOIN wide r ON b.y0 < r.i * 250 + 250 AND b.y1 > r.i * 250 - 250)"""
ROADS = "span AS (SELECT unnest(range(-2, CAST((SELECT 3 + max(c_custkey) / 2000 FROM customer) * 20 AS BIGINT))) AS i)"
CUT = """SELECT id, from_node, to_node, xa, ya, xb, yb, col, row, greatest(xa, col * 250 - 250)::DOUBLE AS px, greatest(ya, row * 250 - 250)::DOUBLE AS py, least(xb, col * 250 + 250)::DOUBLE AS qx, least(yb, row * 250 + 250)::DOUBLE AS qy
FROM (SELECT l.*, c.i AS col, r.i AS row FROM links l JOIN span c ON xa <= c.i * 250 + 250 AND xb >= c.i * 250 - 250 JOIN span r ON ya <= r.i * 250 + 250 AND yb >= r.i * 250 - 250)"""


@query(f", {NUMBERS}, w AS ({WINDOWED}) SELECT col, row, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM w GROUP BY col, row")
def window_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations.points_in_windows(layout(spark, sf_dir, "points"))
    return seen.groupBy("col", "row").agg(F.count("*").alias("points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


@query("SELECT c.i AS col, r.i AS row, c.i * 250 - 250e0 AS xmin, r.i * 250 - 250e0 AS ymin, c.i * 250 + 250e0 AS xmax, r.i * 250 + 250e0 AS ymax FROM (SELECT unnest(range(-50, 50)) AS i) c, (SELECT unnest(range(-50, 50)) AS i) r WHERE c.i * 250 - 250 >= 0 AND c.i * 250 + 250 <= 5000 AND r.i * 250 - 250 >= 0 AND r.i * 250 + 250 <= 5000")
def window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.candidate_grid(spark, 0, 0, TILE, TILE)


@query(", b AS (SELECT x // 2000 AS block_col, y // 2000 AS block_row, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points GROUP BY ALL) SELECT *, sha256('block|EPSG:5186|2000|' || block_col || '|' || block_row) AS block_id FROM b")
def processing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = layout(spark, sf_dir, "points")
    blocks = points.select("x", "y", *grid.block_of(F.col("x"), F.col("y"))).groupBy("block_col", "block_row")
    counted = blocks.agg(F.count("*").alias("points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return counted.withColumn("block_id", ids.block_id("block", "EPSG:5186", grid.BLOCK, F.col("block_col"), F.col("block_row")))


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), c AS (SELECT col - a.d AS cx, row - b.d AS cy, count(*) AS multiplicity FROM w, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d) GROUP BY ALL) SELECT multiplicity, count(*) AS cells FROM c GROUP BY 1")
def coverage_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = observations.points_in_windows(layout(spark, sf_dir, "points")).select("col", "row").distinct()
    return observations.coverage_multiplicity(windows)


def canonical_sql(*fields: str) -> str:
    part = lambda f: f"CASE WHEN {f} IS NULL THEN encode('N') ELSE encode('S') || unhex(lpad(to_hex(strlen({f})), 16, '0')) || encode({f}) END"
    return "sha256(" + " || ".join(part(f) for f in fields) + ")"


def window_id() -> Column:
    """The identity of the window (col, row) of the grid that all queries use."""
    return ids.window_id("footprint_id", "v1", "EPSG:5186", (0, 0), (500, 500), (250, 250.0), F.col("col"), F.col("row"))


WINDOW_ID = canonical_sql(*(repr(x) for x in ("footprint_id", "v1", "EPSG:5186", "0", "0", "500", "500", "250", "250")), "CAST(col AS VARCHAR)", "CAST(row AS VARCHAR)")


OPTIONAL = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END"


@query(f"SELECT p_partkey, {canonical_sql(repr('source_object_id'), repr('poi'), repr('part'), 'CAST(p_partkey AS VARCHAR)')} AS object_id, {canonical_sql(OPTIONAL, 'p_type')} AS attribute_id FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", ids.source_object_id(F.lit("poi"), F.lit("part"), F.col("p_partkey")).alias("object_id"), ids.canonical_hash(F.expr(OPTIONAL), F.col("p_type")).alias("attribute_id"))


@query("SELECT l_orderkey, l_linenumber, sha256('line|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey) AS observation_id FROM lineitem")
def observation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.lit("line"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.observation_hash(*fields).alias("observation_id"))


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})) SELECT col, row, {WINDOW_ID} AS window_id FROM w")
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = observations.points_in_windows(layout(spark, sf_dir, "points")).select("col", "row").distinct()
    return windows.withColumn("window_id", window_id())


@query("SELECT l_orderkey, l_linenumber, l_partkey % 10 AS shape, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 10 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS occurrence FROM lineitem")
def clip_part_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("shape", F.col("l_partkey") % 10)
    return observations.part_occurrence(lines, ["l_orderkey", "shape"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "shape", "occurrence")


LABEL = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' > ', chr(92), p_name) ELSE p_name END"


@query(f"SELECT p_partkey, array_to_string(list_transform([p_brand, p_type, {LABEL}], lambda c: coalesce(replace(replace(c, chr(92), chr(92) || chr(92)), ' > ', chr(92) || ' > '), chr(92) || 'N')), ' > ') AS path FROM part")
def category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", text.category_path(F.col("p_brand"), F.col("p_type"), F.expr(LABEL)).alias("path"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(l_quantity AS SMALLINT) END AS quantity, l_quantity <> floor(l_quantity) AS quantity_inexact, CASE WHEN l_extendedprice = floor(l_extendedprice) AND l_extendedprice <= 32767 THEN CAST(floor(l_extendedprice) AS SMALLINT) END AS price, l_extendedprice <> floor(l_extendedprice) OR l_extendedprice > 32767 AS price_inexact FROM lineitem")
def canonical_cast_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a safe cast would refuse is null here and flagged; ``mapping.canonical`` in strict mode fails on it."""
    lines = table(spark, sf_dir, "lineitem")
    out = ["l_orderkey", "l_linenumber"]
    for source, name in (("l_quantity", "quantity"), ("l_extendedprice", "price")):
        value, inexact = mapping.safe_cast(F.col(source), "double", "smallint")
        out += [value.alias(name), inexact.alias(f"{name}_inexact")]
    return lines.select(*out)


PROFILED = ["customer_id", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey", "note"]
NOTE = "CASE WHEN c_custkey % 7 = 0 THEN ' na ' WHEN c_custkey % 7 = 1 THEN '' WHEN c_custkey % 7 = 2 THEN '  ' WHEN c_custkey % 7 = 3 THEN ' 0042' WHEN c_custkey % 7 = 4 THEN 'NaN' WHEN c_custkey % 7 = 5 THEN '-1.5' END"


@query(
    f", c AS (SELECT *, c_custkey AS customer_id, {NOTE} AS note FROM customer) SELECT \"column\", count(*) AS rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS \"distinct\", count(v) - count(DISTINCT v) AS duplicates, coalesce(count_if(v = ''), 0) AS empty, coalesce(count_if(v <> '' AND trim(v) = ''), 0) AS whitespace_only, count_if(v <> trim(v)) AS padded, coalesce(count_if(upper(trim(v)) IN ('', 'NULL', 'NA', 'N/A')), 0) AS missing_tokens, "
    "coalesce(count_if(regexp_matches(trim(v), '^0[0-9]+$')), 0) AS leading_zeros, coalesce(count_if(isfinite(TRY_CAST(v AS DOUBLE)) AND TRY_CAST(v AS DOUBLE) < 0), 0) AS negative, coalesce(count_if(TRY_CAST(v AS DOUBLE) = 0), 0) AS zero, coalesce(count_if(NOT isfinite(TRY_CAST(v AS DOUBLE))), 0) AS non_finite, "
    "\"column\" = 'customer_id' AND count(*) = count(v) AND count(DISTINCT v) / count(*) >= 0.95 AS id_candidate FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM c" for c in PROFILED)
    + ") GROUP BY 1"
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a column of every kind of text that stands for nothing."""
    customer = table(spark, sf_dir, "customer")
    return profiles.column_profile(customer.withColumn("note", F.expr(NOTE)).withColumn("customer_id", F.col("c_custkey")), *PROFILED)


MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for n, q in profiles.QUANTILES.items()) + f" FROM lineitem WHERE isfinite({c})"
        for c in MEASURED
    )
)
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.numeric_summary(table(spark, sf_dir, "lineitem"), *MEASURED)


@query(
    "l AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS r FROM customer GROUP BY 1), b AS (SELECT l, r FROM l FULL JOIN r USING (k)), s AS (SELECT count(l) AS left_keys, count(r) AS right_keys, count_if(l IS NOT NULL AND r IS NOT NULL) AS common_keys, "
    "count_if(r IS NULL) AS left_only, count_if(l IS NULL) AS right_only, count_if(l > 1) AS left_duplicates, count_if(r > 1) AS right_duplicates, CAST(sum(l * r) AS BIGINT) AS joined_rows FROM b) SELECT *, CASE WHEN left_duplicates > 0 THEN 'many' ELSE 'one' END || ':' || CASE WHEN right_duplicates > 0 THEN 'many' ELSE 'one' END AS cardinality, "
    "round(common_keys / left_keys, 6) AS left_match, CASE WHEN common_keys = 0 THEN 'disjoint' WHEN left_only = 0 AND right_only = 0 THEN 'equal' WHEN left_only = 0 THEN 'left within right' WHEN right_only = 0 THEN 'right within left' ELSE 'overlapping' END AS verdict FROM s"
)
def join_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.join_profile(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT count(*) AS rows, count(DISTINCT l_partkey) AS unique_keys, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, count(*) - count(l_partkey) AS null_keys FROM lineitem")
def key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.key_summary(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "a AS (SELECT 'p_type' AS parent, 'p_brand' AS child, p_brand AS v, count(DISTINCT p_type) AS n FROM part GROUP BY 3 UNION ALL SELECT 'p_brand', 'p_name', p_name, count(DISTINCT p_brand) FROM part GROUP BY 3) "
    "SELECT parent, child, count(*) AS children, count_if(n > 1) AS ambiguous, max(n) AS most_parents FROM a GROUP BY 1, 2"
)
def hierarchy_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.hierarchy_ambiguity(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_name")


@query("SELECT id AS o_orderkey, x0, y0, x1, y1, o_orderstatus, o_totalprice FROM boxes JOIN orders ON o_orderkey = id")
def attribute_join_1to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout(spark, sf_dir, "boxes").withColumnRenamed("id", "o_orderkey")
    return profiles.attribute_join(boxes, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query("(SELECT 2 * o_custkey AS key, 'left' AS side FROM orders EXCEPT SELECT c_custkey, 'left' FROM customer) UNION ALL (SELECT c_custkey, 'right' FROM customer EXCEPT SELECT 2 * o_custkey, 'right' FROM orders)")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.unmatched_keys(table(spark, sf_dir, "orders").withColumn("o_custkey", 2 * F.col("o_custkey")), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query(f", {WIDE}, c AS ({CLIPPED}) SELECT id, col, row, cx0, cy0, cx1, cy1, ((x1 - x0) * (y1 - y0))::DOUBLE AS source_area, ((cx1 - cx0) * (cy1 - cy0))::DOUBLE AS area, CASE WHEN cx0 = x0 AND cx1 = x1 AND cy0 = y0 AND cy1 = y1 THEN 'full' ELSE 'clipped' END AS status, (cx0 + cx1) / 2 AS rep_x, (cy0 + cy1) / 2 AS rep_y FROM c")
def box_clip_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs_of_corners(observations.clip_boxes(layout(spark, sf_dir, "boxes")))


def longs_of_corners(clipped: DataFrame) -> DataFrame:
    return longs(clipped, "cx0", "cy0", "cx1", "cy1")


@query(f", {ROADS}, c AS ({CUT}), l AS (SELECT *, hypot_(qx - px, qy - py) AS length FROM c) SELECT id, col, row, px, py, qx, qy, length, row_number() OVER (PARTITION BY col, row ORDER BY length DESC, least(px, qx), least(py, qy), id) - 1 AS part FROM l WHERE length > 0".replace("hypot_(qx - px, qy - py)", "sqrt((qx - px) ** 2 + (qy - py) ** 2)"))
def segment_clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = observations.order_parts(observations.clip_segments(layout(spark, sf_dir, "links")), "col", "row")
    return parts.select("id", "col", "row", "px", "py", "qx", "qy", "length", "part")


MAPPED = """SELECT col, row, district, split, sum(greatest(0, least(col * 250 + 250, (u.i + 1) * 1000) - greatest(col * 250 - 250, u.i * 1000)) * greatest(0, least(row * 250 + 250, (v.i + 1) * 1000) - greatest(row * 250 - 250, v.i * 1000)))::DOUBLE AS area
FROM w JOIN numbers u ON u.i * 1000 < col * 250 + 250 AND (u.i + 1) * 1000 > col * 250 - 250 JOIN numbers v ON v.i * 1000 < row * 250 + 250 AND (v.i + 1) * 1000 > row * 250 - 250
JOIN districts d ON d.cx = ((u.i % 5) + 5) % 5 AND d.cy = ((v.i % 5) + 5) % 5 GROUP BY ALL"""
SPLITS = "SELECT col, row, min(split) AS split FROM m GROUP BY 1, 2 HAVING count(DISTINCT split) = 1"


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = observations.points_in_windows(layout(spark, sf_dir, "points")).select("col", "row").distinct()
    return observations.district_mapping(windows, layout(spark, sf_dir, "districts"))


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), m AS ({MAPPED}) SELECT *, area / 250000 AS fraction, row_number() OVER (PARTITION BY col, row ORDER BY area DESC, district) = 1 AS is_primary FROM m")
def primary_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), m AS ({MAPPED}) {SPLITS}")
def eligible_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.split_of_windows(mapped(spark, sf_dir))


EDGES = f"""SELECT *, CASE WHEN px = xa AND py = ya THEN 'n' || from_node WHEN px = xb AND py = yb THEN 'n' || to_node ELSE 'b:' || id || ':' || col || ':' || row || ':start' END AS start_node,
CASE WHEN qx = xa AND qy = ya THEN 'n' || from_node WHEN qx = xb AND qy = yb THEN 'n' || to_node ELSE 'b:' || id || ':' || col || ':' || row || ':end' END AS end_node FROM ({CUT}) WHERE qx > px OR qy > py"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.road_edges(observations.clip_segments(layout(spark, sf_dir, "links")))


@query(f", {ROADS}, e AS ({EDGES}) SELECT col, row, id, start_node, end_node FROM e")
def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("col", "row", "id", "start_node", "end_node")


@query(f", {ROADS}, e AS ({EDGES}) SELECT DISTINCT col, row, node, x, y, CASE WHEN starts_with(node, 'n') THEN 'source' ELSE 'boundary' END AS kind FROM (SELECT col, row, start_node AS node, px AS x, py AS y FROM e UNION ALL SELECT col, row, end_node, qx, qy FROM e)")
def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = observations.segments_in_groups(layout(spark, sf_dir, "links"))
    return observations.road_nodes(observations.road_edges(observations.clip_segments(links)))


CONNECTED = """SELECT DISTINCT a.col, a.row, 'CON' AS kind, 'road' AS src_type, a.id AS src, 'road' AS dst_type, b.id AS dst, 0e0 AS distance FROM e a JOIN e b ON a.col = b.col AND a.row = b.row AND a.id <> b.id
AND (a.start_node IN (b.start_node, b.end_node) OR a.end_node IN (b.start_node, b.end_node))"""


@query(f", {ROADS}, e AS ({EDGES}) {CONNECTED}")
def relation_con(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.connections(edges(spark, sf_dir))


@query(
    f", {NUMBERS}, w AS MATERIALIZED ({WINDOWED}), c AS (SELECT a.col, a.row, a.id AS a, b.id AS b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM w a JOIN w b ON a.col = b.col AND a.row = b.row AND a.id <> b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2500), "
    "k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY col, row, a ORDER BY d, b) <= 8) SELECT DISTINCT col, row, 'SN' AS kind, 'poi' AS src_type, src, 'poi' AS dst_type, dst, sqrt(d) AS distance FROM (SELECT col, row, a AS src, b AS dst, d FROM k UNION ALL SELECT col, row, b, a, d FROM k)"
)
def relation_sn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest points of each window, ranked within it."""
    return relations.nearest(seen_points(spark, sf_dir), {"poi": 50}, {"poi": 8}, ["col", "row"])


def seen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = observations.points_in_windows(grid.in_groups(layout(spark, sf_dir, "points"), *map(F.col, "xyxy")))
    return points.select(*grid.GROUPED, "col", "row", F.lit("poi").alias("object_type"), "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))


# Clipped shapes, each as its edges; pairs are judged edge by edge and point by point, with no use of boxes' sides.
STREET_CUT = """SELECT id, col, row, xa + (xb - xa) * t0 AS px, ya + (yb - ya) * t0 AS py, xa + (xb - xa) * t1 AS qx, ya + (yb - ya) * t1 AS qy FROM (
SELECT *, greatest(0e0, CASE WHEN xb <> xa THEN least((col * 250 - 250 - xa) / (xb - xa)::DOUBLE, (col * 250 + 250 - xa) / (xb - xa)::DOUBLE) ELSE 0 END, CASE WHEN yb <> ya THEN least((row * 250 - 250 - ya) / (yb - ya)::DOUBLE, (row * 250 + 250 - ya) / (yb - ya)::DOUBLE) ELSE 0 END) AS t0,
least(1e0, CASE WHEN xb <> xa THEN greatest((col * 250 - 250 - xa) / (xb - xa)::DOUBLE, (col * 250 + 250 - xa) / (xb - xa)::DOUBLE) ELSE 1 END, CASE WHEN yb <> ya THEN greatest((row * 250 - 250 - ya) / (yb - ya)::DOUBLE, (row * 250 + 250 - ya) / (yb - ya)::DOUBLE) ELSE 1 END) AS t1
FROM (SELECT s.*, c.i AS col, r.i AS row FROM streets s JOIN span c ON least(xa, xb) <= c.i * 250 + 250 AND greatest(xa, xb) >= c.i * 250 - 250 JOIN span r ON least(ya, yb) <= r.i * 250 + 250 AND greatest(ya, yb) >= r.i * 250 - 250)) WHERE t0 < t1"""
SHAPES = f"""c AS MATERIALIZED ({CLIPPED}), e AS MATERIALIZED (SELECT * FROM ({STREET_CUT}) WHERE sqrt((qx - px) ** 2 + (qy - py) ** 2) > 0),
o AS MATERIALIZED (SELECT col, row, 'building' AS t, id, cx0::DOUBLE AS x0, cy0::DOUBLE AS y0, cx1::DOUBLE AS x1, cy1::DOUBLE AS y1, [[cx0, cy0, cx1, cy0], [cx1, cy0, cx1, cy1], [cx1, cy1, cx0, cy1], [cx0, cy1, cx0, cy0]]::DOUBLE[][] AS edges FROM c
UNION ALL SELECT col, row, 'road', id, least(px, qx), least(py, qy), greatest(px, qx), greatest(py, qy), [[px, py, qx, qy]] FROM e)"""
JOINED = """p AS MATERIALIZED (SELECT a.col, a.row, a.t AS ta, a.id AS a, b.t AS tb, b.id AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, a.edges AS ea, b.edges AS eb
FROM o a JOIN o b ON a.col = b.col AND a.row = b.row AND (a.t, a.id) < (b.t, b.id) AND a.x0 <= b.x1 + REACH AND b.x0 <= a.x1 + REACH AND a.y0 <= b.y1 + REACH AND b.y0 <= a.y1 + REACH),
f AS (SELECT *, unnest(ea) AS u, eb FROM p), g AS (SELECT *, unnest(eb) AS v FROM f),
m AS (SELECT *, (u[3] - u[1]) * (v[2] - u[2]) - (u[4] - u[2]) * (v[1] - u[1]) AS s1, (u[3] - u[1]) * (v[4] - u[2]) - (u[4] - u[2]) * (v[3] - u[1]) AS s2, (v[3] - v[1]) * (u[2] - v[2]) - (v[4] - v[2]) * (u[1] - v[1]) AS s3, (v[3] - v[1]) * (u[4] - v[2]) - (v[4] - v[2]) * (u[3] - v[1]) AS s4 FROM g),
x AS (SELECT *, (s1 >= 0 AND s2 <= 0 OR s1 <= 0 AND s2 >= 0) AND (s3 >= 0 AND s4 <= 0 OR s3 <= 0 AND s4 >= 0) AND least(u[1], u[3]) <= greatest(v[1], v[3]) AND least(v[1], v[3]) <= greatest(u[1], u[3]) AND least(u[2], u[4]) <= greatest(v[2], v[4]) AND least(v[2], v[4]) <= greatest(u[2], u[4]) AS crossing FROM m)"""
A_HOLDS, B_HOLDS = ("(ax0 <= bx0 AND ay0 <= by0 AND ax1 >= bx1 AND ay1 >= by1)", "(bx0 <= ax0 AND by0 <= ay0 AND bx1 >= ax1 AND by1 >= ay1)")
INT_PAIRS = f"""SELECT col, row, ta, a, tb, b FROM x GROUP BY ALL HAVING (bool_or(crossing) OR bool_or(ta = 'building' AND {A_HOLDS}) OR bool_or(tb = 'building' AND {B_HOLDS}))
AND NOT bool_or(ta = 'building' AND {A_HOLDS}) AND NOT bool_or(tb = 'building' AND {B_HOLDS}) AND NOT (bool_and(s1 = 0 AND s2 = 0) AND ta = 'road' AND tb = 'road' AND (bool_or({A_HOLDS}) OR bool_or({B_HOLDS})))"""


def street_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and slanting streets, as far as they lie in each window."""
    boxes, streets = layout(spark, sf_dir, "boxes"), layout(spark, sf_dir, "streets")
    parts = grid.parts_of(boxes, streets)
    boxes = grid.in_groups(boxes, *map(F.col, near.BOX), parts=parts)
    streets = observations.segments_in_groups(streets, parts)
    return relations.pieces(observations.clip_boxes(boxes), observations.clip_segments(streets))


@query(
    f", {WIDE}, {ROADS}, {SHAPES}, {JOINED.replace('REACH', '0')}, i AS ({INT_PAIRS}) SELECT col, row, 'INT' AS kind, ta AS src_type, a AS src, tb AS dst_type, b AS dst, NULL::DOUBLE AS distance FROM i UNION ALL SELECT col, row, 'INT', tb, b, ta, a, NULL FROM i"
)
def relation_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.shape_intersections(street_pieces(spark, sf_dir))


POINT_EDGE = "CASE WHEN L2 = 0 THEN 0 ELSE greatest(0, least(1, ((PX - E[1]) * (E[3] - E[1]) + (PY - E[2]) * (E[4] - E[2])) / L2)) END"


def _from_edge(px: str, py: str, e: str) -> str:
    length = f"(({e}[3] - {e}[1]) * ({e}[3] - {e}[1]) + ({e}[4] - {e}[2]) * ({e}[4] - {e}[2]))"
    t = POINT_EDGE.replace("PX", px).replace("PY", py).replace("L2", length).replace("E[", f"{e}[")
    return f"(({px} - ({e}[1] + ({t}) * ({e}[3] - {e}[1]))) ** 2 + ({py} - ({e}[2] + ({t}) * ({e}[4] - {e}[2]))) ** 2)"


@query(
    f", {WIDE}, {ROADS}, {SHAPES}, {JOINED.replace('REACH', '100')}, d AS (SELECT col, row, ta, a, tb, b, CASE WHEN bool_or(crossing) OR bool_or(ta = 'building' AND {A_HOLDS}) OR bool_or(tb = 'building' AND {B_HOLDS}) THEN 0 ELSE min(least({_from_edge('u[1]', 'u[2]', 'v')}, {_from_edge('u[3]', 'u[4]', 'v')}, {_from_edge('v[1]', 'v[2]', 'u')}, {_from_edge('v[3]', 'v[4]', 'u')})) END AS d FROM x GROUP BY ALL), "
    "h AS (SELECT col, row, ta, a, tb, b, d FROM d WHERE d <= 10000 UNION ALL SELECT col, row, tb, b, ta, a, d FROM d WHERE d <= 10000), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY col, row, ta, a ORDER BY round(d, 6), tb, b) <= 16) "
    "SELECT DISTINCT col, row, 'SN' AS kind, st AS src_type, s AS src, dt AS dst_type, e AS dst, round(sqrt(d), 6) AS distance FROM (SELECT col, row, ta AS st, a AS s, tb AS dt, b AS e, d FROM k UNION ALL SELECT col, row, tb, b, ta, a, d FROM k)"
)
def relation_sn_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and slanting streets of each window in one pool of candidates, by the distance of the clipped shapes."""
    found = relations.nearest(street_pieces(spark, sf_dir), {"building": 100, "road": 100}, {"building": 16, "road": 16}, ["col", "row"])
    return found.withColumn("distance", F.round("distance", 6))


CONTAINED = "SELECT c.col, c.row, c.id AS a, p.id AS b FROM c JOIN w p ON p.col = c.col AND p.row = c.row AND p.x BETWEEN cx0 AND cx1 AND p.y BETWEEN cy0 AND cy1"


@query(f", {NUMBERS}, {WIDE}, w AS ({WINDOWED}), c AS ({CLIPPED}), p AS ({CONTAINED}) SELECT col, row, 'CNT' AS kind, 'building' AS src_type, a AS src, 'poi' AS dst_type, b AS dst, NULL::DOUBLE AS distance FROM p UNION ALL SELECT col, row, 'WIT', 'poi', b, 'building', a, NULL FROM p")
def relation_cnt_wit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.containment(*boxes_and_points(spark, sf_dir))


def boxes_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both in their windows, and with the groups of those."""
    boxes, points = layout(spark, sf_dir, "boxes"), layout(spark, sf_dir, "points")
    parts = grid.parts_of(boxes, points)
    return observations.clip_boxes(grid.in_groups(boxes, *map(F.col, near.BOX), parts=parts)), observations.points_in_windows(grid.in_groups(points, *map(F.col, "xyxy"), parts=parts))


MEETING = """SELECT a.col, a.row, 'INT' AS kind, 'building' AS src_type, a.id AS src, 'building' AS dst_type, b.id AS dst, NULL::DOUBLE AS distance FROM c a JOIN c b ON a.col = b.col AND a.row = b.row AND a.id <> b.id AND a.cx0 <= b.cx1 AND b.cx0 <= a.cx1 AND a.cy0 <= b.cy1 AND b.cy0 <= a.cy1
WHERE NOT (a.cx0 <= b.cx0 AND a.cy0 <= b.cy0 AND a.cx1 >= b.cx1 AND a.cy1 >= b.cy1) AND NOT (b.cx0 <= a.cx0 AND b.cy0 <= a.cy0 AND b.cx1 >= a.cx1 AND b.cy1 >= a.cy1)"""


@query(
    f", {NUMBERS}, {WIDE}, {ROADS}, w AS MATERIALIZED ({WINDOWED}), c AS MATERIALIZED ({CLIPPED}), e AS MATERIALIZED ({EDGES}), p AS ({CONTAINED}), rel AS MATERIALIZED (({MEETING}) UNION ALL ({CONNECTED}) UNION ALL SELECT col, row, 'CNT', 'building', a, 'poi', b, NULL FROM p UNION ALL SELECT col, row, 'WIT', 'poi', b, 'building', a, NULL FROM p), "
    "n AS (SELECT col, row, 'building' AS t, id FROM c UNION ALL SELECT col, row, 'road', id FROM e UNION ALL SELECT col, row, 'poi', id FROM w), ends AS (SELECT DISTINCT col, row, src_type AS t, src AS id FROM rel) "
    "SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'duplicate_nodes', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM n)) FROM n UNION ALL SELECT 'isolated_nodes', count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM ends) UNION ALL SELECT 'dangling_nodes', count(*) FROM (SELECT * FROM ends EXCEPT SELECT * FROM n) "
    "UNION ALL SELECT 'edges', count(*) FROM rel UNION ALL SELECT 'duplicate_edges', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rel)) FROM rel UNION ALL SELECT 'self_loops', count(*) FROM rel WHERE src = dst AND src_type = dst_type UNION ALL SELECT 'forbidden_pairs', count(*) FROM rel WHERE src_type IN ('poi', 'road') AND dst_type IN ('poi', 'road') AND src_type <> dst_type"
)
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    (boxes, points), roads = boxes_and_points(spark, sf_dir), edges(spark, sf_dir)
    nodes = boxes.select("col", "row", F.lit("building").alias("object_type"), "id").union(roads.select("col", "row", F.lit("road"), "id")).union(points.select("col", "row", F.lit("poi"), "id"))
    return relations.graph_metrics(nodes, relations.intersections(boxes).unionByName(relations.connections(roads)).unionByName(relations.containment(boxes, points)))


OWN = lambda side: f"sha256({WINDOW_ID} || '|' || {side}_type || '|' || {side})"


@query(
    f", {ROADS}, e AS ({EDGES}), r AS ({CONNECTED}), i AS (SELECT *, {WINDOW_ID} AS w FROM r), o AS (SELECT *, {canonical_sql(repr('relation_context_id'), 'w', repr('original'), 'NULL::VARCHAR', repr('g1'))} AS context, {OWN('src')} AS s, {OWN('dst')} AS d FROM i) SELECT col, row, src, dst, {canonical_sql(repr('relation_id'), 'context', 's', 'd', 'kind')} AS relation_id FROM o"
)
def relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of connections, under the context of their window, in the order of relations."""
    return relations.in_order(relations.connections(edges(spark, sf_dir)), window_id(), "g1").select("col", "row", "src", "dst", "relation_id")


JUDGED = """n AS (SELECT w.col, w.row, d.split, u.i * 1000 < w.col * 250 + 250 AND (u.i + 1) * 1000 > w.col * 250 - 250 AND v.i * 1000 < w.row * 250 + 250 AND (v.i + 1) * 1000 > w.row * 250 - 250 AS inside,
greatest(u.i * 1000 - (w.col * 250 + 250), w.col * 250 - 250 - (u.i + 1) * 1000, 0) ** 2 + greatest(v.i * 1000 - (w.row * 250 + 250), w.row * 250 - 250 - (v.i + 1) * 1000, 0) ** 2 AS square
FROM w JOIN numbers u ON u.i * 1000 <= w.col * 250 + 375 AND (u.i + 1) * 1000 >= w.col * 250 - 375 JOIN numbers v ON v.i * 1000 <= w.row * 250 + 375 AND (v.i + 1) * 1000 >= w.row * 250 - 375
JOIN districts d ON d.cx = ((u.i % 5) + 5) % 5 AND d.cy = ((v.i % 5) + 5) % 5),
j AS (SELECT col, row, count(DISTINCT split) FILTER (inside) AS own, count(DISTINCT split) FILTER (inside OR square < 15625) AS near, min(split) FILTER (inside) AS first FROM n GROUP BY 1, 2),
q AS (SELECT col, row, CASE WHEN own > 1 THEN 'across splits' WHEN near > 1 THEN 'too near another split' END AS reason, CASE WHEN near = 1 THEN first END AS split FROM j)"""


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), {JUDGED} SELECT col, row, split, reason FROM q")
def allowable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that their split's region covers when a margin of 125 around all other splits is taken off; the others with what rules them out."""
    windows = observations.points_in_windows(layout(spark, sf_dir, "points")).select("col", "row").distinct()
    return observations.allowable_windows(windows, layout(spark, sf_dir, "districts"))


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), {JUDGED} SELECT split, reason, count(*) AS windows FROM q GROUP BY 1, 2")
def window_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.rejections(allowable_windows(spark, sf_dir))


NAMED = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END"


@query(f", {WIDE}, c AS (SELECT DISTINCT id, col, row FROM (SELECT b.id, c.i AS col, r.i AS row FROM boxes b JOIN wide c ON b.x0 <= c.i * 250 + 250 AND b.x1 >= c.i * 250 - 250 JOIN wide r ON b.y0 <= r.i * 250 + 250 AND b.y1 >= r.i * 250 - 250) WHERE col = row) SELECT col, row, id, sha256('b|' || k) AS object_id FROM c LEFT JOIN (SELECT {NAMED} AS k FROM orders) ON k = id")
def candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that meet the windows of the diagonal, with their identities; every fifth has none."""
    boxes, known = layout(spark, sf_dir, "boxes"), table(spark, sf_dir, "orders").select(F.expr(NAMED).alias("id")).filter("id IS NOT NULL")
    diagonal = grid.windows_of(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).filter("col = row").select("col", "row")
    return observations.query_candidates(boxes, diagonal, known.withColumn("object_id", ids.observation_hash(F.lit("b"), F.col("id"))))


@query(
    f", {WIDE}, {ROADS}, c AS ({CLIPPED}), e AS ({EDGES}), n AS (SELECT col, row FROM c UNION ALL SELECT col, row FROM e), k AS (SELECT col, row, count(*) AS objects FROM n GROUP BY 1, 2), d AS (SELECT col, row, node, count(*) AS d FROM (SELECT col, row, start_node AS node FROM e UNION ALL SELECT col, row, end_node FROM e) GROUP BY ALL), "
    "s AS (SELECT col, row, CAST(sum(d * (d - 1) // 2) AS BIGINT) AS connections FROM d GROUP BY 1, 2) SELECT col, row, objects, coalesce(connections, 0) AS connections, objects * (objects - 1) // 2 AS pairs, objects + objects * (objects - 1) // 2 + coalesce(connections, 0) AS cost FROM k LEFT JOIN s USING (col, row)"
)
def relation_cost_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = edges(spark, sf_dir)
    nodes = observations.clip_boxes(layout(spark, sf_dir, "boxes")).select("col", "row").union(roads.select("col", "row"))
    ends = roads.select("col", "row", "id", F.explode(F.array("start_node", "end_node")).alias("node"))
    return relations.relation_costs(nodes, ends)


@query(f", {NUMBERS}, p AS ({WINDOWED}), w AS (SELECT DISTINCT col, row FROM p), m AS ({MAPPED}), s AS ({SPLITS}) SELECT 'poi' AS object_type, id, count(DISTINCT split) AS splits, string_agg(DISTINCT split, '|' ORDER BY split) AS split_key FROM p JOIN s USING (col, row) GROUP BY id HAVING count(DISTINCT split) > 1")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations.points_in_windows(layout(spark, sf_dir, "points")).withColumn("object_type", F.lit("poi"))
    return audits.leakage(seen, observations.split_of_windows(mapped(spark, sf_dir)))


@query(
    f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), m AS ({MAPPED}), s AS (SELECT col + CASE WHEN split = 'test' THEN 1000000 ELSE 0 END AS col, row, split FROM m QUALIFY row_number() OVER (PARTITION BY m.col, m.row ORDER BY area DESC, district) = 1), t AS (SELECT col, row, district, split FROM m UNION ALL SELECT col, row, district, split FROM m WHERE split = 'validation') "
    "SELECT count(*) AS rows, count_if(s.split IS NULL) AS unknown, coalesce(count_if(s.split <> t.split), 0) AS mismatched, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates FROM t LEFT JOIN s USING (col, row)"
)
def split_mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping that lists one split's rows twice, against splits by primary district of which the test windows lie elsewhere."""
    mapping_ = mapped(spark, sf_dir)
    expected = mapping_.filter("is_primary").select((F.col("col") + F.when(F.col("split") == "test", 1_000_000).otherwise(0)).alias("col"), "row", "split")
    return audits.split_mapping_audit(mapping_.union(mapping_.filter("split = 'validation'")), expected)


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), m AS ({MAPPED}), s AS (SELECT col, row, split FROM m QUALIFY row_number() OVER (PARTITION BY col, row ORDER BY area DESC, district) = 1) SELECT a.split AS split_a, b.split AS split_b, count(*) AS pairs FROM s a JOIN s b ON a.split < b.split AND abs(a.col - b.col) < 2 AND abs(a.row - b.row) < 2 GROUP BY 1, 2")
def cross_split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every window in its primary district's split, as if windows across splits had not been left out."""
    return audits.cross_split_overlaps(mapped(spark, sf_dir).filter("is_primary").select("col", "row", "split"))


BROKEN = "CASE WHEN id % 97 = 0 THEN -to_node ELSE to_node END"


@query(
    f", l AS (SELECT from_node, xa, ya, {BROKEN} AS to_node, xb + CASE WHEN id % 13 = 0 THEN 0.5 ELSE 0 END AS xb, yb FROM links), e AS (SELECT from_node AS node, xa AS ex, ya AS ey FROM l UNION ALL SELECT to_node, xb, yb FROM l), g AS (SELECT e.node, n.x, sqrt((ex - x) ** 2 + (ey - y) ** 2) AS gap FROM e LEFT JOIN nodes n ON n.id = e.node) "
    "SELECT 'endpoints' AS metric, count(*) AS value FROM g UNION ALL SELECT 'missing_nodes', count_if(x IS NULL) FROM g UNION ALL SELECT 'used_nodes', count(DISTINCT node) FROM g UNION ALL SELECT 'self_loops', count_if(from_node = to_node) FROM l UNION ALL SELECT 'isolated_nodes', count(*) FROM nodes WHERE id NOT IN (SELECT node FROM e)"
    + "".join(f" UNION ALL SELECT 'within_{t}', coalesce(count_if(gap <= {t}), 0) FROM g" for t in ("0", "0.01", "0.1", "1", "10"))
)
def endpoint_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over links of which some name no node and some end beside theirs."""
    links = layout(spark, sf_dir, "links").withColumn("to_node", F.expr(BROKEN)).withColumn("xb", F.col("xb") + F.when(F.col("id") % 13 == 0, 0.5).otherwise(0.0))
    return profiles.endpoint_integrity(links, layout(spark, sf_dir, "nodes"))


PART_ID = canonical_sql(repr("clip_part_id"), repr("LineString"), "sha256(concat_ws('|', CAST(px AS BIGINT), CAST(py AS BIGINT), CAST(qx AS BIGINT), CAST(qy AS BIGINT)))", "'0'")


@query(
    f", {NUMBERS}, {WIDE}, {ROADS}, w AS ({WINDOWED}), c AS ({CLIPPED}), e AS ({EDGES}), u AS (SELECT 'building' AS object_type, id, col, row, '' AS part FROM c UNION ALL SELECT 'road', id, col, row, '|' || {PART_ID} FROM e UNION ALL SELECT 'poi', id, col, row, '' FROM w) SELECT object_type, id, col, row, sha256({WINDOW_ID} || '|' || object_type || '|' || id || part) AS observation_id FROM u"
)
def provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.concat_ws("|", *(F.col(c).cast("long") for c in ("px", "py", "qx", "qy")))
    roads = edges(spark, sf_dir).withColumn("part_id", ids.clip_part_id(F.lit("LineString"), F.sha2(corners, 256), F.lit(0)))
    return observations.provenance(window_id(), building=observations.clip_boxes(layout(spark, sf_dir, "boxes")), road=roads, poi=observations.points_in_windows(layout(spark, sf_dir, "points")))


BEFORE, AFTER = ("CASE WHEN KEY % 9 = 2 THEN -KEY ELSE KEY END", "CASE WHEN KEY % 9 = 4 THEN -KEY ELSE KEY END")
BEFORE_ORDER, AFTER_ORDER = (e.replace("KEY", "o_orderkey") for e in (BEFORE, AFTER))


@query(
    f"b AS (SELECT sha256('o|' || {BEFORE_ORDER}) AS k, o_orderstatus || chr(31) || o_orderpriority AS l FROM orders), a AS (SELECT sha256('o|' || {AFTER_ORDER}) AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END || chr(31) || o_orderpriority AS r FROM orders) "
    "SELECT substr(k, 1, 2) AS bucket, count_if(r IS NULL) AS missing, count_if(l IS NULL) AS extra, coalesce(count_if(l <> r), 0) AS different FROM b FULL JOIN a USING (k) GROUP BY 1"
)
def provenance_lineage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold every order; some go by another key on one of them, so that they are missing there and extra here."""
    orders = table(spark, sf_dir, "orders")
    side = lambda key: orders.withColumn("k", ids.observation_hash(F.lit("o"), F.expr(key)))
    found = side(AFTER_ORDER).withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END"))
    return audits.lineage_diff(side(BEFORE_ORDER), found, "k", ["o_orderstatus", "o_orderpriority"])


CHANGED = {"s_acctbal": "CASE WHEN s_suppkey % 4 = 1 THEN s_acctbal + 1 ELSE s_acctbal END", "s_name": "CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE s_name END"}
BEFORE_KEY, AFTER_KEY = (e.replace("KEY", "s_suppkey") for e in (BEFORE, AFTER))


@query(
    f"b AS (SELECT {BEFORE_KEY} AS k, s_name, s_acctbal FROM supplier), a AS (SELECT {AFTER_KEY} AS k, {CHANGED['s_name']} AS s_name, {CHANGED['s_acctbal']} AS s_acctbal FROM supplier), "
    "j AS (SELECT coalesce(b.k, a.k) AS key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.s_name IS DISTINCT FROM b.s_name OR a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 'changed' END AS change, "
    "array_to_string(list_filter([CASE WHEN a.s_name IS DISTINCT FROM b.s_name THEN 's_name' END, CASE WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 's_acctbal' END], lambda x: x IS NOT NULL), ',') AS f FROM b FULL JOIN a ON a.k = b.k) SELECT key, change, CASE WHEN change = 'changed' THEN f ELSE '' END AS fields FROM j WHERE change IS NOT NULL"
)
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold every supplier; some go by another key on one of them."""
    supplier = table(spark, sf_dir, "supplier")
    before = supplier.select(F.expr(BEFORE_KEY).alias("k"), "s_name", "s_acctbal")
    return audits.snapshot_diff(before, supplier.select(F.expr(AFTER_KEY).alias("k"), *(F.expr(e).alias(c) for c, e in CHANGED.items())), "k", ["s_name", "s_acctbal"])


@query(f", {NUMBERS}, w AS (SELECT DISTINCT col, row FROM ({WINDOWED})), m AS ({MAPPED}), s AS ({SPLITS}) SELECT col, row, split, row_number() OVER (PARTITION BY split ORDER BY col, row) AS rank FROM s QUALIFY rank <= 3")
def window_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.select_windows(observations.split_of_windows(mapped(spark, sf_dir)), 3)


@query("SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 512 AS shard FROM orders")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.shard_plan(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 512)


@query(", m AS (SELECT avg(cx) AS mx, avg(cy) AS my FROM districts), d AS (SELECT district, cx, cy, round(sqrt((cx - mx) ** 2 + (cy - my) ** 2), 6) AS distance FROM districts, m) SELECT *, ntile(3) OVER (ORDER BY distance, district) - 1 AS band FROM d")
def radial_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.radial_bands(layout(spark, sf_dir, "districts").select("district", "cx", "cy"), "cx", "cy", "district")


@query("c AS (SELECT user_id % 25 AS zone, event_type AS code, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), t AS (SELECT zone, sum(n) AS total FROM c GROUP BY 1) SELECT zone, string_agg(code || '=' || n, ',' ORDER BY code) AS codes, round(-sum(n / total * ln(n / total)), 6) AS entropy FROM c JOIN t USING (zone) GROUP BY 1")
def zonal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("zone"), "event_type")
    out = zonal.histogram(cells, "zone", "event_type")
    shown = F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("entropy", F.round(zonal.entropy(F.col("codes")), 6)).withColumn("codes", shown)


@query("SELECT user_id % 25 AS zone, count(*) AS cells, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events WHERE value IS NOT NULL GROUP BY 1")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("zone"), "value")
    out = zonal.statistics(cells, "zone", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75", "mean", "std")})


@query("SELECT CASE WHEN (user_id % 25) % 5 < 3 THEN 'train' WHEN (user_id % 25) % 5 = 3 THEN 'validation' ELSE 'test' END AS split, count(DISTINCT user_id % 25) AS zones, count(*) AS weight, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events WHERE value IS NOT NULL GROUP BY 1")
def pooled_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-split mean and deviation from the zones' own; the SQL takes them from the values."""
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("district"), "value")
    zones = zonal.statistics(cells, "district", "value").join(layout(spark, sf_dir, "districts").select("district", "split"), "district")
    return zonal.pooled(zones, "split").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


WAVES = "[" + ", ".join(f"{w!r}::DOUBLE" for w in codes.WAVELENGTHS) + "]"


@query(f"SELECT id, list_transform(flatten(list_transform({WAVES}, lambda w: [sin((x % 500 - 250) * (2 * pi() / w)), cos((x % 500 - 250) * (2 * pi() / w)), sin((y % 500 - 250) * (2 * pi() / w)), cos((y % 500 - 250) * (2 * pi() / w))])), lambda v: round(v, 6) + 0.0::DOUBLE) AS code FROM points")
def relative_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = layout(spark, sf_dir, "points")
    code = codes.relative_code(F.col("x") % 500 - 250, F.col("y") % 500 - 250)
    return points.select("id", F.transform(code, lambda v: F.round(v, 6) + F.lit(0.0)).alias("code"))


ALL = list(codes.FREQUENCIES)


def _turn(u: float, v: float) -> str:
    return f"(-2 * pi() * ({u!r}::DOUBLE * mx + {v!r}::DOUBLE * my))"


def _wave(u: float, v: float) -> str:
    t = f"({u!r}::DOUBLE * dx + {v!r}::DOUBLE * dy)"
    return f"(len * CASE WHEN abs({t}) < 1e-12 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) END)"


@query(
    ", s AS (SELECT id, (xb - xa) / 500e0 AS dx, (yb - ya) / 500e0 AS dy, (xa % 500 + (xb - xa) / 2e0) / 500e0 AS mx, (ya % 500 + (yb - ya) / 2e0) / 500e0 AS my, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) / 500e0 AS len FROM links) "
    f"SELECT id, list_transform([{', '.join(f'{_wave(u, v)} * cos({_turn(u, v)})' for u, v in ALL)}], lambda v: round(v, 6) + 0e0) AS re, list_transform([{', '.join(f'{_wave(u, v)} * sin({_turn(u, v)})' for u, v in ALL)}], lambda v: round(v, 6) + 0e0) AS im FROM s"
)
def segment_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of links at all frequencies, from the corner of the square that holds their start."""
    x, y = F.col("xa") % 500, F.col("ya") % 500
    z = codes.segment_fourier(x / 500, y / 500, (x + F.col("xb") - F.col("xa")) / 500, (y + F.col("yb") - F.col("ya")) / 500, ALL, 6)
    return layout(spark, sf_dir, "links").select("id", z.alias("z")).select("id", "z.re", "z.im")


PAIRS = 32


@query(
    f"v AS (SELECT vec_id, list_transform(range(1, {2 * PAIRS}, 2), lambda i: embedding[i]::DOUBLE) AS re, list_transform(range(2, {2 * PAIRS} + 1, 2), lambda i: embedding[i]::DOUBLE) AS im FROM embeddings) SELECT vec_id, list_transform(range(1, {PAIRS + 1}), lambda i: round(ln(1 + sqrt(re[i] * re[i] + im[i] * im[i])), 6)) AS magnitude, "
    f"list_transform(range(1, {PAIRS + 1}), lambda i: round(CASE WHEN sqrt(re[i] * re[i] + im[i] * im[i]) <= 1e-7 THEN 1 ELSE cos(atan2(im[i], re[i])) END, 6) + 0e0) || list_transform(range(1, {PAIRS + 1}), lambda i: round(CASE WHEN sqrt(re[i] * re[i] + im[i] * im[i]) <= 1e-7 THEN 0 ELSE sin(atan2(im[i], re[i])) END, 6) + 0e0) AS phase FROM v"
)
def magnitude_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as complex numbers, component by component in pairs."""
    z = F.transform(F.sequence(F.lit(1), F.lit(2 * PAIRS - 1), F.lit(2)), lambda i: F.struct(F.element_at("embedding", i).cast("double").alias("re"), F.element_at("embedding", i + 1).cast("double").alias("im")))
    zs = table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 6) + F.lit(0.0))
    return zs.select("vec_id", rounded(codes.magnitude(F.col("z"))).alias("magnitude"), rounded(codes.phase(F.col("z"))).alias("phase"))


@query("SELECT label, count(*) AS rows, count_if(len(embedding) <> 64) AS wrong_width, count_if(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS non_finite, count_if(len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings GROUP BY 1")
def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.embedding_quality(table(spark, sf_dir, "embeddings"), "embedding", "label", 64)


@query(f"i AS (SELECT p_brand AS brand, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN 'short' ELSE sha256(p_name) END AS v FROM part) SELECT brand, count(*) AS rows, count(*) - count(v) AS null_ids, coalesce(count_if(NOT regexp_matches(v, '^[0-9a-f]{{64}}$')), 0) AS bad_format, (SELECT count(*) FROM (SELECT v FROM i j WHERE j.brand = i.brand AND v IS NOT NULL GROUP BY v HAVING count(*) > 1)) AS duplicate_ids FROM i GROUP BY 1")
def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN 'short' ELSE sha2(p_name, 256) END")
    return audits.identity_audit(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), v.alias("v")), "brand", "v")


@query(f"d AS (SELECT {canonical_sql('CAST(p_partkey AS VARCHAR)', 'p_name', 'p_brand', 'p_type', 'CAST(p_size AS VARCHAR)', 'CAST(CAST(p_retailprice AS DECIMAL(18, 4)) AS VARCHAR)')} AS digest FROM part), n AS (SELECT digest, (row_number() OVER (ORDER BY digest) - 1) // 500 AS chunk FROM d), c AS (SELECT chunk, count(*) AS lines, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS h FROM n GROUP BY 1) SELECT CAST(sum(lines) AS BIGINT) AS rows, count(*) AS chunks, sha256(sha256('part' || chr(10) || 'v1') || chr(10) || string_agg(h, chr(10) ORDER BY chunk)) AS content_hash FROM c")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18, 4)"))
    return ids.content_hash(part, ["part", "v1"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], most_lines=500)


@query(f", {WIDE}, c AS ({CLIPPED}) SELECT id, col, row, round(((cx1 - cx0) * (cy1 - cy0))::DOUBLE, 6) AS area, round((cx0 + cx1) / 2, 6) AS x, round((cy0 + cy1) / 2, 6) AS y FROM c")
def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as WKB polygons, cut by the general kernel."""
    boxes = layout(spark, sf_dir, "boxes").withColumn("wkb", geometry.rectangle_wkb(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    wide = grid.windows_of(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    half = grid.SIZE / 2
    edges_ = [F.col(c) * grid.STRIDE + d for d in (-half, half) for c in ("col", "row")]
    cut = wide.withColumn("g", geometry.inspect(geometry.clip_wkb(F.col("wkb"), *edges_))).filter("g.kind IS NOT NULL")
    return cut.select("id", "col", "row", *(F.round(f"g.{c}", 6).alias(n) for c, n in (("measure", "area"), ("x", "x"), ("y", "y"))))


def _sinc(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-12 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"


@query(
    ", s AS (SELECT id, (x1 - x0) / 500e0 AS w, (y1 - y0) / 500e0 AS h FROM boxes) SELECT id, list_transform(["
    + ", ".join(f"w * h * ({_sinc(f'({u!r}::DOUBLE * w)')}) * ({_sinc(f'({v!r}::DOUBLE * h)')})" for u, v in ALL)
    + f"], lambda v: round(v, 6) + 0e0) AS re, list_transform(range({len(ALL)}), lambda v: 0e0) AS im FROM s"
)
def polygon_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of the boxes, summed over triangles; the SQL has the closed form of a rectangle about its centre, which has no imaginary part."""
    boxes = grid.spread_out(layout(spark, sf_dir, "boxes"), "id").withColumn("wkb", geometry.rectangle_wkb(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return boxes.select("id", geometry.fourier(F.col("wkb"), ALL, 6).alias("z")).select("id", "z.re", "z.im")


@query("SELECT count(*) AS features, 0 AS null_geometries, 0 AS unreadable, 'polygon' AS kinds, 0 AS multipart, CAST(5 * count(*) AS BIGINT) AS vertices, sum((x1 - x0) * (y1 - y0))::DOUBLE AS measure, min(x0)::DOUBLE AS xmin, min(y0)::DOUBLE AS ymin, max(x1)::DOUBLE AS xmax, max(y1)::DOUBLE AS ymax FROM boxes")
def layer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout(spark, sf_dir, "boxes").select(geometry.rectangle_wkb(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry_wkb"))
    return layers.layer_metadata(boxes)


def district_objective(spark: SparkSession, sf_dir: str, plan: splits.Plan) -> splits.Objective:
    """Nations as districts of the plane, with what customers, suppliers, orders and parts say of each."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("price"))
    people = customer.join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("district")).agg(
        F.count("*").alias("buildings"), (F.coalesce(F.sum("price"), F.lit(0.0)) / 1e6).alias("road_length"), F.coalesce(F.sum("orders"), F.lit(0)).alias("windows"), F.count("c_acctbal").alias("dem_cells"), F.avg("c_acctbal").alias("dem_mean"), F.stddev_pop("c_acctbal").alias("dem_std"),
    )
    shops = supplier.groupBy(F.col("s_nationkey").alias("district")).agg(F.count("*").alias("pois"))
    frame = layout(spark, sf_dir, "districts").join(people, "district", "left").join(shops, "district", "left").fillna(0).orderBy("district").toPandas()
    frame["code"], frame["area"], frame["x"], frame["y"] = frame["district"].map("{:02d}".format), 1.0, frame["cx"] + 0.5, frame["cy"] + 0.5
    for kind, total in (("building", "buildings"), ("road", "road_length"), ("poi", "pois")):
        frame[f"{kind}_density"] = frame[total] / frame["area"]
    segments = customer.groupBy("c_nationkey").pivot("c_mktsegment").count().fillna(0).orderBy("c_nationkey").toPandas().set_index("c_nationkey").reindex(frame["district"], fill_value=0).to_numpy()
    bands = customer.withColumn("band", F.pmod(F.floor(F.col("c_acctbal") / 1000), F.lit(4))).groupBy("c_nationkey").pivot("band", [0, 1, 2, 3]).count().fillna(0).toPandas().set_index("c_nationkey").reindex(frame["district"], fill_value=0).to_numpy()
    gap = np.maximum(np.abs(np.subtract.outer(frame["cx"].to_numpy(), frame["cx"].to_numpy())), np.abs(np.subtract.outer(frame["cy"].to_numpy(), frame["cy"].to_numpy())))
    return splits.Objective(frame, segments, bands, (gap == 1).astype(float), plan)


@query()
def split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 50,000 seeded splits of the districts into 15, 5 and 5."""
    return splits.assignment(splits.search(spark, district_objective(spark, sf_dir, splits.Plan())))


SQUARE = 1000


@query(f", p AS (SELECT x % {TILE} AS x, y FROM points) SELECT district, count(p.x) AS points FROM districts LEFT JOIN p ON x > cx * {SQUARE} AND x < (cx + 1) * {SQUARE} AND y > cy * {SQUARE} AND y < (cy + 1) * {SQUARE} GROUP BY 1")
def district_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all tiles, laid over one another, strictly within each district's polygon."""
    points = layout(spark, sf_dir, "points").select((F.col("x") % TILE).alias("x"), "y")
    edges_ = {"xmin": F.col("cx") * SQUARE, "ymin": F.col("cy") * SQUARE, "xmax": (F.col("cx") + 1) * SQUARE, "ymax": (F.col("cy") + 1) * SQUARE}
    polygons = layout(spark, sf_dir, "districts").select("district", *(c.alias(n) for n, c in edges_.items()))
    polygons = polygons.withColumn("geometry_wkb", geometry.rectangle_wkb(*(F.col(c) for c in edges_)))
    return spatial.point_counts(points, polygons, "district", SQUARE)


@query(
    f", {ROADS}, c AS (SELECT u.i AS cx, v.i AS cy, greatest(xa, u.i * {SQUARE}) AS px, greatest(ya, v.i * {SQUARE}) AS py, least(xb, (u.i + 1) * {SQUARE}) AS qx, least(yb, (v.i + 1) * {SQUARE}) AS qy FROM links JOIN span u ON xa <= (u.i + 1) * {SQUARE} AND xb >= u.i * {SQUARE} JOIN span v ON ya <= (v.i + 1) * {SQUARE} AND yb >= v.i * {SQUARE}) "
    "SELECT cx, cy, sum(qx - px + qy - py)::DOUBLE AS length FROM c WHERE qx > px OR qy > py GROUP BY 1, 2"
)
def district_road_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.lengths_by_square(layout(spark, sf_dir, "links"), SQUARE)


@query("SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return planning.stratified_sample(orders, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"])


@query(", b AS (SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points UNION ALL SELECT min(x0), min(y0), max(x1), max(y1) FROM boxes UNION ALL SELECT min(x), min(y), max(x), max(y) FROM nodes), s AS (SELECT max(xmin) AS xmin, max(ymin) AS ymin, min(xmax) AS xmax, min(ymax) AS ymax FROM b) SELECT *, xmin > xmax OR ymin > ymax AS empty FROM s")
def common_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that points, boxes and nodes share."""
    extent = lambda name, x0, y0, x1, y1: layout(spark, sf_dir, name).agg(F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))
    return spatial.common_box(extent("points", "x", "y", "x", "y").union(extent("boxes", "x0", "y0", "x1", "y1")).union(extent("nodes", "x", "y", "x", "y")))


@query(
    "SELECT code, severity, metric, value FROM (SELECT 'K1' AS code, 'error' AS severity, 'missing' AS metric, count_if(c_custkey IS NULL)::DOUBLE AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'K2', 'warning', 'repeated', (count(*) - count(DISTINCT o_custkey))::DOUBLE FROM orders UNION ALL SELECT 'K3', 'note', 'orders', count(*)::DOUBLE FROM orders) WHERE value > 0"
)
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    known = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    one = known.agg(F.coalesce(F.sum(F.when(F.col("c_custkey").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("n").alias("orders"))
    some = F.col("value") > 0
    return planning.assess(planning.melt(one), [("K1", "error", "missing", some), ("K2", "warning", "repeated", some), ("K3", "note", "orders", some)])
