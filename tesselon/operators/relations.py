"""Typed relations between the objects of a window, and their graph.

SN: nearest within a radius, by the distance of the shapes; CNT/WIT: a box covers a point, seen from either side; INT: two shapes meet and neither
covers the other; CON: road parts with a node in common. Directed rows (kind, src_type, src, dst_type, dst, distance).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid, ids, near, shapes

COLUMNS = ["kind", "src_type", "src", "dst_type", "dst", "distance"]
BOTH = [("a", "b"), ("b", "a")]


def nearest(objects: DataFrame, radius: dict[str, float], k: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """SN. Of each source the first k[type] others within radius[type], by distance, type and id; each choice gives both directions.

    objects: (object_type, id, x0, y0, x1, y1), points having x0 = x1 and y0 = y1; and, where some are segments, their
    ends (ax, ay, bx, by), null for boxes. Distances are between the shapes themselves. With ``keys`` (col, row) objects
    meet only within a window and are ranked for each, all windows of a group in one kernel; rows without an id, a type or a place
    are left out. Otherwise objects meet in cells as wide as the greatest radius, each source in the one cell of its lower corner and each candidate in
    every cell that its surroundings reach, so that no pair is found twice and nothing is compared across the plane.
    """
    if keys:
        return in_windows(objects, keys, F.lit("SN"), lambda t: near.nearest(t, keys, radius, k))
    keys = []
    side = max(radius.values())
    reach = F.coalesce(*(F.when(F.col("object_type") == t, F.lit(float(r))) for t, r in radius.items()))
    most = F.coalesce(*(F.when(F.col("object_type") == t, F.lit(n)) for t, n in k.items()))
    # The source's cells are those of its own extent; the owner is the pair's least common cell.
    spread = lambda a, b, d: F.sequence(F.floor((F.col(a) - d) / side).cast("long"), F.floor((F.col(b) + d) / side).cast("long"))
    source = objects.withColumn("r", reach).withColumn("k", most).filter("r IS NOT NULL")
    source = source.withColumn("cx", F.explode(spread("x0", "x1", 0))).withColumn("cy", F.explode(spread("y0", "y1", 0)))
    target = objects.withColumn("cx", F.explode(spread("x0", "x1", side))).withColumn("cy", F.explode(spread("y0", "y1", side)))
    s, t = source.alias("s"), target.alias("t")
    same = F.lit(True)
    for c in ["cx", "cy", *keys]:
        same = same & (F.col(f"s.{c}") == F.col(f"t.{c}"))
    owner = lambda axis: F.greatest(F.floor(F.col(f"s.{axis}0") / side), F.floor((F.col(f"t.{axis}0") - side) / side)) == F.col(f"s.c{axis}")
    gap = lambda axis: F.greatest(F.col(f"s.{axis}0") - F.col(f"t.{axis}1"), F.col(f"t.{axis}0") - F.col(f"s.{axis}1"), F.lit(0))
    square = gap("x") * gap("x") + gap("y") * gap("y")
    pairs = s.join(t, same & owner("x") & owner("y") & ((F.col("s.object_type") != F.col("t.object_type")) | (F.col("s.id") != F.col("t.id"))) & (square <= F.col("s.r") * F.col("s.r")))
    if "ax" in objects.columns:  # the boxes' distance is no greater, so it has been looked at first
        square = shapes.square_gap(shapes.Shape("s"), shapes.Shape("t"))
    pairs = pairs.select(*(F.col(f"s.{c}").alias(c) for c in keys), F.col("s.object_type").alias("a_type"), F.col("s.id").alias("a"), F.col("t.object_type").alias("b_type"), F.col("t.id").alias("b"), square.cast("double").alias("square"), F.col("s.k").alias("k"), F.col("s.r").alias("r"))
    pairs = pairs.filter("square <= r * r").drop("r")
    rank = Window.partitionBy(*keys, "a_type", "a").orderBy(F.round("square", 6), "b_type", "b")
    chosen = pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= max(k.values())).filter("rank <= k")
    return distinct_relations(both_ways(chosen.withColumn("distance", F.sqrt("square")), "SN", keys), keys)


def in_windows(objects: DataFrame, keys: list[str], kind: Column, kernel: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Relations that a kernel finds in the windows of each group. Objects of ``grid.in_groups`` aren't exchanged again."""
    used = ["object_type", "id", *near.BOX, *(near.LINE if "ax" in objects.columns else ())]
    sound = objects.filter(F.col("object_type").isNotNull() & F.col("id").isNotNull() & (F.abs(F.col("x0") + F.col("y0") + F.col("x1") + F.col("y1")).cast("double") < float("inf")))
    types = {f.name: f.dataType.simpleString() for f in objects.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "src_type string", f"src {types['id']}", "dst_type string", f"dst {types['id']}", "distance double"])
    found = grid.grouped(sound).select(*grid.GROUPED, *keys, *used).groupBy(*grid.GROUPED).applyInArrow(lambda t: kernel(t), schema)
    return found.select(*keys, kind.alias("kind"), "src_type", "src", "dst_type", "dst", "distance")


def both_ways(pairs: DataFrame, kind: str, keys: list[str] | None = None, back: str | None = None) -> DataFrame:
    """Each pair (a_type, a, b_type, b, distance) as two directed rows, the second of kind ``back`` if that is given."""
    rows = [F.struct(F.lit(kind if (a, b) == BOTH[0] else back or kind).alias("kind"), F.col(f"{a}_type").alias("src_type"), F.col(a).alias("src"), F.col(f"{b}_type").alias("dst_type"), F.col(b).alias("dst")) for a, b in BOTH]
    return pairs.select(*(keys or []), "distance", F.explode(F.array(*rows)).alias("r")).select(*(keys or []), "r.kind", "r.src_type", "r.src", "r.dst_type", "r.dst", "distance")


def distinct_relations(relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each directed key; of several the nearest."""
    return relations.groupBy(*(keys or []), "kind", "src_type", "src", "dst_type", "dst").agg(F.min("distance").alias("distance"))


def containment(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """CNT and WIT of clipped boxes and points that share a window (col, row); a box covers its boundary too."""
    keys, groups = ["col", "row"], [c for c in grid.GROUPED if c in boxes.columns and c in points.columns]
    shape = lambda df, kind, *corners: df.select(*groups, *keys, F.lit(kind).alias("object_type"), "id", *(F.col(c).cast("double").alias(n) for c, n in zip(corners, near.BOX)))
    both = shape(boxes, "building", "cx0", "cy0", "cx1", "cy1").union(shape(points, "poi", "x", "y", "x", "y"))
    return in_windows(both, keys, F.when(F.col("src_type") == "building", "CNT").otherwise("WIT"), lambda t: near.containment(t, keys, "building"))


def intersections(boxes: DataFrame) -> DataFrame:
    """INT of clipped boxes of a window: they meet, edges included, and neither covers the other."""
    return shape_intersections(boxes.select("col", "row", *(c for c in grid.GROUPED if c in boxes.columns), F.lit("building").alias("object_type"), "id", *(F.col(f"c{c}").alias(c) for c in near.BOX)))


def pieces(boxes: DataFrame, segments: DataFrame) -> DataFrame:
    """(col, row, object_type, id, x0, y0, x1, y1, ax, ay, bx, by): clipped boxes and clipped segments as shapes of their windows, with their groups if they have any."""
    groups = [c for c in grid.GROUPED if c in boxes.columns]
    none = [F.lit(None).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]
    building = boxes.select(*groups, "col", "row", F.lit("building").alias("object_type"), "id", *(F.col(f"c{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), *none)
    road = segments.select(
        *groups, "col", "row", F.lit("road"), "id", F.least("px", "qx").cast("double"), F.least("py", "qy").cast("double"), F.greatest("px", "qx").cast("double"), F.greatest("py", "qy").cast("double"),
        *(F.col(c).cast("double") for c in ("px", "py", "qx", "qy")),
    )
    return building.union(road)


def shape_intersections(objects: DataFrame) -> DataFrame:
    """INT of the shapes of a window, buildings and roads alike: they meet, touching included, and neither covers the other."""
    keys = ["col", "row"]
    return in_windows(objects, keys, F.lit("INT"), lambda t: near.intersections(t, keys))


def in_order(relations: DataFrame, context: Column, geometry_version: str) -> DataFrame:
    """Relations with their identities, in the order of window, source, target, kind and identity.

    context: a window's identity from col and row. Sources and targets are identified as observations of the window."""
    own = lambda side: ids.observation_id(context, F.col(f"{side}_type"), F.col(side))
    # The identity follows from what comes before it in the order, so it is worked out afterwards, once for each row and in many tasks.
    order = ["col", "row", "src_type", "src", "dst_type", "dst", "kind"]
    ordered = relations.repartitionByRange(grid.parts_of(relations), *order).sortWithinPartitions(*order)
    return ordered.withColumn("relation_id", ids.relation_id(ids.relation_context_id(context, geometry_version), own("src"), own("dst"), F.col("kind")))


def connections(edges: DataFrame) -> DataFrame:
    """CON of road parts of a window that share a node; a boundary node belongs to one part, so it connects nothing."""
    keys, parts = ["col", "row"], grid.parts_of(edges)
    ends = edges.select(*keys, "id", F.explode(F.array("start_node", "end_node")).alias("node")).filter("node LIKE 'n%'")
    ends = grid.spread_out(ends, *keys, "node", parts=parts).distinct()
    a, b = ends.alias("a"), ends.alias("b")
    pairs = a.join(b, (F.col("a.col") == F.col("b.col")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id")))
    # Parts may share both nodes. A pair is made distinct before it becomes two relations.
    pairs = grid.spread_out(pairs.select(*(F.col(f"a.{c}").alias(c) for c in keys), F.col("a.id").alias("a"), F.col("b.id").alias("b")), *keys, "a", "b", parts=parts).distinct()
    return both_ways(pairs.withColumns({"a_type": F.lit("road"), "b_type": F.lit("road"), "distance": F.lit(0.0)}), "CON", keys)


def graph_metrics(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(metric, value) of a graph: nodes (col, row, object_type, id) and relations; one pass over each and one exchange.

    Nodes, ends and edges are counted together: a node as itself, a relation as its two ends and as an edge. Unknown fields equal each other."""
    keys = ["edge", "col", "row", "object_type", "id", "kind", "dst_type", "dst"]
    kinds = {f.name: f.dataType for f in relations.schema}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("kind", "dst_type", "dst")]
    counts = lambda **of: [F.lit(of.get(c, 0)).cast("long").alias(c) for c in ("copies", "degree", "n")]
    end = lambda side: F.struct(F.lit(False).alias("edge"), F.col(f"{side}_type").alias("object_type"), F.col(side).alias("id"), *none, *counts(degree=1))
    edge = F.struct(F.lit(True).alias("edge"), F.col("src_type").alias("object_type"), F.col("src").alias("id"), "kind", "dst_type", "dst", *counts(n=1))
    parts = relations.select("col", "row", F.explode(F.array(end("src"), end("dst"), edge)).alias("e")).select("col", "row", "e.*")
    whole = nodes.select(F.lit(False).alias("edge"), "col", "row", "object_type", "id", *none, *counts(copies=1)).unionByName(parts)
    each = whole.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("copies", "degree", "n")))
    edge, known, n = F.col("edge"), F.col("copies") > 0, F.col("n")
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    one = each.agg(
        total(~edge, F.col("copies")).alias("nodes"), total(~edge & known, F.col("copies") - 1).alias("duplicate_nodes"), F.count_if(~edge & known & (F.col("degree") == 0)).alias("isolated_nodes"), F.count_if(~edge & ~known).alias("dangling_nodes"),
        total(edge, n).alias("edges"), total(edge, n - 1).alias("duplicate_edges"), total(edge & (F.col("object_type") == F.col("dst_type")) & (F.col("id") == F.col("dst")), n).alias("self_loops"),
        total(edge & (F.array_sort(F.array("object_type", "dst_type")) == F.array(F.lit("poi"), F.lit("road"))), n).alias("forbidden_pairs"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns))).alias("m")).select("m.*")


def relation_costs(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(col, row, objects, pairs, connections, cost): what the relations of a window will take.

    ends: (col, row, node, id) of road parts; a node of degree d gives d (d - 1) / 2 connections.
    """
    counts = nodes.groupBy("col", "row").agg(F.count("*").alias("objects"))
    degrees = ends.groupBy("col", "row", "node").agg(F.count("*").alias("d")).groupBy("col", "row").agg(F.sum((F.col("d") * (F.col("d") - 1) / 2).cast("long")).alias("connections"))
    joined = counts.join(degrees, ["col", "row"], "left").withColumn("connections", F.coalesce("connections", F.lit(0)))
    pairs = (F.col("objects") * (F.col("objects") - 1) / 2).cast("long")
    return joined.withColumn("pairs", pairs).withColumn("cost", F.col("objects") + F.col("pairs") + F.col("connections"))
