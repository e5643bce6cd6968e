"""Objects observed in windows: clips, parts, nodes. Windows are worked out from coordinates, so that nothing is joined by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid, ids

DISTRICT = 1000


def points_in_windows(points: DataFrame, size: float = grid.SIZE, stride: float = grid.STRIDE) -> DataFrame:
    """A row for each closed window that covers a point (x, y): in a corner as many as nine."""
    return grid.windows_of(points, F.col("x"), F.col("y"), F.col("x"), F.col("y"), size, stride)


def clip_boxes(boxes: DataFrame, size: float = grid.SIZE, stride: float = grid.STRIDE) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) cut to every window that they share area with; status is full or clipped."""
    wide = grid.windows_of(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, stride)
    half = size / 2
    col, row = F.col("col") * stride, F.col("row") * stride
    cut = wide.select(
        "id", "col", "row", *(c for c in grid.GROUPED if c in boxes.columns), F.greatest(F.col("x0"), col - half).alias("cx0"), F.greatest(F.col("y0"), row - half).alias("cy0"),
        F.least(F.col("x1"), col + half).alias("cx1"), F.least(F.col("y1"), row + half).alias("cy1"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("source_area"),
    )
    area = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    return (
        cut.filter("cx1 > cx0 AND cy1 > cy0").withColumn("area", area.cast("double"))
        .withColumn("status", F.when(F.col("area") == F.col("source_area"), "full").otherwise("clipped"))
        .withColumn("rep_x", (F.col("cx0") + F.col("cx1")) / 2).withColumn("rep_y", (F.col("cy0") + F.col("cy1")) / 2)
    )


def clip_segments(links: DataFrame, size: float = grid.SIZE, stride: float = grid.STRIDE) -> DataFrame:
    """Segments (id, xa, ya, xb, yb) cut to every window that they run through for some length.

    The part is what lies between the greatest entry and the least exit of the four half planes; a segment along a
    window's edge belongs to it, one that only touches a corner doesn't.
    """
    wide = grid.windows_of(links, F.least("xa", "xb"), F.least("ya", "yb"), F.greatest("xa", "xb"), F.greatest("ya", "yb"), size, stride)
    half = size / 2
    enters, leaves = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, centre in (("xa", "xb", F.col("col") * stride), ("ya", "yb", F.col("row") * stride)):
        step = (F.col(b) - F.col(a)).cast("double")
        t = [((centre + side - F.col(a)) / F.nullif(step, F.lit(0.0))) for side in (-half, half)]
        enters.append(F.coalesce(F.least(*t), F.lit(0.0)))
        leaves.append(F.coalesce(F.greatest(*t), F.lit(1.0)))
    cut = wide.withColumn("t0", F.greatest(*enters)).withColumn("t1", F.least(*leaves)).filter("t0 < t1")
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    cut = cut.withColumns({"px": at("xa", "xb", "t0"), "py": at("ya", "yb", "t0"), "qx": at("xa", "xb", "t1"), "qy": at("ya", "yb", "t1")})
    length = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))
    return cut.withColumns({"length": length, "mid_x": (F.col("px") + F.col("qx")) / 2, "mid_y": (F.col("py") + F.col("qy")) / 2}).filter("length > 0")


def segments_in_groups(links: DataFrame, parts: int | None = None) -> DataFrame:
    """Segments (xa, ya, xb, yb) partitioned by ``grid.in_groups``."""
    return grid.in_groups(links, *(f(a, b) for f in (F.least, F.greatest) for a, b in (("xa", "xb"), ("ya", "yb"))), parts=parts)


def order_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds part (from 0): within the keys by length, longest first, then by least x, least y and id."""
    x, y = F.least("px", "qx"), F.least("py", "qy")
    return parts.withColumn("part", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("length"), x, y, "id")) - 1).cast("long"))


def road_edges(parts: DataFrame) -> DataFrame:
    """Adds start_node and end_node to parts of links: the source's node where a part ends exactly there, the start
    being tried first, and otherwise a boundary node that belongs to this part and side alone."""

    def node(x: str, y: str, side: str) -> Column:
        source = lambda n: F.concat(F.lit("n"), F.col(n))
        boundary = F.concat_ws(":", F.lit("b"), "id", "col", "row", F.lit(side))
        at_start = (F.col(x) == F.col("xa")) & (F.col(y) == F.col("ya"))
        at_end = (F.col(x) == F.col("xb")) & (F.col(y) == F.col("yb"))
        return F.when(at_start, source("from_node")).when(at_end, source("to_node")).otherwise(boundary)

    return parts.withColumn("start_node", node("px", "py", "start")).withColumn("end_node", node("qx", "qy", "end"))


def road_nodes(edges: DataFrame) -> DataFrame:
    """(col, row, node, x, y, kind), one row a node of a window. Parts of links of ``grid.in_groups`` aren't exchanged again."""
    keys = [*(c for c in grid.GROUPED if c in edges.columns), "col", "row"]
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("end_node").alias("node"), F.col("qx").alias("x"), F.col("qy").alias("y")))).alias("e"))
    nodes = ends.groupBy(*keys, "e.node").agg(F.min(F.struct("e.x", "e.y")).alias("at"))
    return nodes.select("col", "row", "node", "at.x", "at.y", F.when(F.col("node").startswith("n"), "source").otherwise("boundary").alias("kind"))


def district_mapping(windows: DataFrame, districts: DataFrame, size: float = grid.SIZE, stride: float = grid.STRIDE) -> DataFrame:
    """(col, row, district, split, area, fraction, is_primary): the districts with which a window shares area.

    Districts tile the plane in squares whose pattern of 5 x 5 repeats, so that a window finds them by cell; of these
    the primary one has the greatest area, then the least code. The district table is small and Spark broadcasts it by size.
    """
    half = size / 2
    x0, y0 = F.col("col") * stride - half, F.col("row") * stride - half
    cells = windows.select("col", "row", F.explode(F.sequence(grid.cell(x0, DISTRICT), grid.cell(x0 + size, DISTRICT))).alias("ux"), (F.col("row") * stride - half).alias("y0"))
    cells = cells.select("col", "row", "ux", F.explode(F.sequence(grid.cell(F.col("y0"), DISTRICT), grid.cell(F.col("y0") + size, DISTRICT))).alias("uy"))
    across = F.least(x0 + size, (F.col("ux") + 1) * DISTRICT) - F.greatest(x0, F.col("ux") * DISTRICT)
    down = F.least(y0 + size, (F.col("uy") + 1) * DISTRICT) - F.greatest(y0, F.col("uy") * DISTRICT)
    shared = cells.withColumn("area", F.when((across > 0) & (down > 0), across * down)).filter("area > 0").withColumns({"cx": F.pmod("ux", F.lit(5)), "cy": F.pmod("uy", F.lit(5))})
    mapped = shared.join(districts, ["cx", "cy"]).groupBy("col", "row", "district", "split").agg(F.sum("area").cast("double").alias("area"))
    first = Window.partitionBy("col", "row").orderBy(F.desc("area"), "district")
    return mapped.withColumn("fraction", F.col("area") / (size * size)).withColumn("is_primary", F.row_number().over(first) == 1)


def split_of_windows(mapping: DataFrame) -> DataFrame:
    """(col, row, split): windows that lie in one split alone; those across splits are not eligible."""
    return mapping.groupBy("col", "row").agg(F.min("split").alias("split"), F.max("split").alias("other")).filter("split = other").select("col", "row", "split")


def coverage_multiplicity(windows: DataFrame) -> DataFrame:
    """(multiplicity, cells): how many stride-sized cells lie in how many windows of twice the stride."""
    corner = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c)))
    cells = windows.select(corner("col").alias("cx"), "row").select("cx", corner("row").alias("cy"))
    return cells.groupBy("cx", "cy").agg(F.count("*").alias("multiplicity")).groupBy("multiplicity").agg(F.count("*").alias("cells"))


def part_occurrence(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: the number (from 0) of an equal geometry within the keys."""
    return parts.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def provenance(window: Column, **observations: DataFrame) -> DataFrame:
    """(object_type, id, col, row, observation_id) of several kinds of observation, as one bag. window: a window's identity from col and row.

    An observation is identified by its window, type and object; one of a road by its part too, if there is a ``part_id``.
    """
    out = None
    for kind, frame in observations.items():
        part = F.col("part_id") if "part_id" in frame.columns else None
        own = ids.observation_id(window, F.lit(kind), F.col("id"), part)
        rows = frame.select(F.lit(kind).alias("object_type"), "id", "col", "row", own.alias("observation_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def allowable_windows(windows: DataFrame, districts: DataFrame, margin: float = 125, size: float = grid.SIZE, stride: float = grid.STRIDE) -> DataFrame:
    """(col, row, split, reason): the split of windows that lie in its districts alone, ``margin`` or more from those of others.

    A window is left out, with the reason 'no district', 'across splits' or 'too near another split'. The split's region
    less a margin around all others covers a window if the window lies in the region and no other region is within the
    margin; so distances to the neighbouring cells decide, and no buffer is built. Cells with no district belong to none.
    """
    half = size / 2
    x0, y0 = F.col("col") * stride - half, F.col("row") * stride - half
    reach = lambda v: F.sequence(grid.cell(v - margin, DISTRICT), grid.cell(v + size + margin, DISTRICT))
    cells = windows.select("col", "row", F.explode(reach(x0)).alias("ux"), y0.alias("y0")).select("col", "row", "ux", "y0", F.explode(reach(F.col("y0"))).alias("uy"))
    gap = lambda v, u: F.greatest(u * DISTRICT - (v + size), v - (u + 1) * DISTRICT, F.lit(0.0))
    gap_x, gap_y = gap(x0, F.col("ux")), gap(F.col("y0"), F.col("uy"))
    inside = (F.least(x0 + size, (F.col("ux") + 1) * DISTRICT) > F.greatest(x0, F.col("ux") * DISTRICT)) & (F.least(F.col("y0") + size, (F.col("uy") + 1) * DISTRICT) > F.greatest(F.col("y0"), F.col("uy") * DISTRICT))
    near = cells.select("col", "row", F.pmod("ux", F.lit(5)).alias("cx"), F.pmod("uy", F.lit(5)).alias("cy"), F.hypot(gap_x, gap_y).alias("gap"), inside.alias("inside")).filter(F.col("inside") | (F.col("gap") < margin))
    held = near.join(districts.select("cx", "cy", "split"), ["cx", "cy"], "left").groupBy("col", "row").agg(
        F.min(F.when(F.col("inside"), F.col("split"))).alias("split"), F.max(F.when(F.col("inside"), F.col("split"))).alias("last"), F.count_if(F.col("inside") & F.col("split").isNull()).alias("holes"),
        F.min("split").alias("least"), F.max("split").alias("most"),
    )
    reason = F.when(F.col("split").isNull() | (F.col("holes") > 0), "no district").when(F.col("split") != F.col("last"), "across splits").when(F.col("least") != F.col("most"), "too near another split")
    return held.withColumn("reason", reason).select("col", "row", F.when(F.col("reason").isNull(), F.col("split")).alias("split"), "reason")


def rejections(judged: DataFrame) -> DataFrame:
    """(split, reason, windows): how many windows each split has, and how many were left out for what."""
    return judged.groupBy("split", "reason").agg(F.count("*").alias("windows"))


def in_order(observed: DataFrame, *more: str) -> DataFrame:
    """Observations by split, district, window, type (buildings, roads, points of interest) and object; then by ``more``, nulls first."""
    rank = F.when(F.col("object_type") == "building", 0).when(F.col("object_type") == "road", 1).otherwise(2)
    return observed.orderBy("split", "district", "col", "row", rank, "id", *(F.asc_nulls_first(c) for c in more))


def query_candidates(objects: DataFrame, windows: DataFrame, identities: DataFrame) -> DataFrame:
    """(col, row, id, object_id) of boxes that meet chosen windows, edges included, in order, those without an identity last.

    identities: (id, object_id), of which null, empty or repeated ones are an error.
    """
    bad = identities.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("object_id").isNull() | (F.col("object_id") == "")).alias("empty")).withColumn("_ok", F.assert_true((F.col("n") == 1) & (F.col("empty") == 0) & F.col("id").isNotNull(), F.lit("identities must be unique and not empty")))
    known = identities.join(bad.filter("_ok IS NULL").select("id"), "id", "left_semi")
    met = grid.windows_of(objects, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).join(windows.select("col", "row").distinct(), ["col", "row"])
    return met.join(known, "id", "left").select("col", "row", "id", "object_id").orderBy("col", "row", F.asc_nulls_last("object_id"), "id")
