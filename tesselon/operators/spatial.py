"""Spatial joins of points and segments with polygons of any shape, and rasters as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, grid
from . import observations


def points_in_polygons(points: DataFrame, polygons: DataFrame, side: float, strict: bool = False, wkb: str = "geometry_wkb") -> DataFrame:
    """Points (x, y) with the columns of each polygon that holds them; boundaries count unless ``strict``.

    Polygons (with xmin, ymin, xmax, ymax) are listed under the cells of ``side`` that their boxes reach, points under
    their own: an equi-join, then the box, then the exact test on what is left. ``side`` should be about a polygon's width.
    """
    spread = lambda a, b: F.explode(F.sequence(grid.cell(F.col(a), side), grid.cell(F.col(b), side)))
    listed = polygons.withColumn("_cx", spread("xmin", "xmax")).withColumn("_cy", spread("ymin", "ymax"))
    placed = points.withColumn("_cx", grid.cell(F.col("x"), side)).withColumn("_cy", grid.cell(F.col("y"), side))
    near = placed.join(listed, ["_cx", "_cy"]).filter("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
    return near.filter(geometry.covers_point(F.col(wkb), F.col("x"), F.col("y"), strict)).drop("_cx", "_cy")


def point_counts(points: DataFrame, polygons: DataFrame, key: str, side: float) -> DataFrame:
    """(key, points) of every polygon: points strictly within, 0 where there are none."""
    counts = points_in_polygons(points, polygons, side, strict=True).groupBy(key).agg(F.count("*").alias("points"))
    return polygons.select(key).join(counts, key, "left").withColumn("points", F.coalesce("points", F.lit(0)))


def lengths_by_square(links: DataFrame, side: float) -> DataFrame:
    """(cx, cy, length): how much of segments lies in each square [cx, cx + 1] x [cy, cy + 1] times side; what runs along
    an edge counts in both squares."""
    moved = links.withColumns({c: F.col(c) - side / 2 for c in ("xa", "ya", "xb", "yb")})
    parts = observations.clip_segments(moved, side, side)
    return parts.groupBy(F.col("col").alias("cx"), F.col("row").alias("cy")).agg(F.sum("length").alias("length"))


def common_box(boxes: DataFrame) -> DataFrame:
    """The box that all boxes share: greatest minima, least maxima; ``empty`` where there is none."""
    out = boxes.agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    return out.withColumn("empty", (F.col("xmin") > F.col("xmax")) | (F.col("ymin") > F.col("ymax")))


def raster_extent(x: Column, y: Column, width: Column, height: Column, dx: Column, dy: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of a raster from its upper left corner, size in cells and cell sides."""
    return [x.alias("xmin"), (y - height * dy).alias("ymin"), (x + width * dx).alias("xmax"), y.alias("ymax")]


def cell_centres(cells: DataFrame, x: float, y: float, dx: float, dy: float) -> DataFrame:
    """Adds the centre (x, y) of each cell (row, col) of a raster with upper left corner (x, y)."""
    return cells.withColumns({"x": F.lit(x) + (F.col("col") + 0.5) * dx, "y": F.lit(y) - (F.col("row") + 0.5) * dy})


def raster_cells(spark: SparkSession, values: list[list[float]], nodata: float | None = None) -> DataFrame:
    """(row, col, value) of a small raster; nodata is null."""
    return spark.createDataFrame([(r, c, None if v == nodata else float(v)) for r, line in enumerate(values) for c, v in enumerate(line)], "row long, col long, value double")


def masked(cells: DataFrame, polygons: DataFrame, side: float) -> DataFrame:
    """Cells whose centre a polygon holds, with its columns."""
    return points_in_polygons(cells, polygons, side)


def class_areas(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """(value, cells, area) of each class."""
    return cells.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("cells")).withColumn("area", F.col("cells") * (dx * dy))


def link_rasters(windows: DataFrame, rasters: DataFrame) -> DataFrame:
    """Every window (xmin, ymin, xmax, ymax) with each raster that it shares area with. The rasters are a handful of header rows."""
    r = rasters.select(*(F.col(c).alias(f"r_{c}" if c in windows.columns else c) for c in rasters.columns))
    return windows.crossJoin(r).filter("xmin < r_xmax AND xmax > r_xmin AND ymin < r_ymax AND ymax > r_ymin")
