import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions import crs, geometry
from tesselon.operators import planning, spatial


def test_transverse_mercator(spark):
    places = [(127.0, 37.5), (126.8, 37.7), (127.5, 38.0), (128.9, 35.1), (126.5, 33.4)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for system in (crs.EPSG_5179, crs.EPSG_5186):
        x, y = crs.from_degrees(system, F.col("lon"), F.col("lat"))
        lon, lat = crs.to_degrees(system, F.col("x"), F.col("y"))
        for r in df.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect():
            assert abs(r["a"] - r["lon"]) < 1e-10 and abs(r["b"] - r["lat"]) < 1e-10
    x, y = crs.from_degrees(crs.EPSG_5186, F.lit(127.0), F.lit(38.0))
    assert spark.range(1).select(x, y).first()[:] == pytest.approx((200_000, 600_000), abs=1e-6)
    # Along the central meridian northings are lengths of the meridian, here by quadrature.
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)
    lat = np.radians(np.linspace(37, 38, 200_001))
    arc = np.trapezoid(crs.A * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, lat)
    x, y = crs.from_degrees(crs.EPSG_5186, F.lit(127.0), F.lit(37.0))
    assert 600_000 - spark.range(1).select(y).first()[0] == pytest.approx(arc, abs=1e-4)
    # Distances keep their length between systems, but for the scale.
    a = spark.createDataFrame([(955_000.0, 1_950_000.0), (955_003.0, 1_950_004.0)], "x double, y double")
    u, v = crs.transformed(crs.EPSG_5179, crs.EPSG_5186, F.col("x"), F.col("y"))
    (x0, y0), (x1, y1) = sorted(map(tuple, a.select(u, v).collect()))
    assert math.dist((x0, y0), (x1, y1)) == pytest.approx(5 / 0.9996, rel=1e-4)


@pytest.fixture(scope="module")
def polygons(spark):
    ring = np.array([(0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)], float)
    shapes = [("notch", ("polygon", [[ring]])), ("box", geometry.rectangle(8, 8, 30, 12))]
    return spark.createDataFrame([(n, geometry.write_wkb(s), *map(float, geometry.box(s))) for n, s in shapes], "name string, geometry_wkb binary, xmin double, ymin double, xmax double, ymax double")


def test_points_in_polygons(spark, polygons):
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 8.0), (3, 0.0, 5.0), (4, 9.5, 9.0), (5, -1.0, 0.0), (6, 30.0, 12.0)], "id long, x double, y double")
    for side in (3, 100):
        closed = sorted((r["id"], r["name"]) for r in spatial.points_in_polygons(points, polygons, side).collect())
        assert closed == [(1, "notch"), (3, "notch"), (4, "box"), (4, "notch"), (6, "box")]
    assert {r["name"]: r["points"] for r in spatial.point_counts(points, polygons, "name", 5).collect()} == {"notch": 2, "box": 1}
    assert {r["points"] for r in spatial.point_counts(points.limit(0), polygons, "name", 5).collect()} == {0}


def test_rasters(spark, polygons):
    cells = spatial.cell_centres(spatial.raster_cells(spark, [[1, 1, 2], [1, 0, 2], [3, 3, 3], [1, 1, 1]], nodata=0), 100, 200, 5, 5)
    assert cells.filter("row = 0 AND col = 0").select("x", "y").first()[:] == (102.5, 197.5)
    assert {r["value"]: (r["cells"], r["area"]) for r in spatial.class_areas(cells, 5, 5).collect()} == {1.0: (6, 150.0), 2.0: (2, 50.0), 3.0: (3, 75.0)}
    header = spark.createDataFrame([("landcover", 100.0, 200.0, 3, 4, 5.0, 5.0)], "name string, x double, y double, w int, h int, dx double, dy double")
    extent = header.select("name", *spatial.raster_extent(*(F.col(c) for c in ("x", "y", "w", "h", "dx", "dy"))))
    assert extent.first()[:] == ("landcover", 100, 180, 115, 200)
    windows = spark.createDataFrame([(1, 110.0, 190.0, 120.0, 210.0), (2, 115.0, 180.0, 125.0, 190.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert [r["id"] for r in spatial.link_rasters(windows, extent).collect()] == [1]


def test_planning(spark):
    costs = [("a", 5.0), ("b", 4.0), ("c", 3.0), ("d", 3.0), ("e", 3.0)]
    assert planning.weighted_tasks(costs, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert planning.row_ranges(1025) == [(0, 512), (512, 1024), (1024, 1025)] and planning.row_ranges(0) == []
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert planning.partition_parity(df, ["id", "v"], 6)
    checked = planning.expect(planning.melt(spark.sql("SELECT 3 AS rows, 0 AS bad, 1 AS worse")), {"rows": 3, "gone": 2})
    assert {r["metric"]: r["ok"] for r in checked.collect()} == {"rows": True, "bad": True, "worse": False, "gone": False}
    errors = planning.record_errors({"crs": ("must be planar", F.col("crs") == "EPSG:5186"), "rows": ("must be counted", F.col("n") >= 0)})
    got = spark.createDataFrame([("EPSG:5186", 1), ("x", None)], "crs string, n int").select(errors).collect()
    assert [r[0] for r in got] == [[], ["crs: must be planar", "rows: must be counted"]]
