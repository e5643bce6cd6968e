import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselon.functions import geometry
from tesselon.operators import audits, observations, profiles, relations, splits, zonal
from tesselon.sources import layers, mapping, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def town(spark):
    """Two boxes, two road parts and four points of one window, with the relations worked out by hand."""
    boxes = spark.createDataFrame([(0, 0, 1, 0, 0, 10, 10), (0, 0, 2, 20, 0, 30, 10)], "col long, row long, id long, cx0 long, cy0 long, cx1 long, cy1 long")
    points = spark.createDataFrame([(0, 0, 1, 5, 5), (0, 0, 2, 10, 5), (0, 0, 3, 100, 100), (0, 0, 4, 102, 100)], "col long, row long, id long, x long, y long")
    roads = spark.createDataFrame([(0, 0, 1, "n1", "n2"), (0, 0, 2, "n2", "n3"), (0, 0, 3, "b:3:start", "b:3:end"), (1, 0, 2, "n2", "n3")], "col long, row long, id long, start_node string, end_node string")
    return boxes, points, roads


def test_containment_holds_the_boundary(town):
    boxes, points, _ = town
    assert rows(relations.containment(boxes, points).select("kind", "src", "dst")) == [("CNT", 1, 1), ("CNT", 1, 2), ("WIT", 1, 1), ("WIT", 2, 1)]


def test_connection_by_node_within_a_window(town):
    assert rows(relations.connections(town[2]).select("col", "src", "dst")) == [(0, 1, 2), (0, 2, 1)]


def test_intersection_leaves_out_containment(spark):
    schema = "col long, row long, id long, cx0 long, cy0 long, cx1 long, cy1 long"
    boxes = spark.createDataFrame([(0, 0, 1, 0, 0, 10, 10), (0, 0, 2, 10, 10, 20, 20), (0, 0, 3, 2, 2, 4, 4), (0, 0, 4, 50, 50, 60, 60), (1, 0, 5, 5, 5, 15, 15)], schema)
    assert rows(relations.intersections(boxes).select("src", "dst")) == [(1, 2), (2, 1)]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    corner, size = rng.integers(-400, 400, (160, 2)), rng.integers(0, 40, (160, 2))
    objects = [("building" if i % 3 else "road", i, *map(int, (*c, *(c + s)))) for i, (c, s) in enumerate(zip(corner, size))]
    df = spark.createDataFrame(objects, "object_type string, id long, x0 long, y0 long, x1 long, y1 long")
    radius, k = {"building": 100, "road": 60}, {"building": 4, "road": 2}
    expected = set()
    for t, i, *a in objects:
        near = []
        for u, j, *b in objects:
            d = sum(max(a[d] - b[d + 2], b[d] - a[d + 2], 0) ** 2 for d in (0, 1))
            if i != j and d <= radius[t] ** 2:
                near.append((d, u, j))
        for d, u, j in sorted(near)[: k[t]]:
            expected |= {(t, i, u, j, d**0.5), (u, j, t, i, d**0.5)}
    assert rows(relations.nearest(df, radius, k).select("src_type", "src", "dst_type", "dst", "distance")) == sorted(expected, key=repr)


def test_pois_have_their_own_pool(town):
    points = town[1].select(F.lit("poi").alias("object_type"), "id", *(F.col(c[0]).alias(c) for c in ("x0", "y0", "x1", "y1")))
    assert rows(relations.nearest(points, {"poi": 50}, {"poi": 8}).select("src", "dst")) == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_graph_metrics(town, spark):
    nodes = spark.createDataFrame([(0, 0, "road", 1), (0, 0, "road", 2), (0, 0, "road", 2), (0, 0, "road", 9)], "col long, row long, object_type string, id long")
    extra = spark.createDataFrame([(0, 0, "SN", "poi", 1, "road", 1, 1.0), (0, 0, "SN", "road", 2, "road", 2, 0.0), (0, 0, "SN", "road", 2, "road", 2, 0.0)], "col long, row long, kind string, src_type string, src long, dst_type string, dst long, distance double")
    got = dict(rows(relations.graph_metrics(nodes, relations.connections(town[2]).unionByName(extra))))
    assert got == {"nodes": 4, "duplicate_nodes": 1, "isolated_nodes": 1, "dangling_nodes": 1, "edges": 5, "duplicate_edges": 1, "self_loops": 2, "forbidden_pairs": 1}


def test_segment_clip_and_nodes(spark):
    links = spark.createDataFrame([(1, 11, 12, 0, 0, 600, 0), (2, 12, 13, 240, 240, 260, 260), (3, 13, 14, 5, 5, 5, 5)], "id long, from_node long, to_node long, xa long, ya long, xb long, yb long")
    edges = observations.road_edges(observations.clip_segments(links)).filter("col = 0 AND row = 0")
    assert rows(edges.select("id", "length", "start_node", "end_node")) == [(1, 250.0, "n11", "b:1:0:0:end"), (2, pytest.approx(10 * 2**0.5), "n12", "b:2:0:0:end")]
    assert edges.filter("id = 3").count() == 0
    assert {r["kind"] for r in observations.road_nodes(edges).collect()} == {"source", "boundary"}


def test_district_ties_go_to_the_lesser_code(spark):
    districts = spark.createDataFrame([(k, str(k), k % 5, k // 5, "train" if k % 5 < 3 else "test") for k in range(25)], "district long, name string, cx long, cy long, split string")
    windows = spark.createDataFrame([(4, 2), (12, 2), (2, 2)], "col long, row long")
    got = rows(observations.district_mapping(windows, districts).select("col", "district", "fraction", "is_primary"))
    assert got == [(12, 2, 0.5, True), (12, 3, 0.5, False), (2, 0, 1.0, True), (4, 0, 0.5, True), (4, 1, 0.5, False)]


def test_attribute_join_is_strict(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(1, "c"), (2, "d")], "k long, v string")
    assert rows(profiles.attribute_join(left, right, "k")) == [(1, "a", "c"), (2, "b", "d")]
    for bad in (right.limit(1), right.union(right), right.union(spark.createDataFrame([(None, "x")], "k long, v string"))):
        with pytest.raises(Exception, match="not one to one"):
            profiles.attribute_join(left, bad, "k").collect()


def test_profiles_on_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), (" a",), ("NULL",), ("007",), ("-1",), ("0",), ("x",), ("x",)], "v string")
    r = profiles.column_profile(df, "v").first()
    assert (r["rows"], r["nulls"], r["distinct"], r["duplicates"], r["empty"], r["padded"], r["missing_tokens"], r["leading_zeros"], r["negative"], r["zero"], r["id_candidate"]) == (9, 1, 7, 1, 1, 1, 2, 1, 1, 1, False)
    assert profiles.column_profile(df.limit(0), "v").count() == 0
    n = profiles.numeric_summary(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "v double"), "v").first()
    assert (n["n"], n["mean"], n["std"], n["q50"]) == (2, 2.0, 1.0, 2.0)
    assert rows(profiles.key_summary(df, "v")) == [(9, 7, 1, 1)]


def test_audits(spark):
    seen = spark.createDataFrame([("poi", 1, 0, 0), ("poi", 1, 9, 0), ("poi", 2, 0, 0)], "object_type string, id long, col long, row long")
    split = spark.createDataFrame([(0, 0, "train"), (9, 0, "test"), (1, 1, "test")], "col long, row long, split string")
    assert rows(audits.leakage(seen, split)) == [("poi", 1, 2, "test|train")]
    assert rows(audits.cross_split_overlaps(split)) == [("test", "train", 1)]
    a, b = (spark.createDataFrame(x, "k int, v string, w double") for x in ([(1, "a", None), (2, "b", 1.0), (3, "c", 1.0)], [(1, "a", None), (2, None, 2.0), (4, "d", 1.0)]))
    assert rows(audits.snapshot_diff(a, b, "k", ["v", "w"])) == [(2, "changed", "v,w"), (3, "removed", ""), (4, "added", "")]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.0, 0.0]), (1, [float("nan"), 1.0]), (1, [1.0])], "label int, v array<double>")
    assert rows(audits.embedding_quality(vectors, "v", "label", 2)) == [(1, 4, 1, 1, 1)]


def test_pooled_deviation_is_that_of_the_values(spark):
    values = [(k % 3, float(v)) for k, v in enumerate(np.random.default_rng(1).normal(5, 9, 60))]
    zones = zonal.statistics(spark.createDataFrame(values, "zone int, v double"), "zone", "v").withColumn("all", F.lit(1))
    r = zonal.pooled(zones, "all").first()
    assert (r["mean"], r["std"]) == (pytest.approx(np.mean([v for _, v in values])), pytest.approx(np.std([v for _, v in values])))


def test_safe_casts(spark):
    df = spark.createDataFrame([(3.0, "7"), (1.5, "x"), (None, None), (70000.0, "7.5"), (float("nan"), "99999")], "a double, b string")
    for c, t in (("a", "double"), ("b", "string")):
        value, lost = mapping.safe_cast(F.col(c), t, "smallint")
        got = [tuple(r) for r in df.select(value, lost).collect()]
        assert [g[0] for g in got] == [{"a": 3, "b": 7}[c], None, None, None, None] and [g[1] for g in got] == [False, True, False, True, True]
    fields = [mapping.Field("lanes", "smallint", "a"), mapping.Field("crs", "string", constant="EPSG:5186")]
    assert rows(mapping.canonical(df.limit(1), fields)) == [(3, "EPSG:5186")]
    assert rows(mapping.violations(df, fields)) == [("lanes", 1, 3)]
    with pytest.raises(Exception, match="lanes can't hold"):
        mapping.canonical(df, fields).collect()
    with pytest.raises(Exception, match="lanes is null"):
        mapping.canonical(df.filter("a IS NULL"), [mapping.Field("lanes", "smallint", "a", nullable=False)]).collect()
    with pytest.raises(ValueError, match="missing"):
        mapping.canonical(df, [mapping.Field("z", "int", "zz")])


def test_manifested_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", [i]) for i in range(50)], "a long, b string, c array<long>")
    path = str(tmp_path / "t")
    assert tables.write_table(df, path)["rows"] == 50
    assert tables.read_table(spark, path, ["b"]).columns == ["b"] and tables.read_table(spark, path).count() == 50
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="content"):
        tables.read_table(spark, path)
    assert all(len(r["sha256"]) == 64 for r in tables.inventory(spark, path).collect())
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).filter("a = 7").first()["c"] == "[7]"
    registry = tables.Registry(tables.Source("t", path))
    assert registry.read(spark, "t").count() == 51
    with pytest.raises(ValueError):
        tables.Registry(tables.Source("t", "x"), tables.Source("t", "y"))


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    blob = lambda s: b"GP\0\1" + struct.pack("<i", 5186) + geometry.write_wkb(s)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('b', 'geom')")
        con.execute("CREATE TABLE b (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, height REAL)")
        con.executemany("INSERT INTO b VALUES (?, ?, ?, ?)", [(i, None if i == 7 else blob(geometry.rectangle(i, 0, i + 2, 3)), f"n{i}", i / 2) for i in range(1, 101)])
    con.close()
    spark.dataSource.register(layers.GeoPackage)
    df = spark.read.format("geopackage").option("rowsperpartition", 30).load(path)
    assert df.columns == ["fid", "name", "height", "geometry_wkb"] and df.count() == 100 and df.rdd.getNumPartitions() == 4
    m = layers.layer_metadata(layers.read_geopackage(spark, path)).first()
    assert (m["features"], m["null_geometries"], m["measure"], m["xmax"]) == (100, 1, 594, 102)
    assert layers.read_geopackage(spark, path, "b", ["name", "fid"]).columns == ["name", "fid"]
    assert layers.with_box(df).filter(layers.meets(50.5, 1, 52.5, 2)).count() == 4


def test_split_search_finds_the_brute_force_best(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"code": [f"{i:02d}" for i in range(25)], "x": np.arange(25) % 5, "y": np.arange(25) // 5} | {c: rng.uniform(1, 9, 25) for c in (*splits.EXTENSIVE, *splits.DENSITY, "dem_cells", "dem_mean", "dem_std")})
    categories, landcover = rng.integers(0, 50, (25, 4)), rng.integers(0, 50, (25, 6))
    near = (np.maximum(np.abs(np.subtract.outer(*[frame["x"].to_numpy()] * 2)), np.abs(np.subtract.outer(*[frame["y"].to_numpy()] * 2))) == 1).astype(float)
    plan = splits.Plan(candidates=3000)
    o = splits.Objective(frame, categories, landcover, near, plan)
    found = splits.search(spark, o, block=500)
    drawn = splits.candidates(o.codes, plan)

    def parts(codes):
        left, n = set(codes), 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                i = stack.pop()
                more = {j for j in left if near[i, j]}
                left -= more
                stack += more
        return n

    feasible = []
    for c, row in enumerate(drawn):
        own = [np.flatnonzero(row == s) for s in range(3)]
        if all(len(set(o.context[i])) >= 3 for i in own) and all(len(set(o.spatial[i])) >= 2 and len(set(o.radial[i])) >= 2 and 2 <= parts(i.tolist()) <= 3 for i in own[1:]):
            share = np.mean([(frame[list(splits.EXTENSIVE)].to_numpy()[i].sum(0) / frame[list(splits.EXTENSIVE)].to_numpy().sum(0) / t - 1) ** 2 for i, t in zip(own, (0.6, 0.2, 0.2))])
            feasible.append((c, share))
    got = found.select("candidate", "extensive", "score").collect()
    assert sorted(r["candidate"] for r in got) == [c for c, _ in feasible] and len(feasible) > 20
    assert {r["candidate"]: round(r["extensive"], 9) for r in got} == {c: round(s, 9) for c, s in feasible}
    best = splits.best(found).first()
    assert best["score"] == min(r["score"] for r in got)
    assigned = splits.assignment(found)
    assert all(r["ok"] for r in splits.validate(assigned, plan).collect()) and assigned.count() == 25
    assert rows(splits.assignment(splits.search(spark, o, block=71))) == rows(assigned)


def test_quantiles_match_numpy(spark):
    """Groups of one value, of equal values, of a few and of many."""
    rng = np.random.default_rng(8)
    groups = {"one": [5.0], "equal": [2.0] * 9, "few": [1.0, 2.0, 10.0], "many": rng.normal(size=3000).round(2).tolist(), "wide": (10 ** rng.uniform(-9, 9, 500)).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in profiles.exact_quantiles(df, ["g"], "v", profiles.QUANTILES, cells=16).collect()}
    for g, values in groups.items():
        assert [got[g][n] for n in profiles.QUANTILES] == pytest.approx(np.quantile(values, list(profiles.QUANTILES.values())))


def test_shapes_meet_and_lie_apart(spark):
    """Boxes and segments, touching and slanting, against a plain walk over edges and fine steps along them."""
    rng = np.random.default_rng(12)
    objects = []
    for i in range(70):
        a, d = rng.integers(0, 60, 2).tolist(), rng.integers(0, 14, 2).tolist()
        if i % 2:
            objects.append((0, 0, "building", i, *map(float, (a[0], a[1], a[0] + d[0] + 1, a[1] + d[1] + 1)), None, None, None, None))
        else:
            b = [a[0] + d[0] - 7, a[1] + d[1] - 7]
            objects.append((0, 0, "road", i, *map(float, (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1]), *a, *b))))
    df = spark.createDataFrame(objects, "col long, row long, object_type string, id long, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double")

    def points(o):
        t = np.linspace(0, 1, 201)[:, None]
        if o[8] is not None:
            return np.array(o[8:10]) * (1 - t) + np.array(o[10:12]) * t
        x, y = np.meshgrid(np.linspace(o[4], o[6], 31), np.linspace(o[5], o[7], 31))
        return np.stack([x.ravel(), y.ravel()], axis=1)

    held = {(r["src"], r["dst"]): r["distance"] for r in relations.nearest(df, {"building": 30, "road": 30}, {"building": 999, "road": 999}, ["col", "row"]).collect()}
    met = {(r["src"], r["dst"]) for r in relations.shape_intersections(df).collect()}
    clouds = {o[3]: points(o) for o in objects}
    for o in objects[:30]:
        for p in objects[:30]:
            if o[3] < p[3]:
                near = np.sqrt(((clouds[o[3]][:, None] - clouds[p[3]][None]) ** 2).sum(2).min())
                exact = held.get((o[3], p[3]))
                assert (near > 29.3) if exact is None else (exact - 1e-9 <= near <= exact + 0.7)
                if (o[3], p[3]) in met:
                    assert exact == 0
    assert met and all((b, a) in met for a, b in met)


def test_a_segment_within_a_box_or_on_another_is_no_intersection(spark):
    seg = lambda i, *e: (0, 0, "road", i, float(min(e[0], e[2])), float(min(e[1], e[3])), float(max(e[0], e[2])), float(max(e[1], e[3])), *map(float, e))
    box = (0, 0, "building", 1, 0.0, 0.0, 10.0, 10.0, None, None, None, None)
    df = spark.createDataFrame([box, seg(2, 1, 1, 9, 9), seg(3, 5, 5, 20, 20), seg(4, 10, 10, 12, 30), seg(5, 0, 12, 12, 24), seg(6, 2, 2, 3, 3), seg(7, 30, 30, 40, 35)], "col long, row long, object_type string, id long, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double")
    pairs = {(r["src"], r["dst"]) for r in relations.shape_intersections(df).collect() if r["src"] < r["dst"]}
    assert pairs == {(1, 3), (1, 4), (2, 3), (3, 4), (4, 5)}


def test_allowable_windows_keep_their_distance(spark):
    """Squares of 1,000: a window just the margin away from another split is in, one nearer is not."""
    districts = spark.createDataFrame([(c, r, "train" if c < 3 else "test") for c in range(5) for r in range(5)], "cx long, cy long, split string")
    windows = spark.createDataFrame([(c, 8) for c in range(6, 16)], "col long, row long")
    got = {r["col"]: (r["split"], r["reason"]) for r in observations.allowable_windows(windows, districts, size=250, stride=250).collect()}
    assert got[10] == got[11] == ("train", None) and got[12] == (None, "across splits") and got[13] == got[14] == ("test", None)
    got = {r["col"]: (r["split"], r["reason"]) for r in observations.allowable_windows(windows, districts, margin=126, size=250, stride=250).collect()}
    assert got[10] == ("train", None) and got[11] == got[13] == (None, "too near another split") and got[12] == (None, "across splits")
    some = districts.filter("cx <> 2")
    assert {r["col"]: r["reason"] for r in observations.allowable_windows(windows, some, size=250, stride=250).collect()}[10] == "no district"


def test_candidates_want_sound_identities(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 5, 9, 9), (3, 2000, 0, 2010, 10)], "id long, x0 long, y0 long, x1 long, y1 long")
    windows = spark.createDataFrame([(0, 0), (0, 0)], "col long, row long")
    found = observations.query_candidates(boxes, windows, spark.createDataFrame([(2, "b"), (3, "c")], "id long, object_id string")).collect()
    assert [(r["id"], r["object_id"]) for r in found] == [(2, "b"), (1, None)]
    with pytest.raises(Exception, match="identities must be unique"):
        observations.query_candidates(boxes, windows, spark.createDataFrame([(2, "b"), (2, "c")], "id long, object_id string")).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shapes_of_windows_are_exchanged_once(spark):
    """neither pairs nor repeated pieces are exchanged, and nothing is broadcast."""
    from tesselon.plans import catalogue

    plan = _plan(catalogue.relation_sn_mixed(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_nearest_of_windows_doesn_t_depend_on_chunks():
    """lists are pruned between chunks of pairs; ties go by type and id; an object repeated in a window counts once."""
    import pyarrow as pa

    from tesselon.functions import near

    rng = np.random.default_rng(8)
    n = 300
    corner, size = rng.integers(0, 150, (n, 2)), rng.integers(0, 12, (n, 2))
    line = rng.random(n) < 0.3
    ends = np.where(line[:, None], np.stack([corner[:, 0], corner[:, 1], corner[:, 0] + size[:, 0], corner[:, 1] + size[:, 1]], axis=1), np.nan)
    names = [f"o{i % 290}" for i in range(n)]
    columns = {"col": rng.integers(0, 2, n), "row": np.zeros(n, int), "object_type": np.where(line, "road", "building"), "id": names, "x0": corner[:, 0], "y0": corner[:, 1], "x1": corner[:, 0] + size[:, 0], "y1": corner[:, 1] + size[:, 1]}
    table = pa.table(columns | {c: ends[:, k] for k, c in enumerate(near.LINE)})
    found = [sorted(map(str, near.nearest(table, ["col", "row"], {"building": 40.0, "road": 25.0}, {"building": 5, "road": 3}, most).to_pylist())) for most in (50, 10_000_000)]
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) > n
    met = [sorted(map(str, near.intersections(table, ["col", "row"], most).to_pylist())) for most in (50, 10_000_000)]
    assert met[0] == met[1] and met[0]
    assert near.nearest(table.slice(0, 0), ["col", "row"], {"road": 1.0}, {"road": 1}).num_rows == 0


def test_points_of_windows_are_not_broadcast(spark):
    """pieces made by repeating rows are many more than the file's size suggests."""
    from tesselon.plans import catalogue

    plan = _plan(catalogue.relation_sn(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan and plan.count("Exchange") == 1


def test_rows_without_a_place_are_near_nothing(spark):
    """rows without an id or a place are left out, the others stay."""
    points = spark.createDataFrame([(0, 0, "poi", 1, 5, 5, 5, 5), (0, 0, "poi", 2, 6, 5, 6, 5), (0, 0, "poi", 3, None, 5, None, 5), (0, 0, "poi", None, 5, 5, 5, 5), (1, 0, "poi", 3, 5, 5, 5, 5)], "col long, row long, object_type string, id long, x0 long, y0 long, x1 long, y1 long")
    assert rows(relations.nearest(points, {"poi": 50}, {"poi": 8}, ["col", "row"]).select("src", "dst")) == [(1, 2), (2, 1)]


def test_intersections_are_found_without_a_join(spark):
    """shapes of a window are swept in a kernel; they aren't repeated for cells and joined."""
    from tesselon.plans import catalogue

    plan = _plan(catalogue.relation_int(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("Exchange") == 2


def test_quantiles_exchange_no_values(spark):
    """ranges and wanted parts go to the values; joined by exchange, all values of a column went through one task."""
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    found = profiles.exact_quantiles(df, ["g"], "v", {"q": 0.25})
    assert rows(found) == [("a", 249.75)] and "SortMergeJoin" not in _plan(found)


def test_links_are_joined_without_a_broadcast(spark):
    """nodes are exchanged by key and neither broadcast nor left in the tasks of their file; repeated nodes give repeated links."""
    from tesselon.plans import catalogue, layouts

    for name in ("relation_con", "road_nodes"):
        assert "Broadcast" not in _plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    nodes = spark.createDataFrame([(i, i // 100, i % 100, i, 0) for i in (97, 98, 99, 99, 100, 101, 103)], "id long, chain long, j long, x long, y long")
    assert rows(layouts._links(nodes).select("from_node", "to_node", "xa", "xb")) == [(100, 101, 100, 101), (97, 98, 97, 98), (98, 99, 98, 99), (98, 99, 98, 99)]


def test_parts_grow_with_the_input(spark, monkeypatch):
    """a task's memory doesn't grow with the input."""
    from tesselon.functions import grid
    from tesselon.plans import layouts

    nodes = layouts.layout(spark, "/root/testdata/sf0.1", "nodes")
    assert grid.parts_of(nodes) == 4 and grid.parts_of(spark.createDataFrame([(1,)], "id long")) == 4
    monkeypatch.setattr(grid, "PART", 10_000)
    assert grid.spread_out(nodes, "id").rdd.getNumPartitions() == grid.parts_of(nodes) > 20


def test_nodes_are_counted_where_their_links_lie(spark, monkeypatch):
    """links are exchanged by groups of windows before they are repeated, in parts that grow with the input; nodes, in as many parts as
    shuffles have, weren't and filled a task's memory."""
    from tesselon.functions import grid
    from tesselon.plans import catalogue

    plan = _plan(catalogue.road_nodes(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 3 and "ENSURE_REQUIREMENTS" not in plan
    links = [(1, 11, 12, -2600, 10, 2700, 10), (2, 12, 13, 2700, 10, 2700, 2400), (2, 12, 13, 2700, 10, 2700, 2400), (3, 13, 14, 2375, 2375, 2375, 2375), (4, 14, 15, None, 5, 9, 5), (5, 11, 12, 2625, -5, 2375, 5)]
    links = spark.createDataFrame(links, "id long, from_node long, to_node long, xa long, ya long, xb long, yb long")
    nodes = lambda x: rows(observations.road_nodes(observations.road_edges(observations.clip_segments(x))))
    found = nodes(observations.segments_in_groups(links))
    assert found == nodes(links) and len({r[:3] for r in found}) == len(found) > 100
    monkeypatch.setattr(grid, "PART", 10_000)
    assert catalogue.road_nodes(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 20


def test_pairs_are_made_distinct_before_they_are_doubled(spark, monkeypatch):
    """F10, the step of relation_con and relation_ids: pairs of parts that share both nodes count once, in parts that grow with the input."""
    from tesselon.functions import grid
    from tesselon.plans import catalogue

    edges = spark.createDataFrame([(0, 0, 1, "n1", "n2"), (0, 0, 2, "n2", "n1"), (0, 0, 2, "n2", "n1"), (0, 0, 3, "n2", "b:3:0:0:end"), (1, 0, 3, "n2", "n3"), (0, 0, None, "n1", "n2")], "col long, row long, id long, start_node string, end_node string")
    assert rows(relations.connections(edges).select("col", "row", "src", "dst")) == [(0, 0, a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
    assert "ENSURE_REQUIREMENTS" not in _plan(catalogue.relation_con(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(grid, "PART", 10_000)
    assert catalogue.relation_con(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 20


def test_identities_are_worked_out_after_the_sort(spark):
    """sampling for the order's ranges would work them out twice, and the sorted rows lie in few tasks."""
    from tesselon.plans import catalogue

    df = catalogue.relation_ids(spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "sha2(" in plan and "sha2(" not in plan[plan.index("rangepartitioning") :]
    order = [tuple(r)[:4] for r in df.collect()]
    assert order == sorted(order) and len(order) == len(set(order)) > 100


def test_graph_metrics_exchange_each_relation_once(spark):
    """nodes, ends and edges are counted together; boxes and points of a window meet in a kernel, not by broadcasting the points."""
    from tesselon.plans import catalogue

    plan = _plan(catalogue.graph_metrics(spark, "/root/testdata/sf0.001"))
    assert "FullOuter" not in plan and "Broadcast" not in plan
    held = _plan(catalogue.relation_cnt_wit(spark, "/root/testdata/sf0.001"))
    assert "Join" not in held and held.count("Exchange") == 2
    none = spark.createDataFrame([], "col long, row long, kind string, src_type string, src long, dst_type string, dst long, distance double")
    nodes = spark.createDataFrame([(0, 0, "poi", 1)], "col long, row long, object_type string, id long")
    assert dict(rows(relations.graph_metrics(nodes, none)))["isolated_nodes"] == 1
    assert set(dict(rows(relations.graph_metrics(nodes.limit(0), none))).values()) == {0}
