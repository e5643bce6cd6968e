import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions import codes, encoder, geometry, grid, ids, text


def digest(*fields):
    out = b""
    for f in fields:
        out += b"N" if f is None else b"S" + len(f.encode()).to_bytes(8, "big") + f.encode()
    return hashlib.sha256(out).hexdigest()


def test_canonical_hash(spark):
    rows = [("ab", "c"), ("a", "bc"), ("", "x"), (None, "x"), ("한글", "0001"), ("한글", "1")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(ids.canonical_hash(F.col("a"), F.col("b"))).collect()]
    assert got == [digest(*r) for r in rows] and len(set(got)) == len(rows)


def test_observation_hash_refuses_empty_fields(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "")], "a string, b string")
    assert df.filter("b <> ''").select(ids.observation_hash(F.col("a"), F.col("b"))).first()[0] == hashlib.sha256(b"a|b").hexdigest()
    with pytest.raises(Exception, match="null or empty"):
        df.select(ids.observation_hash(F.col("a"), F.col("b"))).collect()


def test_decimal_text():
    assert [ids.decimal_text(v) for v in (500, 250.0, "1e3", -0.0, "0.10", 1e-7)] == ["500", "250", "1000", "0", "0.1", "0.0000001"]


def test_content_hash_ignores_order_and_partitions(spark):
    rows = [(i, f"t{i % 7}") for i in range(300)]
    hashes = {ids.content_hash(spark.createDataFrame(r, "a int, b string").repartition(n), ["h"], ["a", "b"], most_lines=64).first() for r, n in ((rows, 1), (rows[::-1], 8))}
    assert len(hashes) == 1 and hashes.pop()["chunks"] == 5
    one = ids.content_hash(spark.createDataFrame([(1, "x")], "a int, b string"), ["h"], ["a", "b"]).first()
    chunk = hashlib.sha256(digest("1", "x").encode()).hexdigest()
    assert one["content_hash"] == hashlib.sha256(f"{hashlib.sha256(b'h').hexdigest()}\n{chunk}".encode()).hexdigest()
    assert ids.content_hash(spark.createDataFrame([], "a int, b string"), ["h"], ["a", "b"]).first()["rows"] == 0


def test_category_path(spark):
    df = spark.createDataFrame([("A\\B", "X > Y", "", None, "E", "F")], "a string, b string, c string, d string, e string, f string")
    assert df.select(text.category_path(*(F.col(c) for c in df.columns))).first()[0] == "A\\\\B > X\\ > Y >  > \\N > E > F"


def test_text_rules(spark):
    df = spark.createDataFrame([(" n/a ",), ("007",), ("7",), (None,)], "v string")
    assert [tuple(r) for r in df.select(text.is_missing_token(F.col("v")), text.has_leading_zero(F.col("v"))).collect()] == [(True, False), (False, True), (False, False), (None, None)]
    odd = spark.createDataFrame([("",), ("  ",), (" 007 ",), ("none",), ("-",)], "v string")
    assert [tuple(r) for r in odd.select(text.is_missing_token(F.col("v")), text.has_leading_zero(F.col("v"))).collect()] == [(True, False), (True, False), (False, True), (False, False), (False, False)]
    assert all(map(text.is_identifier_name, ("LINK_ID", "id", "F_NODE", "t_node", "MyIdentifierCode"))) and not any(map(text.is_identifier_name, ("width", "KEY", "sortkey", "paid", "fid")))
    row = spark.sql("SELECT TIMESTAMP '2026-01-31 15:30:00' AS t").select(text.run_id(F.col("t"))).first()
    assert row[0] == "20260201_003000_KST"


def test_grid(spark):
    got = grid.candidate_grid(spark, -500, -500, 750, 750).collect()
    assert {r["col"] for r in got} == {r["row"] for r in got} == {-1, 0, 1, 2} and len(got) == 16
    assert all((r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"]) == 250_000 for r in got)
    assert grid.candidate_grid(spark, 0, 0, 400, 400).count() == 0
    points = spark.createDataFrame([(10, 10), (250, 10), (250, 250), (-250, 500)], "x long, y long")
    many = grid.windows_of(points, F.col("x"), F.col("y"), F.col("x"), F.col("y")).groupBy("x", "y").count()
    assert {(r["x"], r["y"]): r["count"] for r in many.collect()} == {(10, 10): 4, (250, 10): 6, (250, 250): 9, (-250, 500): 9}


def test_codes(spark):
    one = spark.range(1)
    centre = one.select(codes.relative_code(F.lit(0.0), F.lit(0.0))).first()[0]
    assert centre == [0.0, 1.0, 0.0, 1.0] * 16
    assert codes.WAVELENGTHS[0] == 10 and abs(codes.WAVELENGTHS[-1] - 1000) < 1e-9 and codes.FREQUENCIES[0] == (0.5, 0.0) and len(codes.FREQUENCIES) == 128
    z = one.select(codes.segment_transform(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.6)).alias("z")).first()["z"]
    got = np.array([complex(w["re"], w["im"]) for w in z])
    assert np.abs(got - geometry.transform(("line", [np.array([(0.1, 0.2), (0.4, 0.6)])]))).max() < 1e-9
    m, p = one.select(codes.segment_transform(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.6)).alias("z")).select(codes.magnitude(F.col("z")), codes.phase(F.col("z"))).first()
    fm, fp = geometry.features(got)
    assert np.abs(np.array(m) - fm).max() < 1e-9 and np.abs(np.array(p) - fp).max() < 1e-6
    assert one.select(codes.all_close(F.array(F.lit(1.0), F.lit(None)), F.array(F.lit(1.0 + 1e-9), F.lit(None)))).first()[0]


SHAPE = ("polygon", [[np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float), np.array([(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], float), np.array([(6, 6), (8, 6), (8, 8), (6, 8), (6, 6)], float)]])
WEIGHTED = ("polygon", [[np.array([(1, 4), (3, 4), (3, 6), (1, 6), (1, 4)], float)], [np.array([(4, 1), (5, 1), (5, 2), (4, 2), (4, 1)], float)]])
LINES = ("line", [np.array([(-2, 2), (4, 2)], float), np.array([(6, 8), (12, 8)], float)])


def test_wkb_and_measures():
    for shape in (SHAPE, WEIGHTED, LINES, ("point", [np.array([(3, 4)], float)])):
        data = geometry.write_wkb(shape)
        assert geometry.write_wkb(geometry.read_wkb(data)) == data
    assert geometry.area(SHAPE) == 92 and geometry.area(WEIGHTED) == 5 and geometry.length(LINES) == 12
    assert geometry.representative(WEIGHTED) == pytest.approx((2.5, 4.3)) and geometry.representative(LINES) == (4, 2)
    with pytest.raises(ValueError, match="GeometryCollection"):
        geometry.read_wkb(b"\1" + (7).to_bytes(4, "little") + (0).to_bytes(4, "little"))
    turned = ("polygon", [[np.roll(r[:-1], 2, axis=0)[::-1][[*range(len(r) - 1), 0]] for r in p] for p in SHAPE[1]])
    assert geometry.write_wkb(geometry.normalized(turned)) == geometry.write_wkb(geometry.normalized(SHAPE))


def test_clip():
    window = (0, 0, 10, 10)
    cut = geometry.clip(geometry.rectangle(8, 2, 12, 6), *window)
    assert geometry.area(cut) == 8 and not geometry.clip(geometry.rectangle(10, 7, 12, 9), *window)[1]
    parts = geometry.clip(LINES, *window)
    assert [geometry.length(("line", [p])) for p in parts[1]] == [4, 4]
    c = ("polygon", [[np.array([(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10), (0, 0)], float)]])
    two = geometry.clip(c, 5, -1, 12, 12)
    assert len(two[1]) == 2 and geometry.area(two) == 20
    assert geometry.area(geometry.clip(SHAPE, 3, 3, 7, 7)) == 16 - 1 - 1


def test_clip_agrees_with_sampling():
    rng = np.random.default_rng(2)
    grid_ = np.stack(np.meshgrid(np.arange(0.05, 10, 0.1), np.arange(0.05, 10, 0.1)), -1).reshape(-1, 2)
    for _ in range(25):
        angles = np.sort(rng.uniform(0, 2 * np.pi, 12))
        ring = 5 + rng.uniform(1, 7, 12)[:, None] * np.stack([np.cos(angles), np.sin(angles)], 1)
        shape = ("polygon", [[np.vstack([ring, ring[:1]])]])
        cut = geometry.clip(shape, 0, 0, 10, 10)
        assert geometry.area(cut) == pytest.approx((geometry.locate(grid_, shape) > 0).sum() / 100, abs=2.5)
        assert sum(abs(geometry.signed_area(t)) for p in cut[1] for t in geometry.triangulate(p)) == pytest.approx(geometry.area(cut), abs=1e-9)


def test_locate():
    assert geometry.locate(np.array([(5, 5), (0, 5), (3, 3), (11, 1), (2, 3)], float), SHAPE).tolist() == [1, 0, -1, -1, 0]


@pytest.mark.parametrize("shape", [SHAPE, WEIGHTED])
def test_transform(shape):
    """Area at frequency zero; the sum over a fine grid elsewhere; moving a shape only turns phases."""
    w = np.array([(0.0, 0.0), (0.01, 0.02), (0.3, 0.1), (2.0, 1.0), (0.0, 5.0)])
    z = geometry.transform(shape, w)
    assert z[0] == pytest.approx(geometry.area(shape), abs=1e-9)
    g = (np.arange(1000) + 0.5) / 100
    points = np.stack(np.meshgrid(g, g), -1).reshape(-1, 2)
    inside = points[geometry.locate(points, shape) > 0]
    assert np.abs(z - np.array([np.exp(-2j * np.pi * (inside @ f)).sum() * 1e-4 for f in w])).max() < 1e-2
    moved = ("polygon", [[r + (3, -7) for r in p] for p in shape[1]])
    assert np.abs(geometry.transform(moved, w) - z * np.exp(-2j * np.pi * (w @ (3, -7)))).max() < 1e-8
    line = ("line", [np.array([(0, 0), (3, 4), (6, 0)], float)])
    assert geometry.transform(line, w[:1])[0] == 10


def test_wkb_columns(spark):
    rows = [(1, geometry.write_wkb(SHAPE)), (2, geometry.write_wkb(LINES)), (3, b"\1\7\0\0\0\0\0\0\0"), (4, None)]
    df = spark.createDataFrame(rows, "id int, g binary")
    got = {r["id"]: r["g"] for r in df.select("id", geometry.inspect(F.col("g")).alias("g")).collect()}
    assert (got[1]["kind"], got[1]["measure"], got[1]["vertices"]) == ("polygon", 92, 15) and got[2]["parts"] == 2
    assert "GeometryCollection" in got[3]["error"] and got[4]["kind"] is None
    two = df.filter("id < 3")
    cut = two.select(geometry.inspect(geometry.clip_wkb(F.col("g"), *(F.lit(v) for v in (0, 0, 5, 5)))).alias("c")).collect()
    assert [r["c"]["measure"] for r in cut] == [21, 4]
    assert df.filter("id = 1").select(geometry.covers_point(F.col("g"), F.lit(0), F.lit(5)), geometry.covers_point(F.col("g"), F.lit(0), F.lit(5), strict=True)).first()[:] == (True, False)
    z = df.filter("id = 1").select(geometry.fourier(F.col("g")).alias("z")).first()["z"]
    assert np.abs(np.array(z["re"]) + 1j * np.array(z["im"]) - geometry.transform(geometry.intrinsic(SHAPE))).max() < 1e-12


def test_encoder(spark):
    weights = encoder.drawn()
    assert encoder.digest(weights) == encoder.digest(encoder.drawn()) != encoder.digest(encoder.drawn(1))
    df = spark.range(5).select("id", codes.relative_code(F.col("id") * 10.0, F.col("id") * -3.0).alias("code"))
    out = {r["id"]: r["e"] for r in df.select("id", encoder.relative_embedding(spark, F.col("code"), weights).alias("e")).collect()}
    code = {r["id"]: r["code"] for r in df.collect()}
    for i in out:
        x = weights["f_rel"]["w1"] @ np.array(code[i], np.float32) + weights["f_rel"]["b1"]
        x = (x - x.mean()) / math.sqrt(x.var() + 1e-5)
        x = np.array([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
        assert np.abs(weights["f_rel"]["w2"] @ x + weights["f_rel"]["b2"] - np.array(out[i])).max() < 1e-4
    m, p = geometry.features(geometry.transform(geometry.intrinsic(SHAPE)))
    row = spark.createDataFrame([(m.tolist(), p.tolist())], "m array<double>, p array<double>").select(encoder.shape_embedding(spark, F.col("m"), F.col("p"), weights)).first()[0]
    assert len(row) == 128 and abs(np.mean(row)) < 1e-5 and abs(np.std(row) - 1) < 1e-2


def plain_hash(*fields):
    """SHA-256 of fields, each as N or as S, its length in 8 bytes and its UTF-8."""
    import hashlib

    return hashlib.sha256(b"".join(b"N" if f is None else b"S" + len(f.encode()).to_bytes(8, "big") + f.encode() for f in fields)).hexdigest()


def test_identities_hash_their_fields(spark):
    """Each identity against a digest of its list of fields, worked out without the library."""
    import hashlib

    row = spark.range(1).select(
        ids.window_id("d", "v1", "EPSG:5186", (0, "-12.50"), (500, 400.0), (250, 125), F.lit(-3), F.lit(7)).alias("window"),
        ids.block_id("b", "EPSG:5186", 2000.0, F.lit(1), F.lit(-2)).alias("block"),
        ids.observation_id(F.lit("w"), F.lit("poi"), F.lit("o")).alias("poi"), ids.observation_id(F.lit("w"), F.lit("road"), F.lit("o"), F.lit("p")).alias("road"),
        ids.clip_part_id(F.lit("LineString"), F.lit("a" * 64), F.lit(2)).alias("part"), ids.district_id(F.lit("s"), F.lit("gu"), F.lit("11010")).alias("district"),
        ids.node_id("n", F.lit("w"), F.lit("source"), F.lit("x"), F.lit(None)).alias("node"), ids.edge_id("e", F.lit("w"), F.lit("o"), F.lit("a"), F.lit("b")).alias("edge"),
        ids.relation_context_id(F.lit("w"), "g1").alias("context"), ids.relation_context_id(F.lit("w"), "g1", 2).alias("view"), ids.relation_id(F.lit("c"), F.lit("s"), F.lit("t"), F.lit("SN")).alias("relation"),
        ids.source_geometry_id(F.lit("o"), F.lit("f"), F.lit("g")).alias("geometry"),
    ).first()
    piped = lambda *f: hashlib.sha256("|".join(f).encode()).hexdigest()
    assert row.asDict() == {
        "window": plain_hash("d", "v1", "EPSG:5186", "0", "-12.5", "500", "400", "250", "125", "-3", "7"), "block": piped("b", "EPSG:5186", "2000", "1", "-2"), "poi": piped("w", "poi", "o"), "road": piped("w", "road", "o", "p"),
        "part": plain_hash("clip_part_id", "LineString", "a" * 64, "2"), "district": plain_hash("district_id", "s", "gu", "11010"), "node": plain_hash("n", "w", "source", "x", None), "edge": plain_hash("e", "w", "o", "a", "b"),
        "context": plain_hash("relation_context_id", "w", "original", None, "g1"), "view": plain_hash("relation_context_id", "w", "augmented", "2", "g1"), "relation": plain_hash("relation_id", "c", "s", "t", "SN"), "geometry": plain_hash("source_geometry_id", "o", "f", "g"),
    }


def test_array_paths_agree_with_the_parser(spark):
    """Boxes, other convex quadrilaterals, reversed ones and concave shapes: transforms, clips, measures and points inside."""
    shapes = [[(0, 0), (30, 0), (30, 20), (0, 20)], [(5, 5), (5, 45), (25, 45), (25, 5)], [(0, 0), (40, 10), (50, 60), (-10, 30)], [(0, 0), (40, 0), (10, 10), (0, 40)], [(0, 0), (10, 0), (10, 10)]]
    data = [geometry.write_wkb(("polygon", [[np.array([*s, s[0]], float)]])) for s in shapes] + [None]
    df = spark.createDataFrame([(i, d, 7.0, 9.0) for i, d in enumerate(data)], "i int, wkb binary, x double, y double").coalesce(1)
    w = np.array(geometry.FREQUENCIES)
    out = {r["i"]: r for r in df.select("i", geometry.fourier(F.col("wkb")).alias("z"), geometry.inspect(F.col("wkb")).alias("g"), geometry.clip_wkb(F.col("wkb"), F.lit(-1), F.lit(-1), F.lit(20), F.lit(15)).alias("cut"), geometry.covers_point(F.col("wkb"), F.col("x"), F.col("y")).alias("p")).collect()}
    for i, d in enumerate(data[:-1]):
        shape = geometry.read_wkb(d)
        z = geometry.transform(geometry.intrinsic(shape), w)
        assert np.allclose(out[i]["z"]["re"], z.real, atol=1e-9) and np.allclose(out[i]["z"]["im"], z.imag, atol=1e-9)
        assert [out[i]["g"][c] for c in ("kind", "parts", "vertices")] == ["polygon", 1, len(shapes[i]) + 1]
        assert [out[i]["g"][c] for c in ("measure", "x", "y", "xmin", "ymin", "xmax", "ymax")] == pytest.approx([geometry.area(shape), *geometry.representative(shape), *geometry.box(shape)])
        cut = geometry.clip(shape, -1, -1, 20, 15)
        assert bytes(out[i]["cut"]) == geometry.write_wkb(geometry.normalized(cut))
        assert out[i]["p"] == (geometry.locate(np.array([[7.0, 9.0]]), shape)[0] >= 0)
    assert out[5]["z"]["re"] is None or out[5]["z"] is None
    assert (out[5]["cut"], out[5]["p"]) == (None, None)


def test_segment_fourier_on_arrays(spark):
    """the kernel gives what the native expression gives, in one plan without interpreted lambdas; unknown ends give null."""
    ends = "(0.1, 0.2, 0.4, 0.6), (0.0, 0.0, 0.0, 0.0), (-3.5, 1.25, 2.0, 1.25), (0.25, 9.0, 0.25, -4.0)"
    df = spark.sql(f"SELECT * FROM VALUES {ends} AS t(a, b, c, d)")
    native = codes.segment_transform(*map(F.col, "abcd"))
    for r in df.select(native.alias("n"), codes.segment_fourier(*map(F.col, "abcd")).alias("z"), codes.segment_fourier(*map(F.col, "abcd"), places=6).alias("r")).collect():
        for part in ("re", "im"):
            exact = np.array([w[part] for w in r["n"]])
            assert np.abs(np.array(r["z"][part]) - exact).max() < 1e-12 and np.abs(np.array(r["r"][part]) - exact).max() <= 5.1e-7
    assert df.select(codes.segment_fourier(F.lit(None), *map(F.col, "bcd")).alias("z")).first()["z"]["re"] is None
    assert codes.rounded(np.array([-1e-9, 2.5e-6, -1.5e-6, 0.125])).tolist() == [0.0, 3e-6, -2e-6, 0.125] and not np.signbit(codes.rounded(np.array([-1e-9])))[0]
    from tesselon.plans import catalogue

    assert "transform(" not in catalogue.segment_fourier(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_boxes_have_their_closed_form(spark):
    """F8: axis-parallel boxes by their closed form, with an imaginary part of exactly 0; slanting ones and others by triangles."""
    wkb = [geometry.write_wkb(s) for s in (geometry.rectangle(3, 4, 40, 9), geometry.rectangle(0, 0, 1e-3, 700))]
    turned = ("polygon", [[np.array([(0, 0), (4, 2), (3, 4), (-1, 2), (0, 0)], float)]])
    bent = ("polygon", [[np.array([(0, 0), (40, 0), (40, 40), (20, 10), (0, 40), (0, 0)], float)]])
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate([*wkb, geometry.write_wkb(turned), geometry.write_wkb(bent)])] + [(4, None)], "i int, wkb binary")
    out = {r["i"]: r["z"] for r in df.select("i", geometry.fourier(F.col("wkb")).alias("z")).collect()}
    expected = geometry.transforms([geometry.intrinsic(s) for s in (geometry.rectangle(3, 4, 40, 9), geometry.rectangle(0, 0, 1e-3, 700), turned, bent)], np.array(codes.FREQUENCIES))
    for i in range(4):
        assert np.abs(np.array(out[i]["re"]) + 1j * np.array(out[i]["im"]) - expected[i]).max() < 1e-9
    assert set(out[0]["im"]) == set(out[1]["im"]) == {0.0} and out[4]["re"] is None
