"""Store, ephemeris, detection and pipeline operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.operators import detect, ephemeris
from gridlore.plans import ek_store, landing
from gridlore.plans.ek import ek_sql


def bowl(n, r0, c0, radius):
    return [(r, c, 5.0 * math.exp(-((math.hypot(r - r0, c - c0) - radius) ** 2) / 4) - 5.0 * (math.hypot(r - r0, c - c0) < radius - 2)) for r in range(n) for c in range(n)]


def test_store_keeps_order_and_changes(spark):
    seg = ek_store.load_rows(ek_store.begin_segment(spark, "a int, b string"), spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1))
    seg = ek_store.insert_at(seg, 1, {"a": 9})
    assert [(r.a, r.b) for r in seg.orderBy(ek_store.ORDINAL).collect()] == [(1, "x"), (9, None), (2, "y")]
    seg = ek_store.delete(ek_store.update(seg, F.col("a") == 9, b=F.lit("new")), F.col("a") == 1)
    ek_store.publish([seg.select("a", "b")], "ek_t")
    try:
        assert [(r.A, r.B) for r in ek_sql(spark, "select a, b from ek_t order by a").collect()] == [(2, "y"), (9, "new")]
        assert "ek_t" in ek_store.loaded(spark)
    finally:
        ek_store.unload(spark, "ek_t")
    assert ek_store.summary(seg) == [("a", "int", True, "1"), ("b", "string", True, "1")]


def test_chebyshev_and_states(spark):
    c = [0.5, -1.0, 0.25, 2.0]
    x = [-1.0, -0.3, 0.0, 0.7, 1.0]
    df = spark.createDataFrame([(v, c) for v in x], "x double, c array<double>")
    got = [r[0] for r in df.select(ephemeris.chebyshev(F.col("c"), F.col("x"))).collect()]
    assert got == pytest.approx(np.polynomial.chebyshev.chebval(x, c).tolist())
    seg = spark.createDataFrame([("m", 0.0, 10.0, [1.0, 1.0], [0.0], [2.0]), ("m", 10.0, 20.0, [5.0], [0.0], [2.0])], "object string, l double, r double, cx array<double>, cy array<double>, cz array<double>")
    t = spark.createDataFrame([("m", 5.0), ("m", 7.5), ("m", 15.0), ("m", 99.0)], "object string, t double")
    assert {r.t: r.position for r in ephemeris.states(t, seg, 7.0).collect()} == {5.0: [1.0, 0.0, 2.0], 7.5: [1.5, 0.0, 2.0], 15.0: [5.0, 0.0, 2.0]}


def test_pointing_between_samples(spark):
    q = lambda a: [math.cos(a / 2), 0.0, 0.0, math.sin(a / 2)]
    s = spark.createDataFrame([("f", 0.0, q(0.0)), ("f", 10.0, q(1.0)), ("f", 100.0, q(2.0))], "frame string, t double, q array<double>")
    t = spark.createDataFrame([("f", 0.0), ("f", 2.5), ("f", 50.0), ("f", 500.0)], "frame string, t double")
    got = {r.t: r.q for r in ephemeris.pointing(t, s, 20.0).collect()}
    assert got[0.0] == pytest.approx(q(0.0)) and got[2.5] == pytest.approx(q(0.25)) and got[50.0] is None and got[500.0] is None


def test_sun_is_north_in_june(spark):
    june = spark.range(1).select(ephemeris.sun_direction(F.lit((172 - 1.5) * 86400.0)).alias("v")).first().v
    assert math.degrees(math.asin(june[2])) == pytest.approx(23.44, abs=0.05) and math.hypot(*june) == pytest.approx(1)


def test_windows_and_roots(spark):
    s = spark.createDataFrame([("k", float(t), math.sin(t)) for t in np.arange(0, 12.6, 0.1)], "key string, t double, value double")
    got = sorted((r.l, r.r) for r in ephemeris.event_windows(s, 0.0).collect())
    assert got[0][1] == pytest.approx(math.pi, abs=1e-3) and got[1] == pytest.approx((2 * math.pi, 3 * math.pi), abs=1e-3)
    b = spark.createDataFrame([(3.0, 4.0)], "l double, r double")
    assert ephemeris.refine(b, np.sin, 1e-9).first().root == pytest.approx(math.pi)


def test_text_kernel():
    text = "intro X = 1\n\\begindata\nBODY1_RADII = ( 1.5D3, 2 3 )\nNAMES = ( 'A', 'it''s' )\n\\begintext\nX = 2\n\\begindata\nNAMES += 'C'\n"
    assert ephemeris.parse_kernel(text) == [("BODY1_RADII", "numeric", ["1.5E3", "2", "3"]), ("NAMES", "character", ["A", "it's", "C"])]


def test_detector_finds_the_bowl(spark):
    g = spark.createDataFrame(bowl(31, 15, 15, 7), "row int, col int, z double")
    best = detect.dem_candidates(g, [5.0, 7.0, 9.0], threshold=0.2).orderBy(F.desc("confidence")).first()
    assert abs(best.row - 15) <= 2 and abs(best.col - 15) <= 2 and best.r >= 7.0


def test_pairs_are_consumed_once(spark):
    cols = "id long, cx double, cy double, radius double, confidence double"
    dem = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.5), (2, 1.0, 0.0, 10.0, 0.9)], cols)
    img = spark.createDataFrame([(1, 1.0, 0.0, 10.0, 0.7), (2, 50.0, 0.0, 10.0, 0.7)], cols)
    assert [(r.dem_id, r.image_id) for r in detect.pair_detections(dem, img).collect()] == [(2, 1)]


def test_shift_is_found(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(32, 32))
    b = np.roll(a, (3, -2), (0, 1))
    rows = [(0, r, c, float(a[r, c]), float(b[r, c])) for r in range(32) for c in range(32)]
    got = detect.shift_between(spark.createDataFrame(rows, "tile int, row int, col int, a double, b double"), window=False).first()
    assert (round(got.drow, 1), round(got.dcol, 1)) == (3.0, -2.0)


def test_shading_gives_back_a_tilt(spark):
    s = (0.3, 0.0, 1.0)
    p = 0.2
    shade = (-p * s[0] + s[2]) / math.sqrt(1 + p * p) / math.hypot(*s)
    rows = [(0, r, c, shade) for r in range(8) for c in range(8)]
    h = {(r.row, r.col): r.height for r in detect.photoclinometry(spark.createDataFrame(rows, "tile int, row int, col int, z double"), s, rounds=400).collect()}
    assert h[4, 5] - h[4, 4] == pytest.approx(p, abs=0.05)


def test_landing_resumes(spark, tmp_path):
    dem = spark.createDataFrame([(r, c, float((r * 7 + c * 3) % 5)) for r in range(12) for c in range(12)], "row int, col int, z double")
    sun = spark.createDataFrame([(0, 90.0, 30.0), (1, 270.0, 20.0)], "step int, azimuth double, elevation double")
    plan = landing.stages(landing.Mission(10.0, max_slope=80.0, least_light=0.0), [0.0, 90.0, 180.0, 270.0], 3, sun)
    first = landing.run(spark, dem, plan, str(tmp_path))["ranking"].collect()
    calls = []
    watched = [(n, lambda g, n=n, f=f: calls.append(n) or f(g)) for n, f in plan]
    again = landing.run(spark, dem, watched, str(tmp_path))["ranking"].collect()
    assert calls == [] and sorted(first) == sorted(again) and first


def test_cross_is_perpendicular(spark):
    a, b = V.vec(1.0, 2.0, 3.0), V.vec(-2.0, 0.5, 4.0)
    assert spark.range(1).select(V.dot(V.cross(a, b), a)).first()[0] == pytest.approx(0)


def test_images_with_xml_labels_and_cubes(spark, tmp_path):
    from gridlore.sources import xml_images as X

    label = """<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1"><File_Area_Observational><File><file_name>a.dat</file_name></File>
    <Array_2D_Image><offset unit="byte">4</offset><Axis_Array><axis_name>Line</axis_name><elements>2</elements></Axis_Array>
    <Axis_Array><axis_name>Sample</axis_name><elements>3</elements></Axis_Array><Element_Array><data_type>SignedMSB2</data_type><scaling_factor>2</scaling_factor><value_offset>1</value_offset></Element_Array>
    <Special_Constants><missing_constant>-9</missing_constant></Special_Constants></Array_2D_Image></File_Area_Observational></Product_Observational>"""
    d = tmp_path / "x"
    d.mkdir()
    (d / "a.xml").write_text(label)
    (d / "a.dat").write_bytes(b"head" + np.array([[1, 2, -9], [4, 5, 6]], ">i2").tobytes())
    got = {(r.row, r.col): r.value for r in X.read_xml_images(spark, str(d)).collect()}
    assert got == {(0, 0): 3.0, (0, 1): 5.0, (0, 2): None, (1, 0): 9.0, (1, 1): 11.0, (1, 2): 13.0}
    cells = spark.createDataFrame([(1, r, c, b, None if r == c else float(r + 10 * c + 100 * b)) for r in range(3) for c in range(4) for b in (1, 2)], "tile int, row int, col int, band int, value double")
    content = X.encode_cubes(cells).first().content
    (tmp_path / "c.cub").write_bytes(content)
    back = {(r.row, r.col, r.band): r.value for r in X.read_cubes(spark, str(tmp_path / "c.cub")).collect()}
    assert back == {(r.row, r.col, r.band): r.value for r in cells.collect()}


def test_exponential_integral(spark):
    from gridlore.operators.cells import exponential_integral

    got = spark.range(1).select(exponential_integral(2, F.lit(0.5)).alias("a"), exponential_integral(3, F.lit(1.0)).alias("b")).first()
    assert got.a == pytest.approx(0.3266439, abs=1e-5) and got.b == pytest.approx(0.1096920, abs=1e-5)


def test_wall_hides_what_lies_behind(spark):
    from gridlore.operators.focal import viewshed

    rows = [(r, c, 10.0 if c == 3 else 0.0) for r in range(3) for c in range(7)]
    got = {(r.row, r.col): r.visible for r in viewshed(spark.createDataFrame(rows, "row int, col int, z double"), 1, 0, 1.0).collect()}
    assert got[1, 2] == 1 and got[1, 3] == 1 and got[1, 5] == 0


def test_labels_apart_from_their_data(spark, tmp_path):
    """Attached and detached labels, a long label, data of one name in two folders, cubes beside them."""
    import numpy as np

    from gridlore.sources import pds, xml_images

    x = np.arange(12, dtype="<i2")
    image = {"IMAGE.LINES": 3, "IMAGE.LINE_SAMPLES": 4, "IMAGE.SAMPLE_BITS": 16, "IMAGE.SAMPLE_TYPE": "LSB_INTEGER"}
    for folder, add in (("a", 0), ("b", 100)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "D.IMG").write_bytes(b"\0" * 8 + (x + add).astype("<i2").tobytes())
        (tmp_path / folder / "d.lbl").write_text(pds.write_label({"RECORD_BYTES": 8, "^IMAGE": '("D.IMG", 2)', **image}))
    note = "/* " + "long " * 300_000 + "*/"
    head = pds.write_label({"RECORD_BYTES": 1, "NOTE": f'"{note}"', "^IMAGE": "2000000 <BYTES>", **image}).encode()
    (tmp_path / "a" / "whole.img").write_bytes(head.ljust(1_999_999, b" ") + (x + 7).astype("<i2").tobytes())
    got = {}
    for r in pds.read_images(spark, f"{tmp_path}/*").collect():
        got.setdefault("/".join(r.path.split("/")[-2:]), {})[r.row, r.col] = r.value
    assert set(got) == {"a/d.lbl", "b/d.lbl", "a/whole.img"}
    for name, add in (("a/d.lbl", 0), ("b/d.lbl", 100), ("a/whole.img", 7)):
        assert got[name] == {(k // 4, k % 4): k + add for k in range(12)}
    cells = spark.createDataFrame([(0, 0, 0, 1, 2.5)], "tile int, row int, col int, band int, value double")
    (tmp_path / "a" / "c.cub").write_bytes(bytes(xml_images.encode_cubes(cells).first().content))
    values = {r.path.rsplit("/", 1)[1]: r.value for r in pds.read_any(spark, f"{tmp_path}/a", 10.0).where("row = 0 and col = 0").collect()}
    assert values == {"d.lbl": 0.0, "whole.img": 70.0, "c.cub": 25.0}


def test_mosaic_takes_the_first_tile_with_data_and_fills(spark):
    from gridlore.sources.dem import mosaic

    rows = [(1, 0, 0, None), (1, 0, 1, 4.0), (2, 0, 0, 900.0), (2, 0, 1, 800.0), (2, 0, 2, None)]
    t = spark.createDataFrame(rows, "tile int, row int, col int, z double")
    assert {(r.row, r.col): r.z for r in mosaic(t).collect()} == {(0, 0): 900.0, (0, 1): 4000.0, (0, 2): None}
    assert {(r.row, r.col): r.z for r in mosaic(t, fill=3).collect()}[0, 2] == 4000.0


def test_clock_ticks_take_the_calibration_at_or_before(spark, monkeypatch):
    from gridlore.functions import times

    c = spark.createDataFrame([(0, 100.0, 1.0), (10, 200.0, 2.0), (20, 300.0, 0.5)], "tick0 long, et0 double, rate double")
    t = spark.createDataFrame([(-1,), (0,), (9,), (10,), (15,), (20,), (1000,)], "tick long")
    want = {0: 100.0, 9: 109.0, 10: 200.0, 15: 210.0, 20: 300.0, 1000: 790.0}
    assert {r.tick: r.et for r in times.clock_to_et(t, c).collect()} == want
    monkeypatch.setattr(times, "MOST_CALIBRATIONS", 1)
    assert {r.tick: r.et for r in times.clock_to_et(t, c).collect()} == want


def test_ages_at_fixed_densities(spark):
    """Densities of craters of 1 km or more per km2 at known ages."""
    from gridlore.functions.bodies import age_from_density

    known = [(8.38e-4 + 5.44e-14 * (1022.49 - 1), 1.0), (2.933e-3 + 5.44e-14 * 3.4187e10, 3.5), (3.352e-3 + 5.44e-14 * 1.09299e12, 4.0)]
    got = spark.createDataFrame(known, "n double, t double").select("t", age_from_density(F.col("n")).alias("age")).collect()
    assert all(abs(r.age - r.t) < 1e-3 for r in got) and len(got) == 3


def test_refinement_finds_the_rim_and_the_chain_keeps_it(spark):
    """A round wall off the detector's stride, over several tiles."""
    from gridlore.operators import detect

    r, c = np.indices((90, 80))
    d = np.hypot(r - 45.0, c - 40.0)
    z = 20.0 * np.exp(-((d - 20.0) ** 2) / 8)
    g = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i, j in np.ndindex(z.shape)], "row int, col int, z double")
    rows = [(1, 43.0, 42.0, 18.5, "dem"), (2, 43.0, 42.0, 18.5, "image"), (3, 5.0, 5.0, 1.5, "dem")]
    got = {x.id: x for x in detect.refine(g, spark.createDataFrame(rows, "id long, cx double, cy double, radius double, method string")).collect()}
    assert math.hypot(got[1].cx - 40, got[1].cy - 45) < 1.6 and abs(got[1].radius - 20) < 1.2
    assert (got[2].cx, got[2].cy, got[2].radius) == (43.0, 42.0, 18.5) and got[3].radius == 1.5
    dd = spark.createDataFrame([(int(k), int(j), 0.11) for k in range(30, 60) for j in range(25, 55)], "row int, col int, dd double")
    best = detect.draw(g, [20.0], 0.3, dd_map=dd).orderBy("confidence", ascending=False).first()
    assert math.hypot(best.cx - 40, best.cy - 45) < 2.5 and best.dD_simple == 0.11 and best.n_methods == 1
    with pytest.raises(ValueError):
        detect.draw(g, [17.0], body="nowhere")


def test_image_detector_finds_a_lit_ring(spark):
    """Bright to the sun (east), dark on the other side, even within."""
    from gridlore.operators import detect

    r, c = np.indices((40, 40))
    d, a = np.hypot(r - 21.0, c - 20.0), np.arctan2(-(r - 21.0), c - 20.0)
    z = 100 + 50 * np.cos(a) * np.exp(-((d - 8.0) ** 2) / 3)
    g = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i, j in np.ndindex(z.shape)], "row int, col int, z double")
    at = lambda sun: {(x.row, x.col): x.confidence for x in detect.image_candidates(g, [8.0], sun, 0.1).collect()}
    assert at(90.0)[20, 20] > 0.5 and (20, 20) not in at(270.0)  # the same ring lit from the west is no crater


def test_kmeans_tells_groups_apart(spark):
    from gridlore.operators import spectra

    rng = np.random.default_rng(3)
    rows = [(g * 20 + k, (np.eye(3)[g] * 50 + rng.normal(size=3)).tolist()) for g in range(3) for k in range(20)]
    got = {r.id: r.label for r in spectra.kmeans(spark.createDataFrame(rows, "id int, b array<double>"), "b", 3).collect()}
    assert [len({got[g * 20 + k] for k in range(20)}) for g in range(3)] == [1, 1, 1] and set(got.values()) == {1, 2, 3}
