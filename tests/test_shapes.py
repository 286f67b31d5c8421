"""Shape model, ring plane, planes, Jacobians, spectral libraries and entries of found rows on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import strings as S, vectors as V
from gridlore.operators import cameras, rings, shape, spectra
from gridlore.plans.ek import ek_fetch, ek_rows, ek_sql
from gridlore.plans.grid import Region
from gridlore.sources import library

GLOBE = Region(18, 36, 90.0, 0.0, 10.0, 10.0)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_rays_meet_the_map_its_gaps_and_nothing(spark):
    dem = spark.createDataFrame([(r, c, 11.0) for r in range(18) for c in range(36) if c != 20], "row int, col int, radius double")
    rays = spark.createDataFrame([(1, [100.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), (2, [100.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (3, [100 * math.cos(math.radians(205)), 100 * math.sin(math.radians(205)), 0.0], [-math.cos(math.radians(205)), -math.sin(math.radians(205)), 0.0])], "id int, p array<double>, d array<double>")
    got = {r.id: r for r in shape.surface(rays, dem, GLOBE, (10.0, 10.0, 10.0)).collect()}
    assert (got[1].lat, got[1].lon, got[1].radius) == (pytest.approx(0), pytest.approx(0), 11.0)
    assert got[1].normal == pytest.approx([1, 0, 0], abs=1e-9)
    assert got[2].lat is None and got[2].radius is None and got[2].normal is None
    assert got[3].radius == pytest.approx(10.0) and got[3].lon == pytest.approx(205)
    assert shape.surface(rays.limit(0), dem, GLOBE, (10.0, 10.0, 10.0)).count() == 0


def test_points_below_and_footprints(spark):
    r = one(spark, shape.sub_point(V.vec(0.0, -2.0, 2.0)), shape.ground_size(F.lit(100.0), F.lit(math.pi / 3), 0.01), shape.plane_hit(V.vec(0.0, 0.0, 1.0), V.vec(0.0, 0.0, 1.0), V.vec(0.0, 0.0, 1.0)))
    assert (r.c0.lat, r.c0.lon) == (pytest.approx(45), pytest.approx(270))
    assert r.c1.along == pytest.approx(2 * r.c1.across) and r.c2 is None


def test_a_camera_over_the_rings(spark):
    down = np.array([[1.0, 0, 0], [0, -1, 0], [0, 0, -1]])
    g = rings.fit_geometry(np.array([1000.0, 0.0, 5000.0]), down, (1e-4, 1e-4), 21, 31)
    # the middle pixel looks straight down, and a pixel is 0.5 wide there
    assert g.radius[0] + g.radius[1] * 15 + g.radius[2] * 10 + g.radius[3] * 150 == pytest.approx(1000, abs=0.01)
    assert g.radius[1] == pytest.approx(0.5, rel=1e-2)
    r = one(spark, rings.pixel_at(F.lit(1001.0), F.lit(0.0), g), rings.pixel_at(F.lit(2000.0), F.lit(0.0), g))
    assert r.c0.s == pytest.approx(17, abs=0.1) and r.c0.l == pytest.approx(10, abs=0.1) and r.c1 is None
    with pytest.raises(ValueError):
        rings.fit_geometry(np.array([1000.0, 0.0, 5000.0]), np.diag([1.0, 1.0, 1.0]), (1e-4, 1e-4), 21, 31)


def test_ring_maps_leave_out_pixels_without_data(spark):
    g = rings.Geometry((10.0, 0.0, 1.0, 0.0), (0.0, 1.0, 0.0, 0.0), 2, 2)
    image = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "row int, col int, z double")
    got = {(r.row, r.col): r.z for r in rings.to_ring_map(spark, image, g, Region(5, 1, 13.0, 0.0)).collect()}
    # half a pixel beyond the last line, the middle of all four, half a pixel before the first; nothing farther out
    assert [got[r, 0] for r in range(5)] == [None, 5.0, pytest.approx((1 + 3 + 5) / 3), 2.0, None]
    assert rings.to_ring_map(spark, image.limit(0), g, Region(3, 2, 12.0, 0.0)).where("z is not null").count() == 0


def test_ring_positions_and_back(spark):
    fwd = V.ring_cylindrical(F.lit(90.0), F.radians(F.lit(30.0)), 100.0, math.radians(10), True)
    r = one(spark, fwd, V.ring_cylindrical_inverse(fwd["x"], fwd["y"], 100.0, 10.0, True), V.ring_cylindrical(F.lit(0.0), F.lit(1.0), 100.0, 0.0))
    assert r.c0.y == pytest.approx(10) and r.c0.x < 0
    assert (r.c1.radius, r.c1.lon) == (pytest.approx(90), pytest.approx(30)) and r.c2.x is None


def test_rotations_there_and_back(spark):
    for axis, angle in (([1.0, 2.0, -2.0], 0.7), ([0.0, 1.0, 0.0], math.pi), ([3.0, 0.0, 4.0], math.pi), ([1.0, 1.0, 1.0], 0.0)):
        m = F.col("m")
        staged = spark.range(1).select(V.axis_to_matrix(V.vec(*axis), F.lit(angle)).alias("m")).select("m", V.inverse(m).alias("i"), V.matrix_to_quaternion(m).alias("q"))
        r = staged.select(m.alias("c0"), V.matrix_to_axis(m).alias("c1"), V.multiply(m, F.col("i")).alias("c2"), V.quaternion_to_matrix(F.col("q")).alias("c3")).first()
        assert r.c1.angle == pytest.approx(angle, abs=1e-7)
        if angle:
            assert np.abs(np.array(r.c1.axis)) == pytest.approx(np.abs(np.array(axis)) / np.linalg.norm(axis), abs=1e-7)
        assert r.c2 == pytest.approx(list(np.eye(3).ravel()), abs=1e-12)
        assert r.c3 == pytest.approx(r.c0, abs=1e-7)
    f = one(spark, V.frame_of(V.vec(0.0, 2.0, 0.0), V.vec(1.0, 5.0, 0.0)), V.inverse(V.vec(*range(9)))).asDict()
    assert f["c0"] == pytest.approx([0, 1, 0, 1, 0, 0, 0, 0, -1]) and f["c1"] is None


def test_jacobians_are_the_slopes_of_their_transforms(spark):
    at = (0.7, 0.4, 0.3)
    cases = [
        (lambda x: V.lat_to_rec(*x), lambda x: V.jacobian_lat(*x)),
        (lambda x: V.cyl_to_rec(*x), lambda x: V.jacobian_cyl(*x)),
        (lambda x: V.sph_to_rec(*x), lambda x: V.jacobian_sph(*x)),
        (lambda x: V.geo_to_rec(*x, 2.0, 0.1), lambda x: V.jacobian_geo(*x, 2.0, 0.1)),
    ]
    e = 1e-6
    for to, slopes in cases:
        moved = [[F.lit(v + (s * e if k == i else 0)) for i, v in enumerate(at)] for k in range(3) for s in (1, -1)]
        r = one(spark, slopes([F.lit(v) for v in at]), *[to(m) for m in moved])
        want = np.array([(np.array(r[1 + 2 * k]) - np.array(r[2 + 2 * k])) / (2 * e) for k in range(3)]).T.ravel()
        assert r.c0 == pytest.approx(list(want), abs=1e-7)
    assert one(spark, V.jacobian_from_rec(V.jacobian_cyl(F.lit(0.0), F.lit(1.0), F.lit(1.0)))).c0 is None


def test_planes(spark):
    pl = V.plane(V.vec(0.0, 0.0, -2.0), 6.0)
    r = one(spark, pl, V.on_plane(V.vec(1.0, 1.0, 1.0), pl), V.plane_spanned(V.vec(0.0, 0.0, 3.0), V.vec(1.0, 0.0, 0.0), V.vec(0.0, 1.0, 0.0)))
    assert r.c0.constant == 3 and r.c0.normal == pytest.approx([0, 0, -1])
    assert r.c1 == pytest.approx([1, 1, -3]) and r.c2.constant == pytest.approx(3)


def test_windows_match_within_the_tolerance():
    windows = [(1.01, 1.28), (1.74, 2.3)]
    assert spectra.match_window(1.02, windows, 0.03) == (1.01, 1.28)
    assert spectra.match_window(1.2, windows, 0.03) is None and spectra.match_window(1.0, [], 1.0) is None


def test_libraries_are_built_resampled_and_written(spark, tmp_path):
    (tmp_path / "axis.txt").write_text("axis\n1.0\n2.0\n3.0\n")
    (tmp_path / "a.txt").write_text("head\n0.1\n-1.23e34\n0.3\n")
    (tmp_path / "b.txt").write_text("h1\nh2\n1.0\t0.5\t9\n3.0 0.7\nbroken\n")
    axis = library.read_axis(spark, str(tmp_path / "axis.txt"))
    both = library.read_single(spark, str(tmp_path / "a.txt"), axis).unionByName(library.read_pairs(spark, str(tmp_path / "b.txt")))
    names = spark.createDataFrame([("a.txt", "olivine", "mafic", "x"), ("b.txt", "calcite", "carbonate", "y")], "file string, name string, class string, source string")
    lib = library.build(both, names)
    got = {r.name: (r.wavelengths, r["values"]) for r in lib.collect()}
    assert got == {"olivine": ([1.0, 3.0], [0.1, 0.3]), "calcite": ([1.0, 3.0], [0.5, 0.7])}
    bands = {r.name: r.bands for r in library.resample(lib, [0.5, 1.0, 2.0, 3.0]).collect()}
    assert bands["olivine"] == [None, 0.1, pytest.approx(0.2), 0.3]
    library.write(lib, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out" / "name=olivine"), wholetext=True).first()[0]
    assert text.splitlines() == ["# name=olivine  source=x  class=mafic", "wavelength_um,reflectance", "1.000000,0.10000000", "3.000000,0.30000000"]


def test_entries_by_row_and_element(spark):
    t = spark.createDataFrame([(k, [k, -k] if k % 3 else None) for k in range(20)], "a int, b array<int>").repartition(5)
    rows = ek_rows(ek_sql(spark, "SELECT A, B FROM T ORDER BY A DESC", {"T": t}))
    assert [r.A for r in rows.orderBy("row").collect()] == list(range(19, -1, -1))
    assert ek_fetch(rows, "B", 0, 1) == (-19, False, True)
    assert ek_fetch(rows, "b", 1) == (None, True, True) and ek_fetch(rows, "A", 20) == (None, False, False)
    assert ek_rows(ek_sql(spark, "SELECT A FROM T WHERE A > 99", {"T": t})).count() == 0


BALL = (10.0, 10.0, 10.0)
CAMERA = cameras.Camera((100.0, 0.0, 0.0), cameras.looking_at((100.0, 0.0, 0.0)), 50.0, 0.5, 31, 41, k1=1e-4)


def test_pixels_look_at_the_points_they_are_found_by(spark):
    planes = cameras.camera_planes(spark, CAMERA, (1.0, 0.0, 0.0), BALL)
    assert planes.count() == 31 * 41
    middle = planes.where("row = 15 and col = 20").first()
    assert (middle.lat, middle.radius, middle.emission, middle.incidence, middle.phase) == pytest.approx((0, 10, 0, 0, 0), abs=1e-6)
    assert middle.resolution == pytest.approx(0.9)
    assert planes.where("row = 0 and col = 0").first().lat is None
    hit = planes.where("lat is not null")
    back = hit.select("row", "col", cameras.pixel_of(shape.on_sphere(F.col("lat"), F.col("lon"), F.col("radius")), CAMERA).alias("x"))
    assert back.where("x is null or abs(x.s - col) > 1e-6 or abs(x.l - row) > 1e-6").count() == 0
    # north is up, east to the right
    up, right = planes.where("row = 12 and col = 20").first(), planes.where("row = 15 and col = 23").first()
    assert up.lat > 1 and 0 < right.lon < 90
    s = cameras.camera_summary(planes).first()
    assert s.pixels == 31 * 41 and s.on_body == hit.count() and s.least_lat == pytest.approx(-s.most_lat) and s.most_emission < 90


def test_maps_show_what_the_camera_sees(spark):
    image = spark.createDataFrame([(r, c, 7.0) for r in range(31) for c in range(41) if (r, c) != (15, 20)], "row int, col int, z double")
    got = {(r.row, r.col): r.z for r in cameras.to_map(spark, image, CAMERA, Region(2, 4, 60.0, -180.0, 60.0, 90.0), BALL).collect()}
    # columns are centred on longitudes -135, -45, 45 and 135: the far side is hidden
    assert [got[0, c] for c in range(4)] == [None, pytest.approx(7.0), pytest.approx(7.0), None]
    assert len(got) == 8
    assert cameras.to_map(spark, image.limit(0), CAMERA, Region(2, 4, 60.0, -180.0, 60.0, 90.0), BALL).where("z is not null").count() == 0


def test_the_widened_near_side(spark):
    e = math.radians(8)
    r = one(spark, V.libration_equal_area(F.lit(0.0), F.lit(0.0), 2.0, e), V.libration_equal_area(F.lit(math.pi / 2 + e), F.lit(0.0), 2.0, e), V.libration_equal_area_inverse(F.lit(2.1), F.lit(0.0), 2.0, e), V.libration_equal_area_inverse(F.lit(0.0), F.lit(0.0), 2.0, e))
    assert (r.c0.x, r.c0.y) == (0, 0) and r.c1.x == pytest.approx(2.0) and r.c2 is None and (r.c3.lon, r.c3.lat) == (0, 0)


def test_numbers_in_words_and_places_from_the_end(spark):
    cases = {0: ("ZERO", "ZEROTH"), 12: ("TWELVE", "TWELFTH"), -21: ("NEGATIVE TWENTY-ONE", "NEGATIVE TWENTY-FIRST"), 340: ("THREE HUNDRED FORTY", "THREE HUNDRED FORTIETH"), 1000: ("ONE THOUSAND", "ONE THOUSANDTH"), 7000100005: ("SEVEN BILLION ONE HUNDRED THOUSAND FIVE", "SEVEN BILLION ONE HUNDRED THOUSAND FIFTH")}
    for n, want in cases.items():
        r = one(spark, S.cardinal(F.lit(n)), S.ordinal_text(F.lit(n)))
        assert (r.c0, r.c1) == want
    t = F.lit("BOB, JOHN")
    r = one(spark, S.char_pos(t, "BO", 1), S.char_pos(t, "X"), S.char_pos_reverse(t, "O", 5), S.not_char_pos_reverse(t, "JOHN "), S.pos_reverse(t, "OB", 0), S.pos_reverse(t, "O"), S.not_char_pos(t, "BO"))
    assert list(r) == [1, -1, 1, 3, -1, 6, 3]
    r = one(spark, S.replace_number(F.lit("x=#"), "#", F.lit(1234.5), 3), S.replace_number(F.lit("x=#"), "#", F.lit(1234.5), 2, "F"), S.replace_logical(F.lit("#"), "#", F.lit(True), "C"), S.next_word(F.lit("  now is  it ")), S.decimal_at(F.lit("-1.5E3")), S.integer_at(F.lit("+7.1")), S.cardinal(F.lit(None).cast("long")))
    assert (r.c0, r.c1, r.c2, tuple(r.c3), r.c4, r.c5, r.c6) == ("x=1.23E+03", "x=1234.50", "True", ("now", "is  it "), "-1.5", "+7", None)
