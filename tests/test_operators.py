"""Operators on small hand-made inputs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import strings, vectors
from gridlore.operators import cells, connectivity, craters, decision, focal, intervals, spectra
from gridlore.plans import queries_intervals
from gridlore.plans.ek import EkError, ek_find, ek_select_items, ek_sql
from gridlore.plans.grid import Region, sample_at, to_bands, to_long
from gridlore.queries import QUERIES
from gridlore.sources import catalogues, pds
from gridlore.streaming.sessions import sessions


def grid(spark, rows):
    return spark.createDataFrame([(r, c, None if z is None else float(z)) for r, line in enumerate(rows) for c, z in enumerate(line)], "row int, col int, z double")


def as_map(df, *cols):
    return {(r["row"], r["col"]): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


# --- dialect ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(spark):
    return {"ev": spark.createDataFrame([(1, "Start", 2.5, [1, 2]), (2, None, 3.0, [3]), (3, "stop 'x'", None, [])], "id int, kind string, v double, many array<int>")}


def test_ek_null_and_quotes(spark, events):
    assert [r.ID for r in ek_sql(spark, "select id from ev where kind = NULL", events).collect()] == [2]
    assert [r.ID for r in ek_sql(spark, "select id from ev where kind != NULL and not v is null", events).collect()] == [1]
    assert [r.ID for r in ek_sql(spark, "select id from ev where kind = 'stop ''x'''", events).collect()] == [3]


def test_ek_orders_nulls_lowest(spark, events):
    assert [r.ID for r in ek_sql(spark, "select id from ev order by v", events).collect()] == [3, 1, 2]
    assert [r.ID for r in ek_sql(spark, "select id from ev order by v desc", events).collect()] == [2, 1, 3]


def test_ek_like_ignores_case(spark, events):
    assert [r.ID for r in ek_sql(spark, "select id from ev where kind like 'ST%RT'", events).collect()] == [1]


@pytest.mark.parametrize("text", ["", "select", "select id from", "select id from ev where", "select id from ev where 3 < id", "select id from ev where id = 'a'", "select nope from ev", "select id from nope", "select id from ev x, ev x", "select id from ev where many = 1", "select id from ev order by", "select id from ev where kind like id", "select id from ev where id ~ 3", "select id from ev extra words"])
def test_ek_errors_are_returned(spark, events, text):
    n, error, message = ek_find(spark, text, events)
    assert (n, error) == (0, True) and message


def test_ek_limits(spark, events):
    with pytest.raises(EkError):
        ek_sql(spark, "select " + ",".join(["id"] * 51) + " from ev", events)
    with pytest.raises(EkError):
        ek_sql(spark, "select id from ev where kind = '" + "x" * 2000 + "'", events)


def test_ek_items(spark, events):
    assert ek_select_items(spark, "select e.id, e.v from ev e", events) == [("EV", "ID", "int"), ("EV", "V", "double")]


# --- cells ------------------------------------------------------------------------------------------


def test_change_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 2.0), (None, 1.0), (-1.0, 1.0)], "a double, b double")
    assert [r.change for r in cells.detect_change(df, method="ratio").collect()] == [3.0, None, None, -1.0]
    assert [r.change for r in cells.detect_change(df, method="log_ratio").collect()][1:] == [None, None, None]
    assert [r.mask for r in cells.detect_change(df, threshold=2.0).collect()] == [1, 1, None, 1]


def test_focal_truncates_and_skips_nulls(spark):
    g = grid(spark, [[1, 2, 3], [4, None, 6], [7, 8, 9]])
    got = as_map(focal.focal(g, 3).withColumn("m", focal.mean()), "m", "f_n")
    assert got[0, 0] == pytest.approx((7 / 3, 3)) and got[1, 1] == (5.0, 8)


def test_slope_of_a_ramp(spark):
    g = grid(spark, [[c * 2.0 for c in range(5)] for _ in range(4)])
    got = as_map(focal.slope(g, 1.0, 1.0), "slope", "aspect")
    assert got[1, 2] == pytest.approx((math.degrees(math.atan(2)), 90.0))
    assert got[1, 0][0] == pytest.approx(math.degrees(math.atan(1)))  # an edge still divides by two cells


def test_flat_ground_has_no_horizon_and_pillar_has_45(spark):
    flat = grid(spark, [[0.0] * 9 for _ in range(9)])
    assert {r.height for r in focal.horizon(flat, [0.0, 90.0], 1.0, 5).collect()} == {0.0}
    rows = [[0.0] * 9 for _ in range(9)]
    rows[4][5] = 1.0
    got = {(r.row, r.col): r.height for r in focal.horizon(grid(spark, rows), [0.0], 1.0, 5).collect()}
    assert got[4, 4] == pytest.approx(45.0) and got[4, 6] == 0.0


def test_shadow_falls_away_from_the_sun(spark):
    rows = [[0.0] * 7 for _ in range(3)]
    rows[1][3] = 5.0
    lit = as_map(focal.shadow(grid(spark, rows), 90.0, 45.0, reach=6), "lit")
    assert lit[1, 2] == 0 and lit[1, 0] == 0 and lit[1, 4] == 1 and lit[0, 2] == 1
    assert {r.lit for r in focal.shadow(grid(spark, rows), 90.0, -1.0).collect()} == {0}


def test_rays_reach_the_edge_of_the_grid(spark):
    g = grid(spark, [[0.0] * 125 + [200.0] + [0.0] * 4])
    assert as_map(focal.shadow(g, 90.0, 45.0), "lit")[0, 0] == 0
    got = {(r.row, r.col): r.height for r in focal.horizon(g, [0.0]).collect()}
    assert got[0, 0] == pytest.approx(math.degrees(math.atan(200 / 125)))


def test_clump_corner_contact(spark):
    g = grid(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).withColumn("z", F.col("z").cast("int"))
    assert connectivity.clump(g).where("z = 1").select("clump").distinct().count() == 3
    assert connectivity.clump(g, diagonal=True).where("z = 1").select("clump").distinct().count() == 1


def test_label_rounds_equal_the_driver_s(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(500, 530)], "a long, b long")
    near = sorted(map(tuple, connectivity.label(links).collect()))
    monkeypatch.setattr(connectivity, "LOCAL_LINKS", 0)
    assert sorted(map(tuple, connectivity.label(links).collect())) == near


def test_clump_snake(spark):
    rows = [[1, 1, 1, 1], [0, 0, 0, 1], [1, 1, 1, 1], [1, 0, 0, 0], [1, 1, 1, 1]]
    assert connectivity.clump(grid(spark, rows)).where("z = 1").select("clump").distinct().count() == 1


def test_bands_round_trip(spark):
    long = spark.createDataFrame([(0, 0, 2, 5.0), (0, 0, 1, 4.0)], "row int, col int, band int, value double")
    assert to_bands(long).first().bands == [4.0, 5.0]
    assert sorted(map(tuple, to_long(to_bands(long)).collect())) == [(0, 0, 1, 4.0), (0, 0, 2, 5.0)]


def test_points_sample_their_cell(spark):
    g = grid(spark, [[1, 2], [3, 4]])
    p = spark.createDataFrame([(1.5, 0.5), (9.0, 9.0)], "x double, y double")
    assert [r.z for r in sample_at(p, g, Region(2, 2, 2.0, 0.0)).orderBy("x").collect()] == [4.0, None]


def hapke_rough(i, e, g, w, h, b0, theta, bh, ch):
    i, e, g, t = map(math.radians, (i, e, g, theta))
    m0, m = math.cos(i), math.cos(e)
    if m0 <= 0:
        return 0.0
    gam = math.sqrt(1 - w)
    H = lambda x: (1 + 2 * x) / (1 + 2 * x * gam)
    B = b0 / (1 + math.tan(g / 2) / h)
    P = 1 + bh * math.cos(g) + ch * (1.5 * math.cos(g) ** 2 - 0.5)
    chi = 1 / math.sqrt(1 + math.pi * math.tan(t) ** 2)
    cot = lambda x: math.cos(x) / max(math.sin(x), 1e-10)
    E1 = lambda x: math.exp(min(-(cot(t) ** 2) * cot(x) ** 2 / math.pi, 23))
    E2 = lambda x: math.exp(min(-2 * cot(t) * cot(x) / math.pi, 23))
    ss = math.sin(i) * math.sin(e)
    psi = math.acos(1.0 if ss == 0 else max(-1.0, min(1.0, (math.cos(g) - m0 * m) / ss)))
    f = 0.0 if psi >= math.pi else math.exp(min(-2 * math.tan(psi / 2), 23))
    eta = lambda x: chi * (math.cos(x) + math.sin(x) * math.tan(t) * E1(x) / (2 - E2(x)))
    s2, part = math.sin(psi / 2) ** 2, psi / math.pi
    if i <= e:
        d = 2 - E2(e) - part * E2(i)
        x0 = chi * (m0 + math.sin(i) * math.tan(t) * (math.cos(psi) * E1(e) + s2 * E1(i)) / d)
        x = chi * (m + math.sin(e) * math.tan(t) * (E1(e) - s2 * E1(i)) / d)
        q = chi * m0 / eta(i)
    else:
        d = 2 - E2(i) - part * E2(e)
        x0 = chi * (m0 + math.sin(i) * math.tan(t) * (E1(i) - s2 * E1(e)) / d)
        x = chi * (m + math.sin(e) * math.tan(t) * (math.cos(psi) * E1(i) + s2 * E1(e)) / d)
        q = chi * m / eta(e)
    single = w / 4 * x0 / (x0 + x) * ((1 + B) * P - 1 + H(x0) * H(x))
    return single * x / eta(e) * m0 / eta(i) * chi / (1 - f + f * q)


def test_rough_hapke_equals_plain_python(spark):
    angles = [(10.0, 20.0, 15.0), (50.0, 30.0, 70.0), (30.0, 60.0, 40.0), (95.0, 10.0, 85.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(angles, "i double, e double, g double")
    got = [r.f for r in cells.hapke_rough(df, "i", "e", "g", "f", 0.3, 0.05, 1.0, 20.0, bh=0.3, ch=0.1).collect()]
    assert got == pytest.approx([hapke_rough(*a, 0.3, 0.05, 1.0, 20.0, 0.3, 0.1) for a in angles], rel=1e-9)


def test_bond_integral_of_a_constant():
    assert cells.bond_phase_integral(lambda g: 1.0) == pytest.approx(4.0, rel=1e-3)


# --- craters ----------------------------------------------------------------------------------------


def test_nms_keeps_the_stronger(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.9, "dem"), (2, 1.0, 0.0, 10.0, 0.8, "image"), (3, 2.0, 0.0, 10.0, 0.7, "dem"), (4, 90.0, 0.0, 5.0, 0.1, "dem")], "id long, cx double, cy double, radius double, confidence double, method string")
    got = {r.id: (r.method, r.n_methods) for r in craters.suppress(c).collect()}
    assert got == {1: ("merged", 2), 4: ("dem", 1)}


def test_nms_decides_a_chain_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(craters, "range", lambda n: [0], raising=False)  # one round, as if the chain were longer than any count of rounds
    c = spark.createDataFrame([(k, 8.0 * k, 0.0, 10.0, 1 - 0.1 * k, "dem") for k in range(6)], "id long, cx double, cy double, radius double, confidence double, method string")
    assert {r.id for r in craters.suppress(c).collect()} == {0, 2, 4}


def test_nms_holds_the_strongest_of_equal_disks_against_each_other(spark, monkeypatch):
    kinds = "id long, cx double, cy double, radius double, confidence double, method string"
    rows = [(k, 10.0 * (k % 7), 10.0 * (k % 3), 10.0 + 4 * (k % 5), None if k % 97 == 0 else (k * 7919 % 211) / 211, "dem" if k % 2 else "image") for k in range(1500)] + [(1500, None, 0.0, 9.0, 0.5, "dem")]

    def iou(p, q):
        d, r, s = math.hypot(p[1] - q[1], p[2] - q[2]), p[3], q[3]
        if d >= r + s:
            return 0.0
        lens = lambda r, s: r * r * math.acos((d * d + r * r - s * s) / (2 * d * r))
        kite = 0.5 * math.sqrt(max(0.0, (-d + r + s) * (d + r - s) * (d - r + s) * (d + r + s)))
        common = math.pi * min(r, s) ** 2 if d <= abs(r - s) else lens(r, s) + lens(s, r) - kite
        return common / (math.pi * (r * r + s * s) - common)

    kept, first = [], {}
    for c in sorted(rows[:-1], key=lambda c: (math.inf if c[4] is None else -c[4], c[0])):
        over = [k for k in kept if iou(k, c) >= 0.3]
        first[c] = min(over, key=lambda k: k[0], default=None)
        kept += [] if over else [c]
    more = {k[0]: sum(o is k and c[5] != k[5] for c, o in first.items()) for k in kept}
    want = {k[0]: ("merged" if more[k[0]] else k[5], 1 + more[k[0]]) for k in kept} | {1500: ("dem", 1)}
    met, plain = [], craters.overlapping
    monkeypatch.setattr(craters, "overlapping", lambda a, b, reach: met.append((a.count(), b.count())) or plain(a, b, reach))
    got = {r.id: (r.method, r.n_methods) for r in craters.suppress(spark.createDataFrame(rows, kinds)).collect()}
    assert got == want
    assert met == [(105, 105), (len(kept), 1500)]  # 1,500 candidates are 105 disks


def test_multi_rings(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 0.5, 0.0, 20.0), (3, 0.0, 0.5, 21.0), (4, 200.0, 0.0, 10.0)], "id long, cx double, cy double, radius double")
    got = {r.id: (r.basin_id, r.ring_index) for r in craters.multi_rings(c).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (None, None), 4: (None, None)}


def test_overlaps_of_equal_disks_are_worked_out_once(spark):
    at = [(0.0, 0.0, 10.0), (5.0, 0.0, 8.0), (30.0, 0.0, 2.0)]
    rows = [(k, *at[k % 2]) for k in range(600)] + [(600, *at[2]), (601, None, 0.0, 5.0), (602, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, "id long, cx double, cy double, radius double")
    blocks = craters.overlapping_blocks(c, c, 20.0)
    assert blocks.count() == 4 * 4 + 1  # 300 rows of a disk are two blocks
    got = craters.overlapping(c, c, 20.0)
    assert got.columns == [f"{s}_{x}" for s in "ab" for x in c.columns] + ["iou"]
    want = {(a, b): 1.0 if a % 2 == b % 2 else 0.455391 for a in range(600) for b in range(600)} | {(600, 600): 1.0}
    assert {(r.a_id, r.b_id): round(r.iou, 6) for r in got.collect()} == want
    assert [tuple(r) for r in got.where("a_id = 3 and b_id = 4").select("a_cx", "a_radius", "b_cx", "b_radius").collect()] == [(5.0, 8.0, 0.0, 10.0)]


@pytest.mark.parametrize("ratio", [1.3, 1.0])
def test_rings_link_only_disks_that_can_share_a_basin(spark, monkeypatch, ratio):
    draw = np.random.default_rng(5)
    rows = [(k, 12.0 * (k % 5), 12.0 * (k % 3), 10.0 + 4 * (k % 7)) for k in range(800)]  # each disk many times over
    rows += [(800 + k, float(x), float(y), float(r)) for k, (x, y, r) in enumerate(zip(draw.uniform(300, 340, 150), draw.uniform(0, 40, 150), draw.uniform(5, 40, 150)))]
    place = {r[0]: r[1:] for r in rows}

    def fit(a, b):
        (x, y, r), (u, v, s) = place[a], place[b]
        return math.hypot(u - x, v - y) <= 0.3 * min(r, s)

    apart = lambda a, b: max(place[a][2], place[b][2]) / min(place[a][2], place[b][2]) >= ratio
    want = {}
    for seed in place:
        if seed not in want:
            ring = [seed]
            for other in place:
                if other not in want and other != seed and fit(seed, other) and all(apart(other, m) for m in ring):
                    ring.append(other)
            if len(ring) > 1:
                want |= {m: (seed, k) for k, m in enumerate(sorted(ring, key=lambda m: place[m][2]), 1)}
    seen, plain = [], connectivity.label
    monkeypatch.setattr(connectivity, "label", lambda links: seen.append(links.count()) or plain(links))
    c = spark.createDataFrame([*rows, (999, None, 0.0, 5.0)], "id long, cx double, cy double, radius double")
    got = {r.id: (r.basin_id, r.ring_index) for r in craters.multi_rings(c, ratio=ratio).collect()}
    assert got == {k: want.get(k, (None, None)) for k in [*place, 999]}
    first = {at: k for k, at in reversed(place.items())}.values()
    assert seen == [sum(a <= b and fit(a, b) and apart(a, b) for a in first for b in first)]


def test_polygon_area(spark):
    ring = spark.sql("select array(named_struct('x',0.0D,'y',0.0D),named_struct('x',2.0D,'y',0.0D),named_struct('x',2.0D,'y',1.0D),named_struct('x',0.0D,'y',1.0D)) r")
    assert ring.select(craters.polygon_area(F.col("r"))).first()[0] == 2.0


# --- intervals ---------------------------------------------------------------------------------------


def test_interval_rules(spark):
    rows = spark.createDataFrame([("k", 1.0, 3.0), ("k", 3.0, 4.0), ("k", 6.0, 7.0), ("k", 9.0, 8.0)], "key string, l double, r double")
    m = intervals.merge(rows)
    assert sorted((r.l, r.r) for r in m.collect()) == [(1.0, 4.0), (6.0, 7.0)]
    assert [(r.l, r.r) for r in intervals.fill(m, 2.0).collect()] == [(1.0, 7.0)]
    assert sorted((r.l, r.r) for r in intervals.complement(m, 0.0, 10.0).collect()) == [(0.0, 1.0), (4.0, 6.0), (7.0, 10.0)]
    other = spark.createDataFrame([("k", 2.0, 6.5)], "key string, l double, r double")
    assert sorted((r.l, r.r) for r in intervals.intersect(m, other).collect()) == [(2.0, 4.0), (6.0, 6.5)]
    assert sorted((r.l, r.r) for r in intervals.difference(m, other, 0.0, 10.0).collect()) == [(1.0, 2.0), (6.5, 7.0)]
    s = intervals.summary(m).first()
    assert (s.n, s.measure, s.shortest, s.longest) == (2, 4.0, 1.0, 3.0)


def test_difference_keeps_points(spark):
    kind = "key string, l double, r double"
    a = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 2.0), ("k", 2.5, 2.5), ("k", 4.0, 4.0), ("k", 4.5, 6.0), ("k", 7.0, 7.0), ("k", 8.0, 9.0), ("o", 3.0, 3.0), ("o", 5.0, 6.0), ("t", 1.0, 2.0), ("t", 2.0, 3.0)], kind)
    b = spark.createDataFrame([("k", 2.0, 4.0), ("k", 5.0, 5.0), ("k", 6.0, 6.5), ("k", 7.0, 7.0), ("k", 9.0, 9.5), ("t", 20.0, 30.0)], kind)
    got = sorted((r.key, r.l, r.r) for r in intervals.difference(a, b, 0.0, 10.0).collect())
    # points at the ends of b's, in them or equal to one of its points go; where intervals touch there is no point
    assert got == [("k", 1.0, 1.0), ("k", 4.5, 5.0), ("k", 5.0, 6.0), ("k", 8.0, 9.0), ("o", 3.0, 3.0), ("o", 5.0, 6.0), ("t", 1.0, 2.0), ("t", 2.0, 3.0)]


def test_intervals_are_rounded_as_in_sql(spark):
    near = [1706618684.7385 + k * 2.0**-22 for k in range(-3, 4)] + [1705570876.5905, 0.0005, 2.5, -1.0005]
    got = [r.x for r in queries_intervals._rounded(spark.createDataFrame([(x,) for x in near], "x double")).collect()]
    assert got == [duckdb.execute("select round(?::double, 3)", [x]).fetchone()[0] for x in near]


def test_segment_choice(spark):
    seg = spark.createDataFrame([("o", 0.0, 100.0, 1, "long"), ("o", 40.0, 60.0, 1, "short"), ("o", 45.0, 55.0, 2, "predicted")], "object string, l double, r double, rank int, name string")
    t = spark.createDataFrame([("o", 50.0), ("o", 59.9)], "object string, t double")
    got = {r.t: r.name for r in intervals.segment_for(t, seg).collect()}
    assert got == {50.0: "short", 59.9: "long"}


# --- decisions, spectra, functions ------------------------------------------------------------------


def test_cross_rank_weights_flip(spark):
    c = spark.createDataFrame([("a", 1, 0.92, 2.0, 0.5), ("a", 2, 0.5, 1.0, 0.1), ("b", 1, 0.6, 10.0, 0.4), ("b", 2, 0.4, 0.5, 0.2)], "region string, rank int, suit double, area_km2 double, p1 double")
    assert decision.cross_rank(c).orderBy("cross_rank").first().region == "a"
    assert decision.cross_rank(c, (0.1, 0.8, 0.1)).orderBy("cross_rank").first().region == "b"


def test_rank1_probabilities_sum_to_one(spark):
    c = spark.createDataFrame([(1, 0.9, 0.05), (2, 0.8, 0.05), (3, 0.1, 0.05)], "id long, mean double, std double")
    got = {r.id: r.p1 for r in decision.rank1_probability(c, 800).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[1] > got[2] > got[3]
    assert got == {r.id: r.p1 for r in decision.rank1_probability(c, 800).collect()}


def test_spectral_angle_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, None], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(spectra.spectral_angle(F.col("a"), F.col("b"))).collect()] == [pytest.approx(math.pi / 2), None, None]
    assert [r[0] for r in df.select(spectra.spectral_angle(F.col("a"), F.col("b"), "half_pi")).collect()][1] == pytest.approx(math.pi / 2)


def test_sections():
    assert spectra.sections([1, 2, 3, 2, 1]) == [[0, 1, 2], [3, 4]]
    assert spectra.nearest_band([1.0, 2.0, 3.0], 2.5) == 1


def test_pca_of_a_line(spark):
    df = spark.createDataFrame([([float(k), 2.0 * k],) for k in range(20)], "b array<double>")
    values, vectors_, percent, _ = spectra.pca(df, "b", 2)
    assert percent[0] == pytest.approx(100) and vectors_[0] == pytest.approx(np.array([1, 2]) / math.sqrt(5))


def test_pca_variance_takes_all_bands(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(100, 64)) * np.arange(1, 65)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.eigenvalue for r in QUERIES["pca_variance"](spark, str(tmp_path)).orderBy("pc").collect()]
    assert got == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1].tolist())


def test_quaternion_matches_rotation(spark):
    q = vectors.vec(math.cos(0.2), 0.0, 0.0, math.sin(0.2))
    v = vectors.vec(1.0, 2.0, 3.0)
    row = spark.range(1).select(vectors.matrix_times(vectors.quaternion_to_matrix(q), v).alias("a"), vectors.rotate_about(v, vectors.vec(0.0, 0.0, 1.0), F.lit(0.4)).alias("b")).first()
    assert row.a == pytest.approx(row.b)


def test_time_et_keeps_events_before_the_last_leap_second(spark, tmp_path):
    spark.sql("SELECT 1 AS event_id, TIMESTAMP '2010-06-01 00:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2020-06-01 00:00:00'").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.et - r.utc for r in QUERIES["time_et"](spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(34 + 32.184, abs=0.01), 2: pytest.approx(37 + 32.184, abs=0.01)}


def test_strings(spark):
    s = F.lit("from A to B,C")
    row = spark.range(1).select(strings.after_keyword(s, "from", ["to"]).alias("k"), strings.items(s, ",").alias("i"), strings.number_at(F.lit("-1.5E3x")).alias("n"), strings.char_pos(s, "AB").alias("p")).first()
    assert (row.k, row.i, row.n, row.p) == ("A", ["from A to B", "C"], "-1.5E3", 5)


# --- sources, streaming -----------------------------------------------------------------------------


def test_image_reader(spark, tmp_path):
    head = pds.write_label({"RECORD_BYTES": 512, "^IMAGE": 2, "IMAGE.LINES": 2, "IMAGE.LINE_SAMPLES": 3, "IMAGE.SAMPLE_BITS": 16, "IMAGE.SAMPLE_TYPE": "MSB_INTEGER", "IMAGE.SCALING_FACTOR": 0.5, "IMAGE.OFFSET": 1.0, "IMAGE.MISSING_CONSTANT": -1}).encode()
    (tmp_path / "a.img").write_bytes(head.ljust(512) + np.array([[2, 4, 6], [8, -1, 12]], ">i2").tobytes())
    got = as_map(pds.read_images(spark, str(tmp_path / "a.img")), "value")
    assert got == {(0, 0): 2.0, (0, 1): 3.0, (0, 2): 4.0, (1, 0): 5.0, (1, 1): None, (1, 2): 7.0}
    assert pds.read_labels(spark, str(tmp_path / "a.img")).first().label["IMAGE.LINES"] == "2"


def test_vax_floats():
    # 1.0, -0.5 and 0.0 in the VAX F layout
    raw = np.array([0x4080, 0x0000, 0xC000, 0x0000, 0x0000, 0x0000], "<u2").view(np.uint8)
    assert pds.vax_to_ieee(raw).tolist() == [1.0, -0.5, 0.0]


def test_catalogue(spark, tmp_path):
    row = [""] * 52
    row[0], row[1], row[2], row[4], row[51] = "Tycho", "85.3", "-43.3", "x", "2"
    (tmp_path / "c.csv").write_text("# comment\n" + ",".join(f"h{k}" for k in range(52)) + "\n" + ",".join(row) + "\n")
    got = catalogues.read_catalogue(spark, str(tmp_path / "c.csv")).first()
    assert (got.crater_name, got.diameter_km, got.east_lon, got.age_class) == ("Tycho", 85.3, None, 2)


def test_boxes_across_the_date_line(spark):
    b = spark.createDataFrame([("in", 175.0, 178.0, 0.0, 1.0), ("wrapped", 170.0, -170.0, 0.0, 1.0), ("out", 0.0, 10.0, 0.0, 1.0)], "n string, west double, east double, south double, north double")
    assert {r.n for r in catalogues.boxes_meet(b, 177.0, -175.0, -5.0, 5.0).collect()} == {"in", "wrapped"}


def test_report_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.5)], "region string, rank int, suit double")
    catalogues.write_report(c, str(tmp_path / "r"))
    assert sorted((r.region, r["rank"], r.suit) for r in catalogues.read_report(spark, str(tmp_path / "r")).collect()) == [("a", 1, 0.9), ("a", 2, 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda df: sorted((r.user_id, r.start, r.n) for r in df.collect())
    assert key(spark.table("out")) == key(sessions(batch))


# --- rays over many tiles ----------------------------------------------------------------------------


def test_rays_over_many_tiles_equal_one_tile(spark, monkeypatch):
    """The same rays over tiles of 8 cells as over one tile, with holes and missing cells."""
    from gridlore.operators import rays

    rng = np.random.default_rng(5)
    z = rng.uniform(0, 30, (37, 29))
    z[5:9, 10:14] += 60
    rows = [(r + 3, c - 4, None if (r * 29 + c) % 41 == 0 else float(z[r, c])) for r in range(37) for c in range(29) if (r * 29 + c) % 53]
    g = spark.createDataFrame(rows, "row int, col int, z double")
    track = spark.createDataFrame([(k, 40.0 * k, 20.0 - k) for k in range(9)], "step int, azimuth double, elevation double")
    jobs = {
        "horizon": lambda: rays.horizon(g, [0.0, 33.0, 90.0, 180.0, 291.0], 2.0, radius=5000.0).orderBy("row", "col", "azimuth"),
        "short": lambda: rays.horizon(g, [10.0, 200.0], 2.0, 6).orderBy("row", "col", "azimuth"),
        "shadow": lambda: rays.shadow(g, 211.0, 40.0).orderBy("row", "col"),
        "sun": lambda: rays.sun_mask(g, 131.0, 35.0, 1.0, 2.0).orderBy("row", "col"),
        "south": lambda: rays.sun_mask(g, 180.0, 35.0).orderBy("row", "col"),
        "shed": lambda: rays.viewshed(g, 20, 9, 3.0).orderBy("row", "col"),
        "light": lambda: rays.illumination(g, rays.horizon(g, [0.0, 90.0, 180.0, 270.0]), track).orderBy("row", "col"),
        "earth": lambda: rays.visibility(rays.horizon_arrays(g, [0.0, 90.0, 180.0, 270.0]), track, 1.0).orderBy("row", "col"),
    }
    whole = {k: f().collect() for k, f in jobs.items()}
    monkeypatch.setattr(rays, "TILE", 8)
    for k, f in jobs.items():
        got = f().collect()
        assert [tuple(r)[:-1] for r in got] == [tuple(r)[:-1] for r in whole[k]] and len(got) >= sum(z is not None for _, _, z in rows)
        assert all(a[-1] == b[-1] or a[-1] == pytest.approx(b[-1], abs=1e-9) for a, b in zip(got, whole[k])), k
    assert len({r.mask for r in whole["sun"]}) == 3 and {r.lit for r in whole["shadow"]} == {0, 1} and {r.visible for r in whole["shed"]} == {0, 1}


def plain_sun_mask(z, azimuth, elevation, ns, ew):
    """Ray by ray, step by step."""
    a = math.radians(azimuth)
    dc, dr, tan = math.sin(a), -math.cos(a), math.tan(math.radians(elevation))
    metres = math.hypot(dr * ns, dc * ew)
    n, m = z.shape
    out = np.ones(z.shape, int)
    for r, c in np.ndindex(z.shape):
        if np.isnan(z[r, c]):
            out[r, c] = 255
            continue
        k = 1
        while True:
            d = 0.5 * k
            y, x = r + d * dr, c + d * dc
            if not (0 <= y < n and 0 <= x < m):
                break
            y0, x0 = int(y), int(x)
            y1, x1, fy, fx = min(y0 + 1, n - 1), min(x0 + 1, m - 1), y - y0, x - x0
            h = (1 - fy) * (1 - fx) * z[y0, x0] + (1 - fy) * fx * z[y0, x1] + fy * (1 - fx) * z[y1, x0] + fy * fx * z[y1, x1]
            if np.isnan(h):
                break
            if h > z[r, c] + d * metres * tan:
                out[r, c] = 0
                break
            k += 1
    return out


@pytest.mark.parametrize("azimuth", [0.0, 57.0, 90.0, 225.0])
def test_sun_mask_equals_a_plain_march(spark, monkeypatch, azimuth):
    from gridlore.operators import rays

    monkeypatch.setattr(rays, "TILE", 8)
    z = np.random.default_rng(6).uniform(0, 25, (21, 18))
    z[z > 24.5] = np.nan
    g = grid(spark, [[None if np.isnan(x) else x for x in line] for line in z])
    got = {(r.row, r.col): r.mask for r in rays.sun_mask(g, azimuth, 50.0, 2.0, 1.0).collect()}
    want = plain_sun_mask(z, azimuth, 50.0, 2.0, 1.0)
    assert all(got[k] == want[k] for k in np.ndindex(z.shape))
