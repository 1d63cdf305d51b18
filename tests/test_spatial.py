import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.functions import spatial as s
from firegrid.operators.nearest import nearest_point
from firegrid.operators.polygons import Cover, _with_inside_cells, edges_from_rings, lattice_cells, with_inside

POINTS = "latitude double, longitude double"


def test_known_coordinates(spark):
    row = s.with_utm(spark.createDataFrame([(51.2, 7.5)], POINTS)).first()
    assert (row._zone, row._band) == (32, "U")
    assert row._east == pytest.approx(395201.3104, abs=1e-3)
    assert row._north == pytest.approx(5673135.2412, abs=1e-3)


def test_cells(spark):
    rows = [(34.05, -118.24), (60.0, 5.0), (-33.9, 151.2), (84.5, 0.0), (None, 1.0), (75.0, 10.0)]
    cells = [r.grid_id for r in s.with_cell(spark.createDataFrame(rows, POINTS)).collect()]
    assert cells[0].startswith("11S_") and cells[1].startswith("32V_") and cells[2].startswith("56H_")
    assert cells[3] is None and cells[4] is None and cells[5].startswith("33X_")


@pytest.mark.parametrize("size", [1, 10])
def test_centre_lies_in_its_cell(spark, size):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-75, 80, 300), rng.uniform(-179, 179, 300))]
    cells = s.with_cell(spark.createDataFrame(rows, POINTS), size)
    back = s.with_cell(s.with_centre(cells.select("grid_id"), size_km=size).withColumnRenamed("grid_id", "was"), size)
    # a centre may cross into the next zone or band at an edge, but never leaves its square otherwise
    near = back.where(F.substring_index("was", "_", 1) == F.substring_index("grid_id", "_", 1))
    assert near.count() > 250
    assert near.where("was <> grid_id").count() == 0


def brute(q, pts):
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (q[0], q[1], pts[:, 0], pts[:, 1]))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("area", ["world", "poles", "at the pole", "date line", "dense", "far", "one spot"])
def test_nearest_equals_brute_force(spark, area):
    rng = np.random.default_rng(5)
    n, m = 150, 200
    lat, lon = rng.uniform(-89.9, 89.9, n), rng.uniform(-180, 180, n)
    plat, plon = rng.uniform(-89.9, 89.9, m), rng.uniform(-180, 180, m)
    if area == "poles":
        lat = np.where(rng.random(n) < 0.5, 1, -1) * rng.uniform(88, 90, n)
    if area == "at the pole":
        lat, plat = rng.uniform(89.5, 90, n), rng.uniform(89.5, 90, m)
    if area == "one spot":  # a cluster of some metres, seen from inside and from elsewhere
        lat[: n // 2], lon[: n // 2] = rng.uniform(34, 34.0001, n // 2), rng.uniform(-119, -118.9999, n // 2)
        plat, plon = rng.uniform(34, 34.0001, m), rng.uniform(-119, -118.9999, m)
    if area == "date line":
        lon = np.where(rng.random(n) < 0.5, 179.9, -179.9)
        plon = np.where(rng.random(m) < 0.5, 1, -1) * rng.uniform(175, 180, m)
    if area == "dense":
        lat, lon = rng.uniform(34, 35, n), rng.uniform(-119, -118, n)
        plat, plon = rng.uniform(34, 35, m), rng.uniform(-119, -118, m)
    if area == "far":
        plat, plon = rng.uniform(34, 34.1, m), rng.uniform(-119, -118.9, m)
    q = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(lat, lon)], "g string, " + POINTS)
    p = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(plat, plon)], "g string, p_lat double, p_lon double")
    got = nearest_point(q, p, ["g"]).collect()
    assert len(got) == n
    pts = np.column_stack([plat, plon])
    for r in got:
        assert r.distance_km == pytest.approx(brute((r.latitude, r.longitude), pts).min(), abs=2e-6)


def test_nearest_breaks_ties_and_keeps_groups_apart(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "g int, " + POINTS)
    p = spark.createDataFrame([(1, 1.0, 0.0), (1, -1.0, 0.0), (2, 5.0, 5.0)], "g int, p_lat double, p_lon double")
    got = {r.g: (r.p_lat, r.p_lon) for r in nearest_point(q, p, ["g"]).collect()}
    assert got == {1: (-1.0, 0.0), 2: (5.0, 5.0)}


RINGS = [
    [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)],
    [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0)],          # a hole
    [(20.0, 1.0), (25.0, 1.5), (22.0, 8.0), (20.0, 1.0)],      # a second part, closed
]


def ray(x, y):
    odd = False
    for ring in RINGS:
        pts = ring if ring[0] == ring[-1] else ring + ring[:1]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


def test_polygon_with_hole_and_parts(spark):
    rng = np.random.default_rng(9)
    rows = [(float(b), float(a)) for a, b in zip(rng.uniform(-2, 27, 2000), rng.uniform(-2, 12, 2000))]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], POINTS)
    got = with_inside(df, edges_from_rings(spark, RINGS)).collect()
    for r in got:
        want = False if r.latitude is None or r.longitude is None else ray(r.longitude, r.latitude)
        assert r.inside == want, r


@pytest.mark.parametrize("sizes", [{}, {"bands": 3, "columns": 2, "corners": 1}, {"bands": 7, "columns": 5, "corners": 2}])
def test_cells_of_a_cover_agree_with_the_ray(spark, sizes):
    rng = np.random.default_rng(10)
    rows = [(float(b), float(a)) for a, b in zip(rng.uniform(-2, 27, 1500), rng.uniform(-2, 12, 1500))]
    corners = [(y, x) for ring in RINGS for x, y in ring]
    ties = [(y, x + d) for y, x in corners for d in (-1e-13, 0.0, 1e-13)] + [(y, x) for y, _ in corners for _, x in corners]
    nan = float("nan")
    df = spark.createDataFrame([*rows, *ties, *rows[:5], (None, 1.0), (1.0, None), (nan, 1.0), (1.0, nan)], POINTS)
    got = _with_inside_cells(df, edges_from_rings(spark, RINGS), "latitude", "longitude", "inside", **sizes).collect()
    assert len(got) == len(rows) + len(ties) + 9
    for r in got:
        bad = r.latitude is None or r.longitude is None or r.latitude != r.latitude or r.longitude != r.longitude
        assert r.inside == (False if bad else ray(r.longitude, r.latitude)), r


def test_an_outline_of_many_corners_is_split_into_cells(spark):
    rng = np.random.default_rng(11)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 6000) ** 3) / (2 * np.pi) ** 2  # most corners in a small part
    far = rng.uniform(4, 6, 6000)
    x, y = far * np.cos(turn), far * np.sin(turn)
    nodes = spark.createDataFrame([(0, float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x, y, np.roll(x, -1), np.roll(y, -1))],
                                  "ring_id int, x1 double, y1 double, x2 double, y2 double")
    points = [(float(b), float(a)) for a, b in zip(rng.uniform(-7, 7, 800), rng.uniform(-7, 7, 800))]
    points += [(float(b), float(a)) for a, b in zip(x[::20], y[::20])]
    df = spark.createDataFrame(points, POINTS)
    got = with_inside(df, nodes)
    assert "_es" in got._jdf.queryExecution().analyzed().toString()  # more edges than one row may hold
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for r in got.collect():
            hit = ((y <= r.latitude) != (y2 <= r.latitude)) & (r.longitude < x + (r.latitude - y) / (y2 - y) * (x2 - x))
            assert r.inside == bool(hit.sum() % 2), r
    longest = Cover(nodes).cells().agg(F.max(F.size("es")).alias("n"), F.count(F.lit(1)).alias("cells")).first()
    assert longest.n < 200 and longest.cells > 10_000


def test_outlines_without_area_hold_nothing(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], POINTS)
    level = edges_from_rings(spark, [[(0.0, 0.0), (2.0, 0.0)]])
    assert [r.inside for r in with_inside(df, level, small=0).collect()] == [False, False]
    assert [r.inside for r in with_inside(df, level.where("x1 > 9"), small=-1).collect()] == [False, False]
    upright = edges_from_rings(spark, [[(1.0, -1.0), (1.0, 1.0)]])
    assert [r.inside for r in with_inside(df, upright, small=0).collect()] == [False, False]


def test_lattice(spark):
    square = edges_from_rings(spark, [[(-119.0, 35.0), (-118.0, 35.0), (-118.0, 36.0), (-119.0, 36.0)]])
    cells = [r.grid_id for r in lattice_cells(spark, square, 10).collect()]
    assert len(cells) == len(set(cells)) and 80 <= len(cells) <= 144
    assert all(c.startswith("11S_") for c in cells)


def test_haversine(spark):
    km = spark.range(1).select(s.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371, abs=1e-6)


def test_nearest_among_points_that_share_a_bit(spark):
    rng = np.random.default_rng(9)
    n, m = 200, 300
    places = np.column_stack([rng.uniform(32, 42, n), rng.uniform(-124, -114, n)])
    pts = np.column_stack([rng.uniform(32, 42, m), rng.uniform(-124, -114, m)])
    has = np.array([1 << int(k) for k in rng.integers(0, 8, m)]) | np.array([1 << int(k) for k in rng.integers(0, 8, m)])
    has[has & 128 != 0] &= 127  # bit 7 nobody has
    has[0] = 1 << 62
    wants = [1, 6, 128, 255, (1 << 62) | 1, 1 << 62]
    q = spark.createDataFrame([("g", float(a), float(b), w) for a, b in places for w in wants], "g string, " + POINTS + ", want long")
    p = spark.createDataFrame([("g", float(a), float(b), int(h)) for (a, b), h in zip(pts, has)],
                              "g string, p_lat double, p_lon double, has long")
    got = {(r.latitude, r.longitude, r.want): r.distance_km for r in nearest_point(q, p, ["g"], want="want", has="has").collect()}
    for a, b in places:
        for w in wants:
            fit = pts[(has & w) != 0]
            if len(fit):
                assert got[(a, b, w)] == pytest.approx(brute((a, b), fit).min(), abs=2e-6)
            else:
                assert (a, b, w) not in got
