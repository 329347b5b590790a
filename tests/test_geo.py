"""Published values of the formulas, and floats against columns."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veiltrack.functions import geo
from veiltrack.functions.geo import LatLon

EIFFEL, TITANIC = LatLon(48.8583701, 2.2944813), LatLon(41.7325, -49.9469)
V = {1: (35.952500, -83.932434), 2: (35.948878, -83.928081)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(p):
    return LatLon(F.lit(float(p[0])), F.lit(float(p[1])))


def test_edge_of_the_published_network(spark):
    v1, v2 = lit(V[1]), lit(V[2])
    assert one(spark, geo.distance(v1, v2)) == pytest.approx(562.537106, abs=1e-5)
    assert one(spark, geo.bearing(v1, v2)) == pytest.approx(135.78563, abs=1e-4)
    corner = geo.edge_area(v1, v2, 17.0)[0]
    assert one(spark, corner.lat) == pytest.approx(35.952553247, abs=1e-8) and one(spark, corner.lon) == pytest.approx(-83.9323663936, abs=1e-8)


def test_floats_and_columns_agree(spark):
    a, b = LatLon(42.3, -83.7), LatLon(42.31, -83.72)
    for f in (geo.distance, geo.haversine, geo.bearing):
        assert one(spark, f(lit(a), lit(b))) == pytest.approx(f(a, b), rel=1e-12)
    for f in (geo.midpoint, lambda p, q: geo.project(p, 33.0, 250.0)):
        got, want = f(lit(a), lit(b)), f(a, b)
        assert one(spark, got.lat) == pytest.approx(want.lat, abs=1e-12) and one(spark, got.lon) == pytest.approx(want.lon, abs=1e-12)


lats, lons, turns, lengths = st.floats(-70, 70), st.floats(-170, 170), st.floats(0, 359.99), st.floats(1, 50_000)


@settings(max_examples=200, deadline=None)
@given(lats, lons, turns, lengths)
def test_projection_keeps_distance_and_bearing(lat, lon, course, metres):
    a = LatLon(lat, lon)
    b = geo.project(a, course, metres)
    if abs(b.lon - lon) < 180:
        assert geo.haversine(a, b) == pytest.approx(metres, rel=1e-5, abs=1e-2)
        if metres > 100:
            assert abs((geo.bearing(a, b) - course + 180) % 360 - 180) < 1e-2


@settings(max_examples=100, deadline=None)
@given(lats, lons, lats, lons)
def test_distances_are_symmetric(a, b, c, d):
    p, q = LatLon(a, b), LatLon(c, d)
    assert geo.distance(p, q) == pytest.approx(geo.distance(q, p)) and geo.haversine(p, q) == pytest.approx(geo.haversine(q, p))
    assert geo.distance(p, p) == 0


def test_area_and_sides(spark):
    corners = geo.edge_area(lit((42.0, -83.0)), lit((42.0, -82.99)), 20.0, 5.0)
    inside = [(42.0, -82.995, True), (42.00008, -82.995, True), (42.0002, -82.995, False), (42.0, -83.00003, True), (42.0, -83.0002, False), (42.0, -82.9898, False)]
    for lat, lon, want in inside:
        assert one(spark, geo.area_contains(corners, lit((lat, lon)))) is want
    assert one(spark, geo.outside_side(corners, 4, lit((0, 0)))) is False
    assert one(spark, geo.edge_area(lit((42.0, -83.0)), lit((42.0, -82.99)), 0.0)[0].lat) is None


def test_boxes(spark):
    box = geo.bounds(0.0, 0.0, 2.0, 4.0)
    at = lambda c: one(spark, c)
    assert at(geo.in_bounds(box, lit((2.0, 4.0)))) and not at(geo.in_bounds(box, lit((2.1, 1.0))))
    assert (at(box.width), at(box.height), at(box.center.lat), at(box.center.lon)) == (4.0, 2.0, 1.0, 2.0)
    assert at(geo.bounds_cross_edge(box, lit((-1.0, 1.0)), lit((3.0, 1.5)))) and at(geo.edge_touches(box, lit((1.0, 1.0)), lit((1.0, 1.1))))
    assert not at(geo.bounds_cross_edge(box, lit((1.0, 1.0)), lit((1.0, 1.1)))) and not at(geo.edge_touches(box, lit((5.0, 5.0)), lit((6.0, 6.0))))
    plus = geo.bounds(-1.0, 1.0, 3.0, 2.0)
    assert not at(geo.bounds_touch(box, plus)) and at(geo.bounds_touch(box, geo.bounds(1.0, 1.0, 9.0, 9.0)))


def test_parallel_segments_do_not_cross(spark):
    assert one(spark, geo.segments_cross(lit((0, 0)), lit((0, 1)), lit((0, 0)), lit((0, 1)))) is False
    assert one(spark, geo.segments_cross(lit((0, 0)), lit((1, 1)), lit((0, 1)), lit((1, 0)))) is True
    assert one(spark, geo.segments_cross(lit((0, 0)), lit((1, 1)), lit((1, 1)), lit((2, 0)))) is True


@pytest.mark.parametrize("a, b, delta, error", [(10, 350, 20, 20), (0, 180, 180, 0), (90, 0, 90, 90), (355, 5, 10, 10), (45, 225, 180, 0), (0, 100, 100, 80)])
def test_angles(spark, a, b, delta, error):
    x, y = F.lit(float(a)), F.lit(float(b))
    assert one(spark, geo.heading_delta(x, y)) == delta and one(spark, geo.angle_error(x, y)) == pytest.approx(error)
    assert one(spark, geo.consistent_with(x, y)) is (error < 15)


def test_colors_and_sectors(spark):
    assert len(geo.SPEED_COLORS) == 32
    assert [one(spark, geo.speed_color(F.lit(s))) for s in (0.0, 36.0, 90.0)] == [geo.SPEED_COLORS[0], geo.SPEED_COLORS[-1], geo.SPEED_COLORS[-1]]
    assert [one(spark, geo.heading_sector(F.lit(h), 36)) for h in (0.0, 9.99, 10.0, 359.9, 360.0)] == [0, 0, 1, 35, 0]
    assert [one(spark, geo.outdegree(F.lit(d))) for d in (1, 2, 3, 5)] == [0, 0, 2, 4]


def test_circle(spark):
    c, box = lit((42.0, -83.0)), geo.bounds(42.0005, -83.001, 42.01, -82.999)
    assert one(spark, geo.circle_contains(c, F.lit(100.0), lit((42.0008, -83.0)))) and not one(spark, geo.circle_contains(c, F.lit(100.0), lit((42.001, -83.0))))
    assert one(spark, geo.circle_touches(c, F.lit(100.0), box)) and not one(spark, geo.circle_touches(c, F.lit(20.0), box))
    assert one(spark, geo.bounds_cross_circle(box, c, F.lit(100.0))) and not one(spark, geo.bounds_contains_circle(box, c, F.lit(100.0)))
    assert one(spark, geo.same_circle(c, F.lit(1.0), c, F.lit(1.0)))


def test_tiles():
    tiles = geo.grid_tiles(42.0, -83.0, 10.0, 41.999, -82.999)
    rows, cols = max(t[0] for t in tiles) + 1, max(t[1] for t in tiles) + 1
    assert len(tiles) == rows * cols and rows == math.ceil(0.001 / (10 / geo.EARTH_RADIUS_M * 180 / math.pi))
    assert all(t[2] < t[4] and t[3] < t[5] for t in tiles)
