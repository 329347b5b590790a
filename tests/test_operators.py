"""Operators against slow forms in plain Python, on random trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltrack.functions.geo import LatLon, distance
from veiltrack.operators.clean import correct_errors, correct_trip
from veiltrack.operators.intervals import mark_points, merge_intervals
from veiltrack.operators import fit
from veiltrack.operators.roads import LEAF_DEGREES, build_index, highways, leaf_of, vertices
from veiltrack.plans import demo, pipeline
from veiltrack.queries import SMALL
from veiltrack.session import ship_package
from veiltrack.sinks import kml

POINTS = "trip_id string, idx long, raw string, time_us long, lat double, lon double, heading double, speed double"


def slow_correction(points, sample=50):
    """Head and tail passes over a list, with points moving up as wrong ones go."""
    points = list(points)
    if len(points) <= sample // 2:
        return points
    first = points[:sample]
    middle = LatLon(sorted(p[4] for p in first)[sample // 2], sorted(p[5] for p in first)[sample // 2])
    wrong = lambda p, m, n: distance(LatLon(p[4], p[5]), m) / (n // 2 * 0.1) > 44.7
    i, taken = 0, len(first)
    while i < min(sample, len(points)):
        if wrong(points[i], middle, taken):
            del points[i]
        else:
            i += 1
    if len(points) <= sample:
        return points
    last = points[-sample:]
    middle = LatLon(sorted(p[4] for p in last)[sample // 2], sorted(p[5] for p in last)[sample // 2])
    return points[:-sample] + [p for p in last if not wrong(p, middle, sample)]


def test_error_correction(spark):
    rng, rows, want = random.Random(4), [], {}
    for t, n in enumerate([1, 2, 25, 26, 40, 50, 51, 55, 70, 100, 101, 160]):
        own = [(str(t), i, f"{t}-{i}", i, 42 + i * 2e-5 + (rng.choice([0.5, -0.3]) if rng.random() < 0.15 else 0), -83.0 + rng.random() * 1e-5, 0.0, 1.0) for i in range(n)]
        rows += own
        want[str(t)] = [p[2] for p in slow_correction(own)]
    got = correct_errors(spark.createDataFrame(rows, POINTS).repartition(5)).collect()
    for t, raws in want.items():
        own = sorted((r.idx, r.raw) for r in got if r.trip_id == t)
        assert [i for i, _ in own] == list(range(len(raws))) and [x for _, x in own] == raws
        mine = [r for r in rows if r[0] == t]
        at = correct_trip(np.array([r[4] for r in mine]), np.array([r[5] for r in mine]))
        assert [mine[k][2] for k in at.tolist()] == raws


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_and_marking(spark, seed):
    rng = random.Random(seed)
    spans = [(str(rng.randrange(3)), a := rng.randrange(60), a + rng.choice([0, 1, 1, 3, 9]), [rng.choice("xyz")]) for _ in range(25)]
    points = [(t, i, "", 0, 0.0, 0.0, 0.0, 0.0) for t in "0123" for i in range(70)]
    merged = merge_intervals(spark.createDataFrame(spans, "trip_id string, left long, right long, aux array<string>"))
    want = {}
    for t in "012":
        groups = []
        for a, b, tags in sorted((a, b, tags) for u, a, b, tags in spans if u == t):
            if groups and a <= groups[-1][1]:
                groups[-1] = (groups[-1][0], max(b, groups[-1][1]), groups[-1][2] | set(tags))
            else:
                groups.append((a, b, set(tags)))
        want |= {(t, i): (a, b, sorted(s)) for i, (a, b, s) in enumerate(groups)}
    assert {(r.trip_id, r.id): (r.left, r.right, r.aux) for r in merged.collect()} == want
    marked = {(r.trip_id, r.idx): (r.ci_id, r.is_critical) for r in mark_points(spark.createDataFrame(points, POINTS), merged).collect()}
    for (t, i), (ident, flag) in marked.items():
        inside = [k for (u, k), (a, b, _) in want.items() if u == t and a <= i < b]
        assert (ident, flag) == ((inside[0], True) if inside else (None, False))


def test_index_splits_and_finds(spark, sf_dir):
    edges = demo.roads(spark, sf_dir)
    nodes, held = build_index(edges, *demo.BOX)
    leaves = nodes.filter("is_leaf")
    assert leaves.filter(f"n_edges > 32 and (ne_lat - sw_lat >= {2 * LEAF_DEGREES} or ne_lon - sw_lon >= {2 * LEAF_DEGREES})").count() == 0
    assert held.groupBy("node").count().join(leaves, "node").filter("count <> n_edges").count() == 0
    assert held.select("edge_id").distinct().count() == edges.count()
    points = spark.createDataFrame([(i, 42.2 + i * 0.001, -83.9 + i * 0.0001) for i in range(50)] + [(99, 0.0, 0.0)], "p long, lat double, lon double")
    found = {r.p: r.node for r in leaf_of(points, nodes, ["p"]).collect()}
    boxes = {r.node: r for r in leaves.collect()}
    assert found[99] is None and len(found) == 51
    assert all(boxes[found[i]].sw_lat <= 42.2 + i * 0.001 <= boxes[found[i]].ne_lat for i in range(50))


def test_many_equal_points_split_once(spark):
    """33 edges in one corner: the root of such a box splits, and its two leaves can't."""
    rows = [(i, 2 * i, 42.0001, -83.0001, 2 * i + 1, 42.0002, -83.0002, 3) for i in range(33)]
    edges = spark.createDataFrame(rows, "edge_id long, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double, way_type int")
    nodes, _ = build_index(edges, (41.999, -83.007), (42.0025, -82.999))
    assert nodes.count() == 3 and nodes.filter("is_leaf").count() == 2
    assert nodes.filter(F.col("is_leaf") & (F.col("ne_lon") - F.col("sw_lon") < LEAF_DEGREES)).count() == 0


def test_highways_and_degrees(spark, sf_dir):
    rows = {r.name: r for r in highways(spark).collect()}
    assert len(rows) == 43 and rows["motorway"].width == 22.0 and rows["primary"].excluded and not rows["service"].excluded and rows["user_defined"].width == 80.0
    degrees = vertices(demo.roads(spark, sf_dir)).collect()
    assert all(r.out_degree == (r.degree - 1 if r.degree > 2 else 0) for r in degrees)


def test_kml_parts():
    places = [LatLon(42 + i / 1000, -83.0) for i in range(100)]
    text = kml.trajectory(places, [10.0] * 50 + [30.0] * 50, [i in (40, 41) for i in range(100)], 5)
    assert text.count("<LineString>") >= 3 and "start_style" in text and "end_style" in text
    assert kml.intervals([(3, 30)], places, "ci_intervals", "stop_marker_style").count("Placemark>") == 4
    assert kml.circle_mark(places[0], 10.0, "s", segments=8).count(",0") == 9 and kml.bounds_mark(places[0], places[5], "s").count(",0") == 5
    assert "559900" in kml.poly_style("x", 0xFF990000, 1) or "55990000" in kml.poly_style("x", 0xFF990000, 1)
    with pytest.raises(ValueError):
        kml.circle_mark(places[0], 1.0, "s", segments=2)
    import xml.dom.minidom as dom

    dom.parseString(kml.document("a & b", text, kml.trajectory_simple("n", "s", places)))


def test_leaves_of_a_world(spark):
    """A box of the world with few roads: few rows, and each point in the leaf that has it."""
    rng = random.Random(5)
    rows = []
    for i in range(100):
        lat, lon = (rng.uniform(-80, 80), rng.uniform(-179, 179)) if i % 2 else (42 + rng.random() * 0.01, -83 + rng.random() * 0.01)
        rows.append((i, 2 * i, lat, lon, 2 * i + 1, lat + 0.001, lon + 0.001, 3))
    edges = spark.createDataFrame(rows, "edge_id long, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double, way_type int")
    nodes, _ = build_index(edges, (-90.0, -180.0), (90.0, 180.0))
    found = nodes.collect()
    assert len(found) < 2000 and max(r.level for r in found) > 8
    leaves = [r for r in found if r.is_leaf]
    places = [(i, *r[2:4]) for i, r in enumerate(rows)] + [(200 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(100)] + [(300, 0.0, 0.0), (301, 90.0, 180.0), (302, -90.0, -180.0), (303, 45.0, -90.0), (304, 91.0, 0.0), (305, None, 0.0), (306, float("nan"), 0.0)]
    got = {r.p: r.node for r in leaf_of(spark.createDataFrame(places, "p long, lat double, lon double"), nodes, ["p"]).collect()}
    assert len(got) == len(places)
    for p, lat, lon in places:
        inside = [r.node for r in leaves if lat is not None and r.sw_lat <= lat <= r.ne_lat and r.sw_lon <= lon <= r.ne_lon]
        assert got[p] == min(inside, default=None)


@pytest.mark.parametrize("most, cell_points", [(10**6, 500_000), (0, 500_000), (0, 7)])
def test_points_meet_areas_of_any_size(spark, monkeypatch, most, cell_points):
    """Short and very long roads; half of all points in one cell, which is then many tasks."""
    monkeypatch.setattr(fit, "MOST_BROADCAST", most)
    rng = random.Random(6)
    rows = [(i, 42 + rng.random() * 0.02, -83 + rng.random() * 0.02) for i in range(40)]
    rows = [(i, 2 * i, a, b, 2 * i + 1, a + rng.uniform(-1, 1) * size, b + rng.uniform(-1, 1) * size, 3, 40.0) for (i, a, b), size in zip(rows, [0.002, 0.01, 0.5, 6.0] * 10)]
    edges = spark.createDataFrame(rows, "edge_id long, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double, way_type int, width double")
    hot = (rows[0][2] + rows[0][5]) / 2, (rows[0][3] + rows[0][6]) / 2
    places = [("a", i, *(hot if i % 2 else (42 + rng.random() * 0.02, -83 + rng.random() * 0.02))) for i in range(300)]
    points = spark.createDataFrame(places, "trip_id string, idx long, lat double, lon double")
    areas = fit.edge_areas(edges, 1.0, 5.0)
    dealt = fit.deal_areas(areas, ["edge_id"])
    assert dealt.small == (most > 0) and len(dealt.rows) >= 3 and sum(dealt.rows.values()) <= 4 * 40
    got = sorted((r.idx, r.edge_id) for r in fit.meet(points, dealt, cell_points).collect())
    boxes = {r.edge_id: [(r[f"c{i}_lat"], r[f"c{i}_lon"]) for i in range(4)] for r in areas.collect()}

    def inside(c, lat, lon):
        return not any(c[i][0] * (c[(i + 1) % 4][1] - c[i][1]) - c[i][1] * (c[(i + 1) % 4][0] - c[i][0]) - lat * (c[(i + 1) % 4][1] - c[i][1]) + lon * (c[(i + 1) % 4][0] - c[i][0]) < 0 for i in range(4))

    assert got == sorted((i, e) for _, i, lat, lon in places for e, c in boxes.items() if inside(c, lat, lon)) and len(got) > 100


def test_large_maps_fit_alike(spark, sf_dir, monkeypatch):
    """A map that isn't broadcast gives the same fit, with its edges' columns on the way."""
    points = demo.trips(spark, sf_dir).filter("trip_id < '2'")
    edges = demo.roads(spark, sf_dir)
    index = build_index(edges, *demo.BOX)
    own = lambda: sorted(tuple(r) for r in fit.fit_trips(points, edges, index, 1.0, 5.0, 36, 10).collect())
    small = own()
    monkeypatch.setattr(fit, "MOST_BROADCAST", 0)
    monkeypatch.setattr(fit, "CELL_POINTS", 50)
    assert own() == small and any(r[-9] is not None for r in small)


def test_rows_of_a_trip_stand_together_after_a_union(spark, sf_dir):
    """Points and candidates are dealt by trip before their union, and adaptive execution merges parts of each on its own."""
    merging = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in merging}
    points, edges = correct_errors(demo.trips(spark, sf_dir, outliers=True)), demo.roads(spark, sf_dir)
    fitted = lambda: sorted(tuple(r) for r in pipeline.fit(points, edges, SMALL).select("trip_id", "idx", "edge_explicit", "edge_id").collect())
    want = fitted()
    try:
        for k, v in merging.items():
            spark.conf.set(k, v)
        ship_package(spark)
        assert fitted() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
