"""The ordered searches against slow forms in plain Python, on random trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veiltrack.functions.geo import LatLon, bearing, distance, project
from veiltrack.operators.detect import area_turnarounds, detect_fused, stops, stops_of, turnaround_area
from veiltrack.operators.fit import CORNERS, edge_areas, fit_trips, map_candidates
from veiltrack.operators.folds import fold_trips
from veiltrack.operators.intervals import mark_points, merge_intervals
from veiltrack.operators.privacy import PrivacyLimits, PrivacySearches, find_privacy
from veiltrack.operators.roads import build_index, leaf_of

EDGES = "edge_id long, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double, way_type int, width double"
POINTS = "trip_id string, idx long, time_us long, lat double, lon double, heading double, speed double"
BOX = ((41.99, -83.02), (42.04, -82.97))


def network(seed, n=14):
    """A few vertices that lie close together, and roads between them."""
    rng = random.Random(seed)
    at = {v: (42.0 + rng.random() * 0.004, -83.0 + rng.random() * 0.004) for v in range(1, 7)}
    edges = []
    for e in range(n):
        a, b = rng.sample(sorted(at), 2)
        edges.append((e, a, *at[a], b, *at[b], 3, rng.choice([10.0, 40.0, 80.0])))
    return edges


def wander(seed, edges, trips=5, n=120):
    """Trips that follow roads for a while, leave them, and turn."""
    rng, rows = random.Random(seed), []
    for t in range(trips):
        lat, lon, course, to = 42.002, -82.998, 0.0, None
        for i in range(n):
            if to is None or rng.random() < 0.03:
                e = rng.choice(edges)
                to = rng.choice([e[2:4], e[5:7]])
            course = bearing(LatLon(lat, lon), LatLon(*to)) + rng.uniform(-25, 25) if rng.random() < 0.8 else rng.uniform(0, 360)
            lat, lon = project(LatLon(lat, lon), course % 360, rng.choice([0.0, 2.0, 12.0, 25.0]))
            rows.append((f"t{t}", i, i * 100_000 + (rng.random() < 0.02) * 900_000, lat, lon, course % 360, rng.choice([0.5, 2.0, 9.0, 30.0])))
    return rows


def outside(corners, side, p):
    (a_lat, a_lon), (b_lat, b_lon) = corners[side], corners[(side + 1) % 4]
    return a_lat * (b_lon - a_lon) - a_lon * (b_lat - a_lat) - p[0] * (b_lon - a_lon) + p[1] * (b_lat - a_lat) < 0


@pytest.mark.parametrize("seed, indexed", [(1, False), (2, True), (3, True)])
def test_sticky_choice_of_roads(spark, seed, indexed):
    """From the candidates of each point, by looking at all of a trip's points before it again and again."""
    edges, rows = network(seed), wander(seed, network(seed))
    roads = spark.createDataFrame(edges, EDGES)
    points = spark.createDataFrame(rows, POINTS)
    areas = {r.edge_id: [(r[f"c{i}_lat"], r[f"c{i}_lon"]) for i in range(4)] for r in edge_areas(roads, 1.0, 5.0).select("edge_id", *CORNERS).collect()}
    ends_of = {e[0]: (e[1], e[4]) for e in edges}
    index = build_index(roads, *BOX) if indexed else None
    near = {}
    for r in map_candidates(points, edge_areas(roads, 1.0, 5.0), index).collect():
        near.setdefault((r.trip_id, r.idx), []).append(r)
    place = {(r[0], r[1]): (r[3], r[4]) for r in rows}
    assert {k: {r.edge_id for r in v} for k, v in near.items()} == {k: s for k, p in place.items() if (s := {e for e, c in areas.items() if not any(outside(c, i, p) for i in range(4))})}

    def edge_at(trip, i):
        here = near.get((trip, i), [])
        best = min(((r.error, r.edge_id) for r in here if r.in_leaf), default=(0, None))[1]
        before = edge_at(trip, i - 1) if i else None
        if before is None or before in {r.edge_id for r in here}:
            return best if before is None else before
        vertex = ends_of[before][1] if outside(areas[before], 1, place[trip, i]) else ends_of[before][0] if outside(areas[before], 3, place[trip, i]) else None
        onward = [((r.error_v2 if ends_of[r.edge_id][1] == vertex else r.error_v1), r.edge_id) for r in here if vertex in ends_of[r.edge_id]]
        return min(onward)[1] if onward else best

    got = {(r.trip_id, r.idx): r for r in fit_trips(points, roads, index, 1.0, 5.0, 12, 6).collect()}
    assert len(got) == len(rows)
    kinds = set()
    for (trip, i), r in got.items():
        want = edge_at(trip, i)
        assert (r.edge_id if r.edge_explicit else None) == want
        if want is not None:
            e = edges[want]
            assert (r.v1_id, r.v1_lat, r.v2_id, r.v2_lon, r.edge_way_type) == (e[1], e[2], e[4], e[6], 3)
        kinds.add(want is None)
    assert kinds == {True, False}
    # inferred segments: runs between roads, cut where the sector has changed after more than six points
    for trip in {t for t, _ in got}:
        number, run = -1, []
        for i in range(120):
            r = got[trip, i]
            if r.edge_explicit:
                run = []
                continue
            sector = int(r.heading // 30) % 12
            if not run or (sector != run[0] and len(run) > 6):
                number, run = number + 1, []
            run.append(sector if not run else run[0])
            assert r.edge_id == number and r.v1_id is None


def test_returns_into_areas(spark):
    rows = wander(7, network(7), trips=8, n=150)
    points = spark.createDataFrame(rows, POINTS)
    fitted = fit_trips(points, None, heading_groups=12, min_edge_points=3)
    trips = {}
    for r in fitted.collect():
        trips.setdefault(r.trip_id, []).append(r)
    for queue, width, speed in ((20, 40.0, 20.0), (3, 200.0, 5.0), (20, 0.0, 50.0)):
        want = set()
        for trip, own in trips.items():
            own.sort(key=lambda r: r.idx)
            since = 0  # areas left before this point are forgotten
            left = [(i, own[i - 1]) for i in range(1, len(own)) if own[i].edge_id != own[i - 1].edge_id] if width else []
            for i in range(1, len(own)):
                waiting = [x for x in left if since <= x[0] < i][::-1][: queue - 1]
                if own[i].speed < speed:
                    for at, r in waiting[1:]:
                        a, b = LatLon(r.v1_lat, r.v1_lon), LatLon(r.v2_lat, r.v2_lon)
                        course = bearing(a, b)
                        corners = [project(p, (course + turn) % 360 if course + turn >= 0 else course + turn, width / 2) for p, turn in ((a, -90), (b, -90), (b, 90), (a, 90))]
                        if not any(outside(corners, s, (own[i].lat, own[i].lon)) for s in range(4)):
                            want.add((trip, at, i))
                            since = i
                            break
        assert {(r.trip_id, r.left, r.right) for r in turnaround_area(fitted, queue, width, speed).collect()} == want
        assert bool(want) == (width > 0)


def test_stops_by_trying_every_stretch(spark):
    """The first stretch from each front that time cuts off and whose ends are near each other."""
    rows = wander(11, network(11), trips=6, n=200)
    fitted = fit_trips(spark.createDataFrame(rows, POINTS), None, heading_groups=12, min_edge_points=3)
    limit, near, slow = 0.7, 20.0, 5.0
    want = set()
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        close = lambda a, b: distance(LatLon(*own[a][3:5]), LatLon(*own[b][3:5])) <= near
        at = 0
        while at < len(own):
            if own[at][6] >= slow:
                at += 1
                continue
            front = at
            while front is not None:
                end = next((i for i in range(max(at, front + 1), len(own)) if not 0 <= own[i][2] - own[front][2] <= int(limit * 1e6)), None)
                if end is None:
                    at, front = len(own), None
                elif close(front, end - 1):
                    want.add((t, front, end - 1))
                    at, front = end, None
                else:
                    at = end
                    front = next((f for f in range(front, end) if close(f, end - 1)), None)
                    front = next((f for f in range(front, end) if own[f][6] < slow), None) if front is not None else None
    got = {(r.trip_id, r.left, r.right) for r in stops(fitted, limit, near, slow).collect()}
    assert got == want and want


def search(trip, start, way, stop, limits):
    """One search over rows (lat, lon, edge, explicit, length, critical, degree), judged edge by edge."""
    dist = lambda a, b: distance(LatLon(*trip[a][:2]), LatLon(*trip[b][:2]))
    name, order = ("forward", range(start, len(trip))) if way > 0 else ("backward", range(start, -1, -1))
    order = list(order)
    cut = next((k for k, p in enumerate(order) if trip[p][5] or (way < 0 and p == stop)), None)
    changes = [k for k in range(1, len(order)) if trip[order[k]][2:4] != trip[order[k - 1]][2:4]]
    walked, first = 0.0, start

    def over(a, b):
        for p in order[order.index(a) + 1 : order.index(b)]:
            if walked + dist(a, p) > limits.max_manhattan or dist(start, p) > limits.max_direct:
                return p
        return b

    for k in changes:
        if cut is not None and k >= cut:
            break
        p = order[k]
        step = dist(first, p) if trip[first][3] and not trip[p][3] else trip[first][4]
        far = walked + step >= limits.max_manhattan or dist(start, p) >= limits.max_direct
        choices = abs(trip[p][6] - trip[start][6])
        if trip[first][3] and walked + step >= limits.min_manhattan and dist(start, p) >= limits.min_direct and choices >= limits.min_out_degree:
            return p, f"{name}:min"
        if far:
            return over(first, p), f"{name}:max_md" if trip[first][3] and way < 0 else f"{name}:max_dist"
        if trip[first][3] and choices >= limits.max_out_degree:
            return p, f"{name}:max_out_degree"
        walked, first = walked + step, p
    if cut is not None:
        p = order[cut]
        return p, f"{name}:ci" if trip[p][5] else f"{name}:pi"
    end = over(first, order[-1]) if first != order[-1] else order[-1]
    return end, f"{name}:end" if end == order[-1] else f"{name}:max_md"


@pytest.mark.parametrize("seed, limits", [(1, (20, 20, 1, 90, 120, 3)), (2, (5, 10, 0, 400, 500, 9)), (3, (60, 60, 2, 61, 64, 2)), (4, (1e5, 1e5, 99, 2e5, 2e5, 99))])
def test_privacy_intervals(spark, seed, limits):
    rng, limits = random.Random(seed), PrivacyLimits(*limits)
    rows, spans, want = [], [], set()
    for t in range(12):
        n, lat, lon, edge, explicit, degree, own = rng.choice([1, 2, 3, 30, 80, 120]), 42.0, -83.0, 0, False, 0, []
        ends = (42.0, -83.0, 42.0, -83.0)
        for i in range(n):
            lat, lon = lat + rng.uniform(-2, 6) * 1e-5, lon + rng.uniform(-2, 6) * 1e-5
            if i and rng.random() < 0.15:
                edge, explicit = edge + 1, rng.random() < 0.6
                degree += explicit and rng.choice([0, 1, 2])
                ends = (lat, lon, lat + rng.uniform(0, 4e-4), lon)
            own.append([lat, lon, edge, explicit, distance(LatLon(*ends[:2]), LatLon(*ends[2:])), False, degree])
            rows.append((f"t{t}", i, lat, lon, edge, explicit, *ends, degree))
        for a in sorted(rng.sample(range(n), min(n, 3))):
            b = min(n, a + rng.choice([1, 4, 9]))
            spans.append((f"t{t}", a, b, ["x"]))
            for i in range(a, b):
                own[i][5] = True
        reach = 0
        stretches, i = [], 0
        while i < n:
            if own[i][5]:
                j = i
                while j < n and own[j][5]:
                    j += 1
                stretches.append((i, j))
                i = j
            else:
                i += 1
        at = 0
        for a, b in stretches:
            if b <= at:
                continue
            if a >= at and a > reach:
                end, why = search(own, a - 1, -1, reach, limits)
                want.add((f"t{t}", end, a, why))
            if b < n - 1:
                end, why = search(own, b, 1, None, limits)
                want.add((f"t{t}", b, end, why))
                at, reach = max(end, b), end if why != "forward:end" else reach
    points = spark.createDataFrame(rows, "trip_id string, idx long, lat double, lon double, edge_id long, edge_explicit boolean, v1_lat double, v1_lon double, v2_lat double, v2_lon double, out_degree long")
    marked = mark_points(points, merge_intervals(spark.createDataFrame(spans, "trip_id string, left long, right long, aux array<string>")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("3", "100000"):  # a trip in pieces gives what it does whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = [(r.trip_id, r.left, r.right, r.aux[0]) for r in find_privacy(marked, limits).collect()]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(got) == len(want) and set(got) == want and want


def test_privacy_search_keeps_runs():
    """Between pieces a search keeps runs, and places since the last critical point only."""
    limits, n = PrivacyLimits(10.0, 10.0, 0, 900.0, 900.0, 9), 40_000
    found, out = PrivacySearches(limits), []
    for start in range(0, n, 1000):
        idx = np.arange(start, start + 1000)
        critical = (idx % 4000 < 10) | (idx == n - 1)
        piece = {"idx": idx, "lat": 42.0 + idx * 1e-5, "lon": np.full(1000, -83.0), "edge_explicit": idx % 2000 < 1000, "edge_id": idx // 1000, "is_critical": critical, "out_degree": idx // 4000, "edge_length": np.full(1000, 1000.0)}
        out += found(piece)
        assert len(found.gap) <= 5 and sum(len(a) for a, _ in found.places) <= 4000
    out += found.close()
    assert len(out) == 20 and {tag.split(":")[0] for *_, tag in out} == {"forward", "backward"}
    assert all(0 <= a < b <= n for a, b, _ in out)


def test_detectors_carry_their_state(spark):
    """Trips in batches of a few rows give what whole trips do, in the memory of a batch."""
    rows = wander(11, network(11), trips=6, n=150)
    fitted = fit_trips(spark.createDataFrame([(None if r[0] == "t0" else r[0], *r[1:]) for r in rows], POINTS), None, heading_groups=12, min_edge_points=3)
    fitted = spark.createDataFrame(fitted.collect(), fitted.schema)
    whole = {}
    for r in sorted(fitted.collect(), key=lambda r: r.idx):
        whole.setdefault(r.trip_id, []).append(r.asDict())
    want = set()
    for trip, points in whole.items():
        columns = {c: np.array([p[c] for p in points], None if points[0][c] is not None else object) for c in points[0]}
        want |= {(trip, a, b, "ta") for a, b in area_turnarounds(columns, 6, 60.0, 20.0)}
        want |= {(trip, a, b, "stop") for a, b in stops_of(columns, 2.0, 30.0, 10.0)}
    assert {k for *_, k in want} == {"ta", "stop"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("1", "7", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = detect_fused(fitted, 6, 60.0, 20.0, 2.0, 30.0, 10.0).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(got) == len(want) and {(r.trip_id, r.left, r.right, r.aux[0]) for r in got} == want


def test_fold_sees_whole_trips_in_order(spark):
    """Trips of one row and of many batches, null ids, and empty tables."""
    sizes = {"a": 1, "b": 30_000, "c": 2, None: 5, "d": 12_000}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "trip_id string, idx long")

    def fold(trip):
        idx = trip.column("idx").to_pylist()
        return pa.table({"trip_id": trip.column(0).slice(0, 1), "n": pa.array([len(idx)]), "sorted": pa.array([idx == list(range(len(idx)))])})

    found = fold_trips(df, ["idx"], fold, "trip_id string, n long, sorted boolean")
    assert {r.trip_id: r.n for r in found.collect()} == sizes and found.filter("not sorted").count() == 0
    assert fold_trips(df.limit(0), ["idx"], fold, "trip_id string, n long, sorted boolean").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_index_by_insertion(spark, seed):
    """Edges put into a tree one after the other, each node splitting when it is full."""
    rng = random.Random(seed)
    edges = []
    for e in range(400):
        lat, lon = 42.0 + rng.random() * 0.04 * rng.random(), -83.0 + rng.random() * 0.03
        edges.append((e, 2 * e, lat, lon, 2 * e + 1, lat + rng.uniform(-1, 1) * 0.004, lon + rng.uniform(-1, 1) * 0.004, 3, 10.0))
    nodes, leaf_edges = build_index(spark.createDataFrame(edges, EDGES), *BOX)

    def crosses(p, q, a, b):
        d = (q[0] - p[0]) * (b[1] - a[1]) - (b[0] - a[0]) * (q[1] - p[1])
        if abs(d) < 100 * 2.220446049250313e-16:
            return False
        s = ((q[0] - p[0]) * (p[1] - a[1]) - (q[1] - p[1]) * (p[0] - a[0])) / d
        t = ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / d
        return 0 <= s <= 1 and 0 <= t <= 1

    def touches(box, e):
        s, w, n, o = box
        s, w, n, o = s - (n - s) / 10, w - (o - w) / 10, n + (n - s) / 10, o + (o - w) / 10
        ends, ring = (e[2:4], e[5:7]), [(s, w), (n, w), (n, o), (s, o)]
        return any(s <= a <= n and w <= b <= o for a, b in ends) or any(crosses(*ends, ring[i], ring[(i + 1) % 4]) for i in range(4))

    want, lists = {}, {}

    def grow(name, box, inside):
        s, w, n, o = box
        tall, wide = (n - s) / 2 >= 0.003, (o - w) / 2 >= 0.003
        want[name] = (box, len(inside))
        if len(inside) <= 32 or not (tall or wide):
            lists[name] = {e[0] for e in inside}
            return
        y, x = s + (n - s) / 2, w + (o - w) / 2
        parts = [(y, w, n, x), (y, x, n, o), (s, w, y, x), (s, x, y, o)] if tall and wide else [(y, w, n, o), (s, w, y, o)] if tall else [(s, w, n, x), (s, x, n, o)]
        for k, part in enumerate(parts):
            grow(f"{name}.{k}", part, [e for e in inside if touches(part, e)])

    root = (*BOX[0], *BOX[1])
    grow("r", root, [e for e in edges if touches(root, e)])
    got = {r.node: r for r in nodes.collect()}
    assert {k: ((r.sw_lat, r.sw_lon, r.ne_lat, r.ne_lon), r.n_edges) for k, r in got.items()} == want and len(want) > 20
    assert {k for k, r in got.items() if r.is_leaf} == set(lists)
    found = {}
    for r in leaf_edges.collect():
        found.setdefault(r.node, set()).add(r.edge_id)
    assert found == {k: v for k, v in lists.items() if v}
    points = spark.createDataFrame([(i, 41.985 + i * 0.0007, -83.01 + (i % 7) * 0.004) for i in range(80)], "p long, lat double, lon double")
    boxes = {k: want[k][0] for k in lists}
    for r in leaf_of(points, nodes, ["p"]).join(points, "p").collect():
        assert r.node == min((k for k, (s, w, n, o) in boxes.items() if s <= r.lat <= n and w <= r.lon <= o), default=None)


def test_marks_keep_columns(spark):
    points = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "trip_id string, idx long, x double")
    spans = spark.createDataFrame([("a", 1, 3, ["t"])], "trip_id string, left long, right long, aux array<string>")
    assert [tuple(r) for r in mark_points(points, merge_intervals(spans)).orderBy("idx").select("x", F.col("is_critical")).collect()] == [(0.0, False), (1.0, True), (2.0, True), (3.0, False)]
