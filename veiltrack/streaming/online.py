"""De-identification of trips as they stream in, with GPS errors corrected, a road map if there is one, and random parts of the limits.

Each point meets the roads as it comes: joins with the map's cells and the
index's leaves give it one column of candidates, without state.  Points of a
trip are list state that only grows, so a batch writes its own points and reads
none.  A timer closes a trip when the watermark has passed its last point by
``gap_seconds``; then, once, the points are read, the same rules as in a batch
run over them, and the points that are kept go out.  Inferred segments take
their final ends from the whole trip, and privacy intervals grow in both
directions, so nothing of a trip can be released before its end.

Spark's RocksDB state store is needed: set
``spark.sql.streaming.stateStore.providerClass`` to STATE_STORE, as
:func:`use_state_store` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import LatLon, angle_error, bearing, distance
from ..operators.clean import correct_trip
from ..operators.detect import area_turnarounds, stops_of
from ..operators.fit import CELLS, MOST_BROADCAST, choose_edges, deal_areas, edge_areas, infer_edges, inferred_ends
from ..operators.folds import Columns, columns_of, fold_trips
from ..operators.privacy import privacy_of
from ..operators.roads import kept_index, leaf_levels, path_of, vertices
from ..plans.config import DIConfig
from ..plans.pipeline import limits_of
from ..session import kept

POINT = ["time_us", "lat", "lon", "heading", "speed", "raw"]
KEPT = "trip_id string, idx long, time_us long, lat double, lon double, heading double, speed double, raw string"
_ROAD = ["edge_id", "way_type", "v1_id", "v1_lat", "v1_lon", "v1_choices", "v2_id", "v2_lat", "v2_lon", "v2_choices"]
_SIDES = [f"{n}{side}" for side in (1, 3) for n in ("k", "dlat", "dlon")]
_TYPES = {"edge_id": "long", "way_type": "int", "v1_id": "long", "v2_id": "long", "v1_choices": "int", "v2_choices": "int", "in_leaf": "boolean"}
#: A candidate: the road, whether the index finds it, its errors, and its sides over the two ends.
NEAR = "near array<struct<" + ",".join(f"{n}:{_TYPES.get(n, 'double')}" for n in [*_ROAD, "in_leaf", "error", "error_v1", "error_v2", *_SIDES]) + ">>"
STATE = "time_us long, lat double, lon double, heading double, speed double, raw string, " + NEAR
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def with_candidates(points: DataFrame, edges: DataFrame | None, config: DIConfig) -> DataFrame:
    """points with near, the roads whose area has each: one row a point, in a stream as well.

    The map's areas are collected by cell and the index's edges by leaf, and
    each size of cell and leaf is one join, broadcast if its map is small.
    """
    if edges is None:
        return points.withColumn("near", F.expr(f"cast(array() as {NEAR[5:]})"))

    def made():
        choices = vertices(edges).select("vertex_id", F.col("out_degree").cast("int").alias("n"))
        roads = edges
        for v in ("v1", "v2"):
            roads = roads.join(choices.select(F.col("vertex_id").alias(f"{v}_id"), F.col("n").alias(f"{v}_choices")), f"{v}_id")
        return deal_areas(edge_areas(roads, config.fit_scale, config.fit_extension), [*_ROAD, "bearing"])

    areas = kept(edges, ("roads of streams", config.fit_scale, config.fit_extension), made)
    columns = [c for c in areas.dealt.columns if c not in ("level", "cx", "cy")]
    rows, own = points, []
    for level in sorted(areas.rows):
        cells = areas.dealt.filter(F.col("level") == level).groupBy("cx", "cy").agg(F.collect_list(F.struct(*columns)).alias(f"__near{level}"))
        at = {c: F.floor(F.col(x) / CELLS[level]) for c, x in (("cx", "lat"), ("cy", "lon"))}
        rows = rows.withColumns(at).join(_small(cells, areas.rows[level]), ["cx", "cy"], "left").drop("cx", "cy")
        own.append(F.coalesce(F.col(f"__near{level}"), F.array().cast(cells.schema[f"__near{level}"].dataType)))
    here = LatLon(F.col("lat"), F.col("lon"))
    out = lambda a, side: a[f"k{side}"] - here.lat * a[f"dlon{side}"] + here.lon * a[f"dlat{side}"] < 0.0
    rows = rows.withColumn("__near", F.filter(F.concat(*own), lambda a: ~(out(a, 0) | out(a, 1) | out(a, 2) | out(a, 3)))).drop(*(f"__near{level}" for level in areas.rows))

    nodes, leaf_edges = kept_index(edges, (config.sw_lat, config.sw_lon), (config.ne_lat, config.ne_lon))
    listed = leaf_edges.groupBy("node").agg(F.collect_list("edge_id").alias("ids")).join(nodes.filter("is_leaf").select("node", "level"), "node")
    root, depth, levels, n = leaf_levels(nodes)
    rows = rows.withColumn("path", path_of(root, depth))
    for level in levels:
        own = listed.filter(F.col("level") == level).select(F.col("node").alias("__leaf"), F.col("ids").alias(f"__ids{level}"))
        rows = rows.join(_small(own, n), F.substring("path", 1, 1 + 2 * level) == F.col("__leaf"), "left").drop("__leaf")
    ids = F.coalesce(*(F.col(f"__ids{level}") for level in levels), F.array().cast("array<bigint>"))

    def candidate(a):
        ends = LatLon(a["v1_lat"], a["v1_lon"]), LatLon(a["v2_lat"], a["v2_lon"])
        errors = {"error": a["bearing"], "error_v1": bearing(here, ends[1]), "error_v2": bearing(here, ends[0])}
        return F.struct(*(a[c].alias(c) for c in _ROAD), F.array_contains(F.col("__ids"), a["edge_id"]).alias("in_leaf"), *(angle_error(F.col("heading"), v).alias(k) for k, v in errors.items()), *(a[c].alias(c) for c in _SIDES))

    return rows.withColumn("__ids", ids).withColumn("near", F.transform("__near", candidate)).select(*points.columns, "near")


def fit_columns(trip: Columns, config: DIConfig) -> Columns:
    """A trip's points, with their candidates, on roads and inferred segments, and the choices met so far."""
    lat, lon = trip["lat"], trip["lon"]
    held = [sorted(near, key=lambda c: c["edge_id"]) for near in trip["near"]]
    ends = np.cumsum([0, *map(len, held)]).tolist()
    near = {c: [r[c] for own in held for r in own] for c in [*_ROAD, "in_leaf", "error", "error_v1", "error_v2"]}
    onward = [(i + 1, r) for i, own in enumerate(held) for r in own]
    beyond = lambda side: [p < len(lat) and r[f"k{side}"] - lat[p] * r[f"dlon{side}"] + lon[p] * r[f"dlat{side}"] < 0.0 for p, r in onward]
    chosen = choose_edges(list(zip(ends, ends[1:])), {**near, "beyond_v1": beyond(3), "beyond_v2": beyond(1)})
    explicit = np.array([c >= 0 for c in chosen], bool)
    sectors = np.floor(trip["heading"] / (360.0 / config.heading_groups)).astype(np.int64) % config.heading_groups
    segment = infer_edges(explicit, sectors, config.min_edge_points)
    with_length = lambda row: (*row, distance(LatLon(*row[2:4]), LatLon(*row[4:6])))
    inferred = {s: with_length((s, np.nan, *(float(x[i]) for i in span for x in (lat, lon)))) for s, span in inferred_ends(segment, explicit).items()}
    roads: dict[int, tuple] = {}
    rows, total, before, counted = [], 0, None, None
    for c, s in zip(chosen, segment.tolist()):
        if c >= 0:
            own = {k: near[k][c] for k in _ROAD}
            if before is not None and before["edge_id"] != own["edge_id"]:
                here = (own["v1_id"], own["v2_id"])
                vertex = next((before[v] for v in ("v1_id", "v2_id") if before[v] in here), None)
                if vertex is not None:
                    if vertex != counted:
                        total += own["v1_choices"] if own["v1_id"] == vertex else own["v2_choices"]
                    counted = vertex
            before = own
            if own["edge_id"] not in roads:
                roads[own["edge_id"]] = with_length((own["edge_id"], own["way_type"], own["v1_lat"], own["v1_lon"], own["v2_lat"], own["v2_lon"]))
            rows.append((*roads[own["edge_id"]], total))
        else:
            rows.append((*inferred[s], total))
    names = ("edge_id", "edge_way_type", "v1_lat", "v1_lon", "v2_lat", "v2_lon", "edge_length", "out_degree")
    types = {"edge_id": np.int64, "out_degree": np.int64}
    return {**trip, "edge_explicit": explicit, **{n: np.array(v, types.get(n, float)) for n, v in zip(names, zip(*rows))}}


def fit_trip(trip: pd.DataFrame, config: DIConfig) -> pd.DataFrame:
    """fit_columns of a trip in a table."""
    own = {c: trip[c].to_numpy() for c in ("lat", "lon", "heading", "near")}
    return trip.assign(**{c: v for c, v in fit_columns(own, config).items() if c not in own})


def fit_turnarounds(fitted: Columns, delta: float) -> list[tuple[int, int]]:
    """From a road to the next one with other points between, where the heading has changed by delta."""
    at = np.flatnonzero(fitted["edge_explicit"])
    turned = np.abs(np.diff(fitted["heading"][at]))
    turned = np.where(turned < 180.0, turned, 360.0 - turned)
    return [(int(a), int(b)) for a, b, t in zip(at, at[1:], turned) if a < b - 1 and t >= delta]


def draws(trip_id: str, n: int, seed: int) -> dict[str, np.ndarray]:
    """The random parts of a trip's searches: the hashes of the batch form, which chain their arguments."""
    import xxhash

    chain = lambda value, seed: xxhash.xxh64_intdigest(value, seed)
    start = chain(trip_id.encode(), chain(seed.to_bytes(4, "little", signed=True), 42))
    out = {}
    for way in ("forward", "backward"):
        own = [chain(way.encode(), chain(i.to_bytes(8, "little"), start)) for i in range(n)]
        for k in range(3):
            out[f"{way}{k}"] = np.array([(chain(k.to_bytes(4, "little"), h) >> 11) / float(1 << 53) for h in own])
    return out


def kept_places(trip: Columns, config: DIConfig, trip_id: str = "", correct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of the points of a whole trip, in order, those that are no errors and neither critical nor private: their places, and their idx without the errors."""
    n = len(trip["lat"])
    at = correct_trip(trip["lat"], trip["lon"], config.error_sample) if correct else np.arange(n)
    if not len(at):
        return at, at
    if len(at) < n:
        trip = {c: v[at] for c, v in trip.items()}
    n = len(at)
    fitted = fit_columns({**trip, "idx": np.arange(n)}, config)
    spans = [(0, 1), (n - 1, n), *fit_turnarounds(fitted, config.ta_heading_delta)]
    spans += area_turnarounds(fitted, config.ta_max_queue, config.ta_area_width, config.ta_max_speed)
    spans += stops_of(fitted, config.stop_max_time, config.stop_min_distance, config.stop_max_speed)
    critical = np.zeros(n, bool)
    for left, right in spans:
        critical[left:right] = True
    private = np.zeros(n, bool)
    limits = limits_of(config)
    drawn = limits.rand_direct or limits.rand_manhattan or limits.rand_out_degree
    for left, right, _ in privacy_of({**fitted, "is_critical": critical, **(draws(trip_id, n, config.seed) if drawn else {})}, limits):
        private[left:right] = True
    idx = np.flatnonzero(~critical & ~private)
    return at[idx], idx


_NUMBERS = [c for c in POINT if c != "raw"]


def _lists(values: list) -> np.ndarray:
    """An array of lists."""
    out = np.empty(len(values), object)
    out[:] = values
    return out


def keep_points(trip: pd.DataFrame, config: DIConfig, trip_id: str = "", correct: bool = True) -> pd.DataFrame:
    """The points of kept_places, with idx."""
    at, idx = kept_places({**{c: trip[c].to_numpy() for c in _NUMBERS}, "near": _lists(list(trip["near"]))}, config, trip_id, correct)
    return trip.iloc[at].assign(idx=idx).reset_index(drop=True)


_COLUMNS = [c.split()[0] for c in KEPT.split(", ")]


class TripKeeper(StatefulProcessor):
    """Holds a trip's points until its timer says that it is over."""

    def __init__(self, config: DIConfig, gap_ms: int):
        self.config, self.gap_ms = config, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", STATE)
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            made = [(*row[:-1], [dict(c) for c in row[-1]]) for row in zip(*(batch[c].tolist() for c in [*POINT, "near"]))]
            self.points.appendList(made)
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
        due = max(latest + self.gap_ms, timerValues.getCurrentWatermarkInMs() + 1)
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or due > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        trip = pd.DataFrame([tuple(p) for p in self.points.get()], columns=[*POINT, "near"])
        self.points.clear()
        self.due.clear()
        trip = trip.sort_values(["time_us", "raw"], kind="stable")
        yield keep_points(trip, self.config, key[0]).assign(trip_id=key[0])[_COLUMNS]

    def close(self) -> None:
        pass


def stream_kept_points(points: DataFrame, config: DIConfig, edges: DataFrame | None = None, gap_seconds: int = 300, delay: str = "1 minute") -> DataFrame:
    """KEPT rows of a stream of trip_id, ts and the columns of POINT, fit to the roads edges if there are any.

    ts is event time (points of a trip are ordered by time_us, then raw); a
    trip is over when the watermark, ``delay`` behind the newest ts, has passed
    its last ts by gap_seconds.  A later point starts a new trip of the same
    id; one that is behind the watermark is dropped by Spark.
    """
    rows = with_candidates(points.withWatermark("ts", delay).select("trip_id", "ts", *POINT), edges, config)
    return rows.groupBy("trip_id").transformWithStateInPandas(TripKeeper(config, gap_seconds * 1000), KEPT, "Append", "EventTime")


def kept_points(points: DataFrame, config: DIConfig, edges: DataFrame | None = None) -> DataFrame:
    """The same on a table of whole trips: KEPT rows."""

    def one(trip: pa.Table) -> pa.Table:
        at, idx = kept_places({**columns_of(trip, _NUMBERS), "near": _lists(trip.column("near").to_pylist())}, config, trip.column(0)[0].as_py())
        kept = trip.select(["trip_id", *POINT]).take(pa.array(at, pa.int64()))
        return kept.add_column(1, "idx", pa.array(idx, pa.int64()))

    order = [F.col(c).asc_nulls_last() for c in ("time_us", "raw")]
    return fold_trips(with_candidates(points.select("trip_id", *POINT), edges, config), order, one, KEPT)
