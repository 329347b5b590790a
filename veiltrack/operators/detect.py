"""Detectors of critical behaviour: trip ends, turnarounds, stops."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import LatLon, bearing, distance, heading_delta, outside_side, project
from .folds import Columns, scan_intervals
from .roads import EXCLUDED_WAYS


def start_end(points: DataFrame) -> DataFrame:
    """The first and the last point of each trip."""
    n = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    span = lambda left, tag: F.struct(left.cast("long").alias("left"), (left + 1).cast("long").alias("right"), F.array(F.lit(tag)).alias("aux"))
    return n.select("trip_id", F.explode(F.array(span(F.lit(0), "start_pt"), span(F.col("n") - 1, "end_pt"))).alias("i")).select("trip_id", "i.*")


def turnaround_fit(fitted: DataFrame, delta: float = 90.0) -> DataFrame:
    """From the last point on a road to the next one on a road, with points on none between, if the heading has changed by delta."""
    trip = Window.partitionBy("trip_id").orderBy("idx")
    back = F.last(F.when(F.col("edge_explicit"), F.struct("idx", "heading")), ignorenulls=True).over(trip.rowsBetween(Window.unboundedPreceding, -1))
    rows = fitted.withColumn("__exit", back).filter("edge_explicit and __exit is not null and __exit.idx < idx - 1")
    turned = heading_delta(F.col("heading"), F.col("__exit.heading")) >= delta
    return rows.filter(turned).select("trip_id", F.col("__exit.idx").alias("left"), F.col("idx").alias("right"), F.array(F.lit("ta_fit")).alias("aux"))


def _area(v1: LatLon, v2: LatLon, width: float) -> list[LatLon]:
    course = bearing(v1, v2)
    left, right = np.fmod(course - 90.0, 360.0), np.fmod(course + 90.0, 360.0)
    return [project(v1, left, width / 2.0), project(v2, left, width / 2.0), project(v2, right, width / 2.0), project(v1, right, width / 2.0)]


class AreaTurnarounds:
    """Returns into the area of an inferred segment that was left before: (where it was left, where it was met again).

    Areas wait in a queue, the newest first, which holds max_queue - 1 of
    them; the newest isn't looked at.  A slow point in one of the others is a
    turnaround and empties the queue; a road does so as well.  A trip may come
    in pieces; the queue and the segment at hand are kept between them.
    """

    def __init__(self, max_queue: int, width: float, max_speed: float):
        self.max_queue, self.width, self.max_speed = max_queue, width, max_speed
        self.queue, self.current = deque(), None

    def __call__(self, piece: Columns) -> list[tuple[int, int]]:
        out = []
        rows = zip(*(piece[c].tolist() for c in ("idx", "lat", "lon", "speed", "edge_explicit", "edge_id", "v1_lat", "v1_lon", "v2_lat", "v2_lon")))
        for idx, lat, lon, speed, explicit, edge, *ends in rows:
            if explicit:
                self.queue.clear()
                self.current = None
                continue
            own = (edge, LatLon(*ends[:2]), LatLon(*ends[2:]))
            if self.current is None:
                self.current = own
                continue
            if speed < self.max_speed:
                here = LatLon(lat, lon)
                for corners, left in list(self.queue)[1:]:
                    if not any(outside_side(corners, side, here) for side in range(4)):
                        out.append((left, idx))
                        self.queue.clear()
                        break
            if edge != self.current[0]:
                if self.width > 0:
                    self.queue.appendleft((_area(self.current[1], self.current[2], self.width), idx))
                    if len(self.queue) >= self.max_queue:
                        self.queue.pop()
                self.current = own
        return out


class Stops:
    """Stretches of up to max_time seconds whose ends are at most min_distance apart, which begin slowly and not on an excluded road.

    A stretch grows while time allows.  Where it can't, it is a stop if it is
    short enough; else its front goes until it is, and until it begins as it
    should.  The last point of a stop is not in the interval, and a stretch
    that the trip's end cuts off is none.  A trip may come in pieces; the
    stretch at hand, the points of max_time seconds, is kept between them.
    """

    def __init__(self, max_time: float, min_distance: float, max_speed: float, excluded: frozenset[int] = EXCLUDED_WAYS):
        self.limit, self.min_distance, self.max_speed, self.excluded = int(max_time * 1_000_000), min_distance, max_speed, list(excluded)
        self.stretch = deque()  # (time, where, idx, may it begin here)

    def _short(self) -> bool:
        return distance(self.stretch[0][1], self.stretch[-1][1]) <= self.min_distance

    def __call__(self, piece: Columns) -> list[tuple[int, int]]:
        out, stretch = [], self.stretch
        way = np.nan_to_num(np.asarray(piece["edge_way_type"], float), nan=-1)
        begins = (np.asarray(piece["speed"]) < self.max_speed) & ~(np.asarray(piece["edge_explicit"], bool) & np.isin(way, self.excluded))
        for time, lat, lon, idx, begin in zip(*(piece[c].tolist() for c in ("time_us", "lat", "lon", "idx")), begins.tolist()):
            while stretch and not 0 <= time - stretch[0][0] <= self.limit:
                if self._short():
                    out.append((stretch[0][2], stretch[-1][2]))
                    stretch.clear()
                    break
                while stretch and not self._short():
                    stretch.popleft()
                while stretch and not stretch[0][3]:
                    stretch.popleft()
            if stretch or begin:
                stretch.append((time, LatLon(lat, lon), idx, begin))
        return out


def area_turnarounds(trip: Columns, max_queue: int, width: float, max_speed: float) -> list[tuple[int, int]]:
    """AreaTurnarounds of a whole trip."""
    return AreaTurnarounds(max_queue, width, max_speed)(trip)


def stops_of(trip: Columns, max_time: float, min_distance: float, max_speed: float, excluded: frozenset[int] = EXCLUDED_WAYS) -> list[tuple[int, int]]:
    """Stops of a whole trip."""
    return Stops(max_time, min_distance, max_speed, excluded)(trip)


_AREA_COLUMNS = ["lat", "lon", "speed", "edge_explicit", "edge_id", "v1_lat", "v1_lon", "v2_lat", "v2_lon"]
_STOP_COLUMNS = ["time_us", "lat", "lon", "speed", "edge_explicit", "edge_way_type"]


def turnaround_area(fitted: DataFrame, max_queue: int = 20, width: float = 30.0, max_speed: float = 15.0) -> DataFrame:
    return scan_intervals(fitted.select("trip_id", "idx", *_AREA_COLUMNS), lambda: [("ta", AreaTurnarounds(max_queue, width, max_speed))])


def turnarounds(fitted: DataFrame, max_queue: int = 20, width: float = 30.0, max_speed: float = 15.0, delta: float = 90.0) -> DataFrame:
    """Both kinds."""
    return turnaround_fit(fitted, delta).unionByName(turnaround_area(fitted, max_queue, width, max_speed))


def stops(fitted: DataFrame, max_time: float = 120.0, min_distance: float = 15.0, max_speed: float = 3.0, excluded: frozenset[int] = EXCLUDED_WAYS) -> DataFrame:
    return scan_intervals(fitted.select("trip_id", "idx", *_STOP_COLUMNS), lambda: [("stop", Stops(max_time, min_distance, max_speed, excluded))])


def detect_fused(fitted: DataFrame, max_queue: int, width: float, ta_speed: float, max_time: float, min_distance: float, stop_speed: float, excluded: frozenset[int] = EXCLUDED_WAYS) -> DataFrame:
    """Area turnarounds and stops in one scan: one shuffle and one pass over a trip for both."""
    columns = [*_AREA_COLUMNS, *(c for c in _STOP_COLUMNS if c not in _AREA_COLUMNS)]
    begin = lambda: [("ta", AreaTurnarounds(max_queue, width, ta_speed)), ("stop", Stops(max_time, min_distance, stop_speed, excluded))]
    return scan_intervals(fitted.select("trip_id", "idx", *columns), begin)
