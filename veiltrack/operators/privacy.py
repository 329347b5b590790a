"""Privacy intervals around critical ones, removal of points, and counters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, LatLon, distance
from .fit import edge_length
from .folds import Columns, scan_intervals


@dataclass(frozen=True)
class PrivacyLimits:
    """Distances in metres and choices at intersections: between min and max an interval may end, at max it must.  The random parts are shares of max - min."""

    min_direct: float = 500.0
    min_manhattan: float = 650.0
    min_out_degree: int = 8
    max_direct: float = 2500.0
    max_manhattan: float = 3000.0
    max_out_degree: int = 16
    rand_direct: float = 0.0
    rand_manhattan: float = 0.0
    rand_out_degree: float = 0.0


def _lengths(draws: tuple[float, float, float], limits: PrivacyLimits) -> tuple[float, float, int]:
    """The least distances and choices of one search, with its random parts."""
    grow = lambda low, high, share, u: low + (high - low) * share * u
    return (
        grow(limits.min_direct, limits.max_direct, limits.rand_direct, draws[0]),
        grow(limits.min_manhattan, limits.max_manhattan, limits.rand_manhattan, draws[1]),
        limits.min_out_degree + int((limits.max_out_degree - limits.min_out_degree) * limits.rand_out_degree * draws[2]),
    )


class Place(NamedTuple):
    """A point of a trip at which a run begins or ends."""

    idx: int
    at: LatLon
    degree: int
    draws: tuple[float, float, float]


class Run(NamedTuple):
    """Neighbouring points of a trip on one edge that are all critical, or none of them, by its first and its last point."""

    first: Place
    last: Place
    explicit: bool
    length: float
    critical: bool


class Search(NamedTuple):
    """Where a search ends and why; or, if sooner is there, for that reason at the first point between low and end that lies too far from home or, with what was walked before low, from low, which is at near."""

    end: int
    why: str
    sooner: str | None = None
    low: int = 0
    near: LatLon | None = None
    home: LatLon | None = None
    walked: float = 0.0


def _search(gap: list[Run], way: int, critical: int | None, last_end: int | None, limits: PrivacyLimits) -> Search:
    """From one end of a gap, the runs between two critical stretches, in one direction (1 or -1) to the other end, where the point ``critical`` follows, or none, or to last_end.

    Whenever the edge changes, the edge just left is judged: by its length if
    it was inferred, or a road that gave way to a road; else by the way across
    it.
    """
    runs, side = (gap, 0) if way > 0 else (gap[::-1], 1)
    name, home, walked, current = "forward" if way > 0 else "backward", runs[0][side], 0.0, runs[0]
    min_direct, min_walked, min_choices = _lengths(home.draws, limits)
    cut = lambda end, why, sooner: Search(end, f"{name}:{why}", f"{name}:{sooner}", current[side].idx, current[side].at, home.at, walked)
    for following in [*runs[1:], None]:
        if last_end is not None and (current.first.idx <= last_end <= current.last.idx or (following is not None and last_end == following[side].idx)):
            return Search(last_end, f"{name}:pi")
        if following is None:
            break
        here = following[side]
        direct = distance(home.at, here.at)
        crossed = distance(current[side].at, here.at) if current.explicit and not following.explicit else current.length
        far = crossed + walked >= limits.max_manhattan or direct >= limits.max_direct
        if current.explicit:
            choices = abs(here.degree - home.degree)
            if crossed + walked >= min_walked and direct >= min_direct and choices >= min_choices:
                return Search(here.idx, f"{name}:min")
            if far:
                return cut(here.idx, *["max_dist" if way > 0 else "max_md"] * 2)
            if choices >= limits.max_out_degree:
                return Search(here.idx, f"{name}:max_out_degree")
        elif far:
            return cut(here.idx, "max_dist", "max_dist")
        walked += crossed
        current = following
    return cut(current.last.idx, "end", "max_md") if critical is None else Search(critical, f"{name}:ci")


class PrivacySearches:
    """Privacy intervals (left, right, tag) of a trip, piece by piece: __call__ takes its points in order, close the rest.

    From each critical stretch a search goes forwards, and from the next one
    backwards, if the first leaves room, as far as the first has come.  Before
    the first critical stretch a search goes back to the trip's first point.
    Searches go over runs; points are looked at only in a run that takes a
    search too far.  What is kept between pieces are the runs since the last
    critical point, and 16 bytes for each point since then.
    """

    def __init__(self, limits: PrivacyLimits):
        self.limits, self.gap, self.before = limits, [], None
        self.run: Run | None = None
        self.key, self.places = None, []

    def __call__(self, piece: Columns) -> list[tuple[int, int, str]]:
        out, keys = [], [np.asarray(piece[c]) for c in RUN_KEY]
        n = len(keys[0])
        changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if n > 1 else np.zeros(0, bool)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist()] if n else []
        for a, b in zip(starts, [*starts[1:], n]):
            key = tuple(k[a].item() if hasattr(k[a], "item") else k[a] for k in keys)
            last = _place(piece, b - 1, "backward")
            if key != self.key:
                self._end_run()
                self.key, self.run = key, Run(_place(piece, a, "forward"), last, bool(key[0]), float(piece["edge_length"][a]), bool(key[2]))
                if self.run.critical:
                    out += self._end_gap(self.run.first.idx)
            else:
                self.run = self.run._replace(last=last)
            if not self.run.critical:
                self.places.append((np.array(piece["lat"][a:b], float), np.array(piece["lon"][a:b], float)))
        return out

    def close(self) -> list[tuple[int, int, str]]:
        """At the trip's end."""
        self._end_run()
        return self._end_gap(None)

    def _end_run(self) -> None:
        if self.run is not None and self.run.critical:
            self.before = self.run.last.idx
        elif self.run is not None:
            self.gap.append(self.run)

    def _end_gap(self, until: int | None) -> list[tuple[int, int, str]]:
        """The searches between the critical point before, if there is one, and the critical point until, if there is one."""
        out, gap = [], self.gap
        if gap:
            start, reached = gap[0].first.idx, 0 if self.before is None else None
            if self.before is not None and (until is not None or start < gap[-1].last.idx):
                reached, why = self._cut(_search(gap, 1, until, None, self.limits))
                out.append((start, reached, why))
            if until is not None and until > reached:
                end, why = self._cut(_search(gap, -1, self.before, reached, self.limits))
                out.append((end, until, why))
        self.gap, self.places = [], []
        return out

    def _cut(self, search: Search) -> tuple[int, str]:
        """Where a search ends, and why: sooner, if a point of its last run lies too far."""
        if search.sooner is None:
            return search.end, search.why
        if len(self.places) > 1:
            self.places = [tuple(map(np.concatenate, zip(*self.places)))]
        start = self.gap[0].first.idx
        way = 1 if search.end > search.low else -1
        between = range(search.low + way, search.end, way)
        for k in range(0, len(between), 4096):
            part = between[k : k + 4096]
            lat, lon = (x[np.array(part) - start] for x in self.places[0])
            far = (search.walked + _metres(search.near, lat, lon) > self.limits.max_manhattan) | (_metres(search.home, lat, lon) > self.limits.max_direct)
            if far.any():
                return part[int(far.argmax())], search.sooner
        return search.end, search.why


def _metres(a: LatLon, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """distance of points from one."""
    to_lat, to_lon, a_lat, a_lon = np.radians(lat), np.radians(lon), np.radians(a.lat), np.radians(a.lon)
    return np.sqrt(((to_lon - a_lon) * np.cos((a_lat + to_lat) / 2.0)) ** 2 + (to_lat - a_lat) ** 2) * EARTH_RADIUS_M


def _place(piece: Columns, i: int, way: str) -> Place:
    draws = tuple(float(piece[f"{way}{k}"][i]) for k in range(3)) if f"{way}0" in piece else (0.0, 0.0, 0.0)
    return Place(int(piece["idx"][i]), LatLon(float(piece["lat"][i]), float(piece["lon"][i])), int(piece["out_degree"][i]), draws)


def privacy_of(trip: Columns, limits: PrivacyLimits) -> list[tuple[int, int, str]]:
    """Privacy intervals of a whole trip: (left, right, tag)."""
    found = PrivacySearches(limits)
    return found(trip) + found.close()


RUN_KEY = ["edge_explicit", "edge_id", "is_critical"]


def find_privacy(marked: DataFrame, limits: PrivacyLimits, seed: int = 0) -> DataFrame:
    """trip_id, left, right, aux of points with edges, out_degree and is_critical, as fit, count_choices and mark_points give them.

    Random parts come from a hash of seed, trip, point, direction and metric:
    the same input gives the same intervals on any cluster.
    """
    drawn = bool(limits.rand_direct or limits.rand_manhattan or limits.rand_out_degree)
    draws = {f"{way}{k}": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("trip_id").cast("string"), "idx", F.lit(way), F.lit(k)), 11) / F.lit(float(1 << 53)) for way in ("forward", "backward") for k in range(3) if drawn}
    rows = marked.select("trip_id", "idx", "lat", "lon", *RUN_KEY, "out_degree", edge_length().alias("edge_length"), *(v.alias(k) for k, v in draws.items()))
    return scan_intervals(rows, lambda: [("", PrivacySearches(limits))])


def deidentify(marked: DataFrame) -> DataFrame:
    """Points that are neither critical nor private."""
    return marked.filter(~F.col("is_critical") & ~F.col("is_private"))


COUNTERS = ["n_points", "n_invalid_field", "n_invalid_geo", "n_invalid_heading", "n_error", "n_ci", "n_pi"]


def point_counters(marked: DataFrame, records: DataFrame | None = None, corrected: DataFrame | None = None) -> DataFrame:
    """A row a trip of COUNTERS.  A point both critical and private counts as critical.

    records are counters by trip of the reader; without them every point is
    valid.  corrected are the points before error correction.
    """
    out = marked.groupBy("trip_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("is_critical").cast("long")).alias("n_ci"), F.sum((~F.col("is_critical") & F.col("is_private")).cast("long")).alias("n_pi"))
    zero = F.lit(0).cast("long")
    if corrected is not None:
        out = corrected.groupBy("trip_id").agg(F.count(F.lit(1)).alias("before")).join(out, "trip_id", "left").withColumn("n_error", F.col("before") - F.coalesce("kept", zero)).drop("before")
    else:
        out = out.withColumn("n_error", zero)
    if records is not None:
        out = records.join(out, "trip_id", "left")
    else:
        out = out.withColumns({"n_points": F.col("kept") + F.col("n_error"), "n_invalid_field": zero, "n_invalid_geo": zero, "n_invalid_heading": zero})
    return out.select("trip_id", *(F.coalesce(F.col(c), zero).alias(c) for c in COUNTERS))


def sum_counters(counters: DataFrame) -> DataFrame:
    """One row over all trips."""
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))
