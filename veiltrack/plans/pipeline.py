"""The de-identification pipeline: each stage a function of DataFrames, and all of them in their order."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.clean import correct_errors
from ..operators.detect import detect_fused, start_end, turnaround_fit
from ..operators.fit import count_choices, fit_trips
from ..operators.intervals import mark_points, merge_intervals, union_intervals
from ..operators.privacy import PrivacyLimits, deidentify, find_privacy, point_counters
from ..operators.roads import kept_index, vertices
from ..session import checkpointed
from .config import DIConfig
from .progress import watched


class Result(NamedTuple):
    """What a run gives; the fit and both kinds of intervals have been computed, the rest is lazy."""

    kept: DataFrame
    marked: DataFrame
    critical: DataFrame
    private: DataFrame
    counters: DataFrame


def limits_of(config: DIConfig) -> PrivacyLimits:
    return PrivacyLimits(config.min_direct, config.min_manhattan, config.min_out_degree, config.max_direct, config.max_manhattan, config.max_out_degree, config.rand_direct, config.rand_manhattan, config.rand_out_degree)


def fit(points: DataFrame, edges: DataFrame | None, config: DIConfig, use_index: bool = True) -> DataFrame:
    """Points fit to roads and inferred segments, with their choices at intersections."""
    index = kept_index(edges, (config.sw_lat, config.sw_lon), (config.ne_lat, config.ne_lon)) if edges is not None and use_index else None
    fitted = fit_trips(points, edges, index, config.fit_scale, config.fit_extension, config.heading_groups, config.min_edge_points)
    if edges is None:
        return fitted.withColumn("out_degree", F.lit(0).cast("long"))
    return count_choices(fitted, vertices(edges))


def critical_intervals(fitted: DataFrame, config: DIConfig) -> DataFrame:
    """Of all detectors, not merged."""
    slow = detect_fused(fitted, config.ta_max_queue, config.ta_area_width, config.ta_max_speed, config.stop_max_time, config.stop_min_distance, config.stop_max_speed)
    return union_intervals(turnaround_fit(fitted, config.ta_heading_delta), slow, start_end(fitted))


def _done(df: DataFrame, what: str, progress: Callable[[str], None] | None) -> DataFrame:
    """df computed once; progress is told each tenth of it that is done, its rows, counted on the way, and the seconds that it took."""
    if progress is None:
        return checkpointed(df)
    seen, began, tenths = Observation(what), time.monotonic(), [0]

    def tell(share: float) -> None:
        if int(share * 10) > tenths[0]:
            tenths[0] = int(share * 10)
            progress(f"{what}: {tenths[0]}0 %")

    with watched(df.sparkSession, tell):
        out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    progress(f"{what}: {seen.get['rows']} rows, {time.monotonic() - began:.1f} s")
    return out


def run(points: DataFrame, edges: DataFrame | None, config: DIConfig, records: DataFrame | None = None, correct: bool = True, use_index: bool = True, progress: Callable[[str], None] | None = None) -> Result:
    """All stages over points (trip_id, idx, raw, time_us, lat, lon, heading, speed) and road edges, if there are any.  progress gets a line for each stage that has been computed."""
    clean = correct_errors(points, config.error_sample) if correct else points
    fitted = _done(fit(clean, edges, config, use_index), "points fit to roads", progress)  # detectors and marks read it several times
    critical = _done(critical_intervals(fitted, config), "critical intervals", progress)
    marked = mark_points(fitted, merge_intervals(critical))
    private = _done(find_privacy(marked, limits_of(config), config.seed), "privacy intervals", progress)
    marked = mark_points(marked, merge_intervals(private), "pi_id", "is_private")
    return Result(deidentify(marked), marked, critical, private, point_counters(marked, records, points))
