"""Fitting points to roads: candidates by spatial join, the sticky choice among them, inferred segments, and choices met at intersections."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.geo import LatLon, angle_error, bearing, distance, edge_area, heading_sector
from ..session import checkpointed, kept
from .folds import fold_trips
from .roads import LEAF_DEGREES, MOST_BROADCAST, ends, leaf_of

CORNERS = [f"c{i}_{x}" for i in range(4) for x in ("lat", "lon")]


def edge_areas(edges: DataFrame, scale: float = 1.0, extension: float = 5.0) -> DataFrame:
    """edges with the corners of the area of each, and its bearing; edges without an area go."""
    corners = edge_area(*ends(), F.col("width") * scale, extension)
    flat = {name: value for name, value in zip(CORNERS, [v for c in corners for v in c])}
    return edges.filter(F.col("width") * scale > 0).withColumns({**flat, "bearing": bearing(*ends())})


def corners_of(prefix: str = "") -> list[LatLon]:
    return [LatLon(F.col(f"{prefix}c{i}_lat"), F.col(f"{prefix}c{i}_lon")) for i in range(4)]


#: Sides of cells in degrees: each area is dealt to cells that are no smaller than itself, four at most.
CELLS = [LEAF_DEGREES * 4.0**level for level in range(10)]
#: Points of a cell that one task meets with its areas, where areas aren't broadcast.
CELL_POINTS = 500_000


class Areas(NamedTuple):
    """Areas of roads dealt to cells (level, cx, cy): what a point needs to know of each, computed once; and how many rows of each level there are."""

    dealt: DataFrame
    rows: dict[int, int]

    @property
    def small(self) -> bool:
        return sum(self.rows.values()) <= MOST_BROADCAST


def _edge_numbers(side: int) -> dict[str, Column]:
    """What outside_side takes of a side of an area, apart from the point."""
    a, b = corners_of()[side], corners_of()[(side + 1) % 4]
    return {f"k{side}": a.lat * (b.lon - a.lon) - a.lon * (b.lat - a.lat), f"dlat{side}": b.lat - a.lat, f"dlon{side}": b.lon - a.lon}


def beyond(side: int, p: LatLon) -> Column:
    """outside_side by the numbers of an area's side."""
    return F.col(f"k{side}") - p.lat * F.col(f"dlon{side}") + p.lon * F.col(f"dlat{side}") < 0.0


def deal_areas(areas: DataFrame, keep: list[str]) -> Areas:
    """areas (as edge_areas gives them) by cells, with the columns ``keep``."""
    low, high = ({x: f(*(F.col(f"c{i}_{x}") for i in range(4))) for x in ("lat", "lon")} for f in (F.least, F.greatest))
    boxes = areas.withColumns({f"__{n}_{x}": v[x] for n, v in (("low", low), ("high", high)) for x in v})
    side = F.greatest(F.col("__high_lat") - F.col("__low_lat"), F.col("__high_lon") - F.col("__low_lon"))
    level = F.lit(len(CELLS) - 1)
    for i in range(len(CELLS) - 2, -1, -1):
        level = F.when(side <= CELLS[i], i).otherwise(level)
    numbers = {name: value for i in range(4) for name, value in _edge_numbers(i).items()}
    rows = boxes.withColumns({"level": level, **numbers}).withColumn("__cell", F.element_at(F.array(*map(F.lit, CELLS)), F.col("level") + 1))
    cells = lambda x: F.explode(F.sequence(F.floor(F.col(f"__low_{x}") / F.col("__cell")), F.floor(F.col(f"__high_{x}") / F.col("__cell"))))
    rows = rows.withColumn("cx", cells("lat")).withColumn("cy", cells("lon"))
    dealt = checkpointed(rows.select("level", "cx", "cy", *keep, *numbers))  # a step of its own: trigonometry stays out of the join's code
    return Areas(dealt, {r["level"]: r["count"] for r in dealt.groupBy("level").count().collect()})


def meet(points: DataFrame, areas: Areas, cell_points: int = CELL_POINTS) -> DataFrame:
    """points with the areas that contain them: an equi-join by cells, of each size that areas have.

    Areas are broadcast if they are few.  If not, points of a cell that has
    many of them, as counted, are dealt to several tasks, which each get the
    cell's areas.
    """
    cell = lambda x, level: F.floor(F.col(x) / CELLS[level])
    keys = [F.struct(F.lit(level).alias("level"), cell("lat", level).alias("cx"), cell("lon", level).alias("cy")) for level in sorted(areas.rows)]
    rows = points.withColumn("__key", F.explode(F.array(*keys) if keys else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))).select("*", "__key.level", "__key.cx", "__key.cy").drop("__key")
    on, dealt = ["level", "cx", "cy"], areas.dealt
    if areas.small:
        dealt = F.broadcast(dealt)
    else:
        full = rows.groupBy(*on).count().filter(F.col("count") > cell_points)
        full = checkpointed(full.select(*on, F.ceil(F.col("count") / cell_points).cast("int").alias("__tasks")))
        rows = rows.join(full, on, "left").withColumn("__task", F.pmod(F.xxhash64("trip_id", "idx"), F.coalesce("__tasks", F.lit(1))).cast("int")).drop("__tasks")
        dealt = dealt.join(full, on, "left").withColumn("__task", F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))).drop("__tasks")
        on = [*on, "__task"]
    here = LatLon(F.col("lat"), F.col("lon"))
    out = beyond(0, here) | beyond(1, here) | beyond(2, here) | beyond(3, here)
    return rows.join(dealt, on).filter(~out).drop(*on)


def _candidates(points: DataFrame, areas: Areas, index: tuple[DataFrame, DataFrame] | None, keep: list[str]) -> DataFrame:
    """trip_id, idx, edge_id, error, error_v1, error_v2, beyond_v1, beyond_v2, in_leaf and the columns ``keep`` of areas."""
    rows = points.select("trip_id", "idx", "lat", "lon", "heading", "next_lat", "next_lon")
    if index is not None:
        rows = leaf_of(rows, index[0], rows.columns)
    near = meet(rows, areas)
    here, onward, (v1, v2) = LatLon(F.col("lat"), F.col("lon")), LatLon(F.col("next_lat"), F.col("next_lon")), ends()
    own = ["trip_id", "idx", "edge_id", *keep, *(["node"] if index is not None else [])]
    # bearings first, in a step of their own: each error takes an angle several times
    near = near.select(*own, "heading", "bearing", bearing(here, v2).alias("__to_v2"), bearing(here, v1).alias("__to_v1"), beyond(3, onward).alias("beyond_v1"), beyond(1, onward).alias("beyond_v2"))
    near = near.select(*own, "beyond_v1", "beyond_v2", *(angle_error(F.col("heading"), F.col(c)).alias(n) for n, c in (("error", "bearing"), ("error_v1", "__to_v2"), ("error_v2", "__to_v1"))))
    if index is None:
        return near.withColumn("in_leaf", F.lit(True))
    listed = index[1].select("node", "edge_id", F.lit(True).alias("in_leaf"))
    return near.join(F.broadcast(listed) if areas.small else listed, ["node", "edge_id"], "left").withColumn("in_leaf", F.coalesce("in_leaf", F.lit(False))).drop("node")


_ENDS = ["v1_lat", "v1_lon", "v2_lat", "v2_lon"]


def map_candidates(points: DataFrame, areas: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """trip_id, idx, edge_id, error (between heading and edge), error_v1 and error_v2 (between heading and the way to the far end, coming from v1 or v2), in_leaf: the edges whose area contains a point.

    in_leaf tells whether the index finds the edge at the point: whether the
    leaf that has it, of leaves that share a border the one searched first,
    lists the edge.  Without an index every edge is found.
    """
    alone = points.withColumns({"next_lat": F.lit(None).cast("double"), "next_lon": F.lit(None).cast("double")})
    found = _candidates(alone, deal_areas(areas, ["edge_id", "bearing", *_ENDS]), index, [])
    return found.select("trip_id", "idx", "edge_id", "error", "error_v1", "error_v2", "in_leaf")


FITTED = "edge_id long, edge_explicit boolean, edge_way_type int, v1_id long, v1_lat double, v1_lon double, v2_id long, v2_lat double, v2_lon double"
_EDGE = ["v1_id", "v1_lat", "v1_lon", "v2_id", "v2_lat", "v2_lon", "way_type"]


def choose_edges(spans: list[tuple[int, int]], near: dict[str, list]) -> list[int]:
    """For each point of a trip, in order, the place in ``near`` of the edge that it is fit to; -1 for none.

    spans tell which places of near are a point's candidates.  An edge is kept
    while its area contains the points.  When one leaves it over an end (which
    the last point in it knows: beyond_v1, beyond_v2), edges at that end are
    tried first, by the error of the way to their far end; else, and failing
    that, those that the index finds, by the error of their bearing.  Equal
    errors go to the smaller edge_id.
    """
    ids, in_leaf, v1, v2, beyond_v1, beyond_v2 = (near[c] for c in ("edge_id", "in_leaf", "v1_id", "v2_id", "beyond_v1", "beyond_v2"))
    error, error_v1, error_v2 = (near[c] for c in ("error", "error_v1", "error_v2"))
    out, current = [], -1
    for a, b in spans:
        stays = next((k for k in range(a, b) if ids[k] == ids[current]), -1) if current >= 0 else -1
        if stays < 0:
            least = None
            if current >= 0:
                vertex = v2[current] if beyond_v2[current] else v1[current] if beyond_v1[current] else None
                for k in range(a, b) if vertex is not None else ():
                    if vertex in (v1[k], v2[k]):
                        own = error_v2[k] if v2[k] == vertex else error_v1[k]
                        if least is None or own < least:
                            stays, least = k, own
            if stays < 0:
                for k in range(a, b):
                    if in_leaf[k] and (least is None or error[k] < least):
                        stays, least = k, error[k]
        current = stays
        out.append(current)
    return out


def infer_edges(explicit: np.ndarray, sectors: np.ndarray, min_points: int) -> np.ndarray:
    """For each point of a trip that fits no road the number of its inferred segment, -1 for the others.

    A segment takes points until the heading's sector is another one than at
    its start and it has more than min_points; a road ends it as well.
    """
    out, number, sector, count = np.full(len(explicit), -1, np.int64), -1, None, 0
    for i, (fits, own) in enumerate(zip(explicit.tolist(), sectors.tolist())):
        if fits:
            count = 0
            continue
        if count == 0 or (own != sector and count > min_points):
            number, sector, count = number + 1, own, 0
        out[i] = number
        count += 1
    return out


def fit_trips(points: DataFrame, edges: DataFrame | None, index: tuple[DataFrame, DataFrame] | None = None, scale: float = 1.0, extension: float = 5.0, heading_groups: int = 36, min_edge_points: int = 50) -> DataFrame:
    """points with the edge each is fit to: edge_id, edge_explicit, edge_way_type and both ends.

    Candidates come from native joins; one fold over a trip's points and
    candidates makes both the sticky choice among roads and the inferred
    segments for the rest.  A segment's ends are the points at which it started
    and ended, for all of its points.  Its id counts from 0 in a trip, so edges
    are told apart by (edge_explicit, edge_id).
    """
    columns = points.columns
    rows = points.select("trip_id", "idx", *(c for c in columns if c not in ("trip_id", "idx")), heading_sector(F.col("heading"), heading_groups).alias("__sector"), F.lit(None).cast("long").alias("__edge_id"))
    carried: list[str] = []
    if edges is not None:
        areas = kept(edges, ("areas", scale, extension), lambda: deal_areas(edge_areas(edges, scale, extension), ["edge_id", "bearing", *_EDGE]))
        carried = [] if areas.small else [c for c in _EDGE if c not in ("v1_id", "v2_id")]  # a large map's edges come along, a small one's join afterwards
        trip = Window.partitionBy("trip_id").orderBy("idx")
        onward = points.select("trip_id", "idx", "lat", "lon", "heading", F.lead("lat").over(trip).alias("next_lat"), F.lead("lon").over(trip).alias("next_lon"))
        near = _candidates(onward, areas, index, ["v1_id", "v2_id", *carried])
        rows = rows.unionByName(near.select("trip_id", "idx", *(F.col(c).alias(f"__{c}") for c in near.columns if c not in ("trip_id", "idx"))), allowMissingColumns=True)
    later = [] if edges is None or carried else ["way_type", *_ENDS]  # joined after the fold
    fitted = [f for f in _parse_datatype_string(FITTED).fields]
    schema = StructType([*points.schema.fields, *fitted])
    shipped = [c for c in _EDGE if c not in later]

    def fold(trip: pa.Table) -> pa.Table:
        at = trip.column("__edge_id").is_valid().to_numpy()
        near = trip.filter(pa.array(at)) if at.any() else None
        trip = trip.filter(pa.array(~at)) if at.any() else trip
        if not trip.num_rows:
            return trip.select([]).slice(0, 0)
        lats, lons = trip.column("lat").to_numpy(), trip.column("lon").to_numpy()
        chosen = np.full(trip.num_rows, -1)
        if near is not None:
            idx, own = near.column("idx").to_numpy(), trip.column("idx").to_numpy()
            spans = list(zip(np.searchsorted(idx, own).tolist(), np.searchsorted(idx, own, side="right").tolist()))
            lists = {c: near.column(f"__{c}").to_pylist() for c in ("edge_id", "in_leaf", "v1_id", "v2_id", "error", "error_v1", "error_v2", "beyond_v1", "beyond_v2")}
            chosen = np.array(choose_edges(spans, lists))
        explicit = chosen >= 0
        segment = infer_edges(explicit, trip.column("__sector").to_numpy(), min_edge_points)
        ends_at = inferred_ends(segment, explicit)
        start, stop = (np.array([ends_at[s][k] if s >= 0 else 0 for s in segment.tolist()], np.int64) for k in (0, 1))
        road = {c: near.column(f"__{c}").take(pa.array(np.maximum(chosen, 0))) if near is not None else pa.nulls(len(chosen)) for c in ("edge_id", *shipped)}
        inferred = {"edge_id": pa.array(segment), "v1_lat": pa.array(lats[start]), "v1_lon": pa.array(lons[start]), "v2_lat": pa.array(lats[stop]), "v2_lon": pa.array(lons[stop])}
        is_road = pa.array(explicit)
        made = {c: pc.if_else(is_road, road[c] if c in road else pa.nulls(len(chosen)), inferred.get(c, pa.scalar(None))) if c in road or c in inferred else pa.nulls(len(chosen)) for c in ("edge_id", *_EDGE)}
        out = trip.select(columns)
        for name, values in (("edge_id", made["edge_id"]), ("edge_explicit", is_road), ("edge_way_type", made["way_type"]), *((c, made[c]) for c in _EDGE[:-1])):
            out = out.append_column(name, values)
        return out

    found = fold_trips(rows, ["idx", *(["__edge_id"] if edges is not None else [])], fold, schema)
    if not later:
        return found
    table = F.broadcast(edges.select(F.col("edge_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in later)))
    found = found.join(table, F.col("edge_explicit") & (F.col("edge_id") == F.col("__id")), "left")
    filled = {"edge_way_type": F.col("__way_type"), **{c: F.coalesce(c, f"__{c}") for c in _ENDS}}
    return found.withColumns(filled).select(*columns, *(f.name for f in fitted))


def inferred_ends(segment: np.ndarray, explicit: np.ndarray) -> dict[int, tuple[int, int]]:
    """First and last point of each inferred segment; one that gives way to the next ends at the next one's first point."""
    out: dict[int, tuple[int, int]] = {}
    for i, s in enumerate(segment.tolist()):
        if s < 0:
            continue
        if s not in out:
            out[s] = (i, i)
            if i and segment[i - 1] == s - 1 and not explicit[i - 1]:
                out[s - 1] = (out[s - 1][0], i)
        else:
            out[s] = (out[s][0], i)
    return out


def count_choices(fitted: DataFrame, vertices: DataFrame) -> DataFrame:
    """fitted with out_degree: the choices met so far at intersections that the trip went through, cumulative.

    Whenever the road changes, gaps between roads apart, and old and new road
    share a vertex, and it isn't the one counted last, its choices are added.
    """
    trip = Window.partitionBy("trip_id").orderBy("idx")
    roads = fitted.filter("edge_explicit").select("trip_id", "idx", "edge_id", "v1_id", "v2_id")
    for c in ("edge_id", "v1_id", "v2_id"):
        roads = roads.withColumn(f"old_{c}", F.lag(c).over(trip))
    shares = lambda v: (F.col(v) == F.col("v1_id")) | (F.col(v) == F.col("v2_id"))
    shared = F.when(F.col("old_edge_id") != F.col("edge_id"), F.when(shares("old_v1_id"), F.col("old_v1_id")).when(shares("old_v2_id"), F.col("old_v2_id")))
    roads = roads.withColumn("shared", shared)
    counted = F.last("shared", ignorenulls=True).over(trip.rowsBetween(Window.unboundedPreceding, -1))
    roads = roads.withColumn("fresh", F.when(F.col("shared").isNotNull() & ~F.col("shared").eqNullSafe(counted), F.col("shared"))).filter("fresh is not null")
    met = roads.join(vertices.select(F.col("vertex_id").alias("fresh"), F.col("out_degree").alias("choices")), "fresh").select("trip_id", "idx", "choices")
    rows = fitted.join(met, ["trip_id", "idx"], "left")
    total = F.sum(F.coalesce("choices", F.lit(0))).over(trip.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("out_degree", total.cast("long")).drop("choices")


def edge_length(prefix: str = ""):
    """Length of the edge in a row."""
    return distance(*ends(prefix))
