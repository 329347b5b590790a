"""One query for each operator over inputs derived from the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo
from .functions import text as txt
from .functions.geo import LatLon
from .operators import clean, detect, fit, intervals, privacy, roads
from .plans import demo, pipeline
from .plans.config import INTERACTIVE, DIConfig
from .session import checkpointed
from .sinks import csv as csv_sink
from .sinks import kml as kml_sink
from .sinks import shapes as shape_sink
from .sources import osm, shapes, trips
from .streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
R = geo.EARTH_RADIUS_M


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return keep


# SQL of the formulas


def _sql_distance(a, b, c, d) -> str:
    return f"(sqrt(pow((radians({d}) - radians({b})) * cos((radians({a}) + radians({c})) / 2.0), 2) + pow(radians({c}) - radians({a}), 2)) * {R})"


def _sql_project(lat, lon, course, metres) -> tuple[str, str]:
    to = f"asin(sin(radians({lat})) * cos(({metres}) / {R}) + cos(radians({lat})) * sin(({metres}) / {R}) * cos(radians({course})))"
    on = f"(radians({lon}) + atan2(sin(radians({course})) * sin(({metres}) / {R}) * cos(radians({lat})), cos(({metres}) / {R}) - sin(radians({lat})) * sin({to})))"
    return f"degrees({to})", f"((degrees({on}) + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0)"


def _sql_bearing(a, b, c, d) -> str:
    return f"((degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) + 360.0::DOUBLE) % 360.0::DOUBLE)"


def _sql_diff(a, b) -> str:
    return f"(CASE WHEN ({a}) - ({b}) > 180.0 THEN abs(({a}) - ({b}) - 360.0) WHEN ({a}) - ({b}) < -180.0 THEN ({a}) - ({b}) + 360.0 ELSE abs(({a}) - ({b})) END)"


def _sql_angle_error(a, b) -> str:
    return f"least({_sql_diff(a, b)}, {_sql_diff(a, f'(({b}) + 180.0::DOUBLE) % 360.0::DOUBLE')})"


def _sql_cross(a1, a2, b1, b2) -> str:
    """Of segments whose ends are pairs of SQL expressions."""
    al, ao, bl, bo = f"({a2[0]} - {a1[0]})", f"({a2[1]} - {a1[1]})", f"({b2[0]} - {b1[0]})", f"({b2[1]} - {b1[1]})"
    d, xl, xo = f"({al} * {bo} - {bl} * {ao})", f"({a1[0]} - {b1[0]})", f"({a1[1]} - {b1[1]})"
    s, t = f"(({al} * {xo} - {ao} * {xl}) / {d})", f"(({bl} * {xo} - {bo} * {xl}) / {d})"
    return f"(CASE WHEN abs({d}) < {geo.GPS_EPSILON!r} THEN false ELSE {s} >= 0.0 AND {s} <= 1.0 AND {t} >= 0.0 AND {t} <= 1.0 END)"


PAIRS = "pairs AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(heading) OVER w AS heading2 FROM trips WINDOW w AS (PARTITION BY trip_id ORDER BY idx) QUALIFY lead(lat) OVER w IS NOT NULL)"
_PAIR = f"WITH {demo.trips_sql()}, {PAIRS} SELECT trip_id, idx, "


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the next one of its trip."""
    after = Window.partitionBy("trip_id").orderBy("idx")
    rows = demo.trips(spark, sf_dir)
    return rows.withColumns({f"{c}2": F.lead(c).over(after) for c in ("lat", "lon", "heading")}).filter("lat2 is not null")


def _ends() -> tuple[LatLon, LatLon]:
    return geo.point("lat", "lon"), geo.point("lat2", "lon2")


def _rounded(df: DataFrame, keys: list[str], digits: int = 6, **values) -> DataFrame:
    return df.select(*keys, *(F.round(v, digits).alias(k) for k, v in values.items()))


KEYS = ["trip_id", "idx"]


@register("geo_distance", _PAIR + f"round({_sql_distance('lat', 'lon', 'lat2', 'lon2')}, 6) AS metres FROM pairs")
def geo_distance(spark, sf_dir):
    return _rounded(pairs(spark, sf_dir), KEYS, metres=geo.distance(*_ends()))


@register("geo_haversine", _PAIR + f"round(2.0 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2.0), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2.0), 2))) * {R}, 5) AS metres FROM pairs")
def geo_haversine(spark, sf_dir):
    return _rounded(pairs(spark, sf_dir), KEYS, 5, metres=geo.haversine(*_ends()))


_P = _sql_project("lat", "lon", "heading", "speed * 10.0::DOUBLE")


@register("geo_project", f"WITH {demo.trips_sql()} SELECT trip_id, idx, round({_P[0]}, 8) AS to_lat, round({_P[1]}, 8) AS to_lon FROM trips")
def geo_project(spark, sf_dir):
    to = geo.project(geo.point("lat", "lon"), F.col("heading"), F.col("speed") * 10.0)
    return _rounded(demo.trips(spark, sf_dir), KEYS, 8, to_lat=to.lat, to_lon=to.lon)


@register("geo_midpoint", _PAIR + """round(degrees(atan2(sin(radians(lat)) + sin(radians(lat2)), sqrt(pow(cos(radians(lat)) + cos(radians(lat2)) * cos(radians(lon2) - radians(lon)), 2) + pow(cos(radians(lat2)) * sin(radians(lon2) - radians(lon)), 2)))), 8) AS mid_lat,
    round((degrees(radians(lon) + atan2(cos(radians(lat2)) * sin(radians(lon2) - radians(lon)), cos(radians(lat)) + cos(radians(lat2)) * cos(radians(lon2) - radians(lon)))) + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0, 8) AS mid_lon FROM pairs""")
def geo_midpoint(spark, sf_dir):
    mid = geo.midpoint(*_ends())
    return _rounded(pairs(spark, sf_dir), KEYS, 8, mid_lat=mid.lat, mid_lon=mid.lon)


@register("geo_bearing", _PAIR + f"round({_sql_bearing('lat', 'lon', 'lat2', 'lon2')}, 5) AS bearing FROM pairs")
def geo_bearing(spark, sf_dir):
    return _rounded(pairs(spark, sf_dir), KEYS, 5, bearing=geo.bearing(*_ends()))


@register("edge_length", f"""WITH {demo.roads_sql()} SELECT edge_id, round({_sql_distance('v1_lat', 'v1_lon', 'v2_lat', 'v2_lon')}, 6) AS metres,
    round(2.0 * asin(sqrt(pow(sin(radians(v2_lat - v1_lat) / 2.0), 2) + cos(radians(v1_lat)) * cos(radians(v2_lat)) * pow(sin(radians(v2_lon - v1_lon) / 2.0), 2))) * {R}, 5) AS haversine, round(v2_lat - v1_lat, 9) AS dlat, round(v2_lon - v1_lon, 9) AS dlon FROM roads""")
def edge_length(spark, sf_dir):
    v1, v2 = roads.ends()
    e = demo.roads(spark, sf_dir)
    return e.select("edge_id", F.round(geo.distance(v1, v2), 6).alias("metres"), F.round(geo.haversine(v1, v2), 5).alias("haversine"), F.round(v2.lat - v1.lat, 9).alias("dlat"), F.round(v2.lon - v1.lon, 9).alias("dlon"))


def _beside(spark, sf_dir) -> DataFrame:
    """Each point with the edge of the lattice that starts at its block."""
    k, j = F.col("trip_id").cast("bigint") % 100, F.floor((F.col("lon") + F.lit(83.9005)) / F.lit(0.001)).cast("bigint")
    points = demo.trips(spark, sf_dir).withColumn("edge_id", k * 1000 + j * 2 + 1)
    return points.join(demo.roads(spark, sf_dir), "edge_id")


BESIDE = f"beside AS (SELECT t.*, e.* FROM (SELECT *, (trip_id::BIGINT % 100) * 1000 + floor((lon + 83.9005::DOUBLE) / 0.001::DOUBLE)::BIGINT * 2 + 1 AS eid FROM trips) t JOIN roads e ON e.edge_id = t.eid)"
_BESIDE = f"WITH {demo.trips_sql()}, {demo.roads_sql()}, {BESIDE} "


@register("point_edge_distance", _BESIDE + f""", t AS (SELECT *, ((lat - v1_lat) * (v2_lat - v1_lat) + (lon - v1_lon) * (v2_lon - v1_lon)) / ((v2_lat - v1_lat) * (v2_lat - v1_lat) + (v2_lon - v1_lon) * (v2_lon - v1_lon)) AS t FROM beside)
    SELECT trip_id, idx, edge_id, round(CASE WHEN t <= 0.0 THEN {_sql_distance('lat', 'lon', 'v1_lat', 'v1_lon')} WHEN t >= 1.0 THEN {_sql_distance('lat', 'lon', 'v2_lat', 'v2_lon')}
    ELSE {_sql_distance('(v1_lat + t * (v2_lat - v1_lat))', '(v1_lon + t * (v2_lon - v1_lon))', 'lat', 'lon')} END, 6) AS metres FROM t""")
def point_edge_distance(spark, sf_dir):
    return _rounded(_beside(spark, sf_dir), [*KEYS, "edge_id"], metres=geo.point_edge_distance(geo.point("lat", "lon"), *roads.ends()))


@register("segment_intersects", f"WITH {demo.trips_sql()}, {demo.roads_sql()}, {PAIRS}, b AS (SELECT p.*, e.* FROM (SELECT *, (trip_id::BIGINT % 100) * 1000 + floor((lon + 83.9005::DOUBLE) / 0.001::DOUBLE)::BIGINT * 2 + 1 AS eid FROM pairs) p JOIN roads e ON e.edge_id = p.eid) SELECT trip_id, idx, edge_id, {_sql_cross(('v1_lat', 'v1_lon'), ('v2_lat', 'v2_lon'), ('lat', 'lon'), ('lat2', 'lon2'))} AS crosses FROM b")
def segment_intersects(spark, sf_dir):
    k, j = F.col("trip_id").cast("bigint") % 100, F.floor((F.col("lon") + F.lit(83.9005)) / F.lit(0.001)).cast("bigint")
    rows = pairs(spark, sf_dir).withColumn("edge_id", k * 1000 + j * 2 + 1).join(demo.roads(spark, sf_dir), "edge_id")
    return rows.select(*KEYS, "edge_id", geo.segments_cross(*roads.ends(), *_ends()).alias("crosses"))


def _areas_sql(extension: float) -> str:
    """roads with the corners c0 to c3 of the area of each."""
    a, b = _sql_project("v1_lat", "v1_lon", "(course - 180.0::DOUBLE) % 360.0::DOUBLE", f"{extension}::DOUBLE"), _sql_project("v2_lat", "v2_lon", "course", f"{extension}::DOUBLE")
    long = f"SELECT *, {a[0]} AS a_lat, {a[1]} AS a_lon, {b[0]} AS b_lat, {b[1]} AS b_lon FROM" if extension > 0 else "SELECT *, v1_lat AS a_lat, v1_lon AS a_lon, v2_lat AS b_lat, v2_lon AS b_lon FROM"
    sides = [("a", "- 90.0"), ("b", "- 90.0"), ("b", "+ 90.0"), ("a", "+ 90.0")]
    corner = lambda i, v, turn: ", ".join(f"{x} AS c{i}_{n}" for n, x in zip(("lat", "lon"), _sql_project(f"{v}_lat", f"{v}_lon", f"(course {turn}::DOUBLE) % 360.0::DOUBLE", "width / 2.0")))
    return f"areas AS (SELECT *, {', '.join(corner(i, v, turn) for i, (v, turn) in enumerate(sides))} FROM ({long} (SELECT *, {_sql_bearing('v1_lat', 'v1_lon', 'v2_lat', 'v2_lon')} AS course FROM roads)))"


def _inside_sql(lat: str = "lat", lon: str = "lon") -> str:
    side = lambda a, b: f"((c{a}_lat * (c{b}_lon - c{a}_lon) - c{a}_lon * (c{b}_lat - c{a}_lat)) - {lat} * (c{b}_lon - c{a}_lon) + {lon} * (c{b}_lat - c{a}_lat) < 0.0)"
    return "NOT (" + " OR ".join(side(i, (i + 1) % 4) for i in range(4)) + ")"


@register("edge_area", f"WITH {demo.roads_sql()}, {_areas_sql(5.0)} SELECT edge_id, " + ", ".join(f"round({c}, 8) AS {c}" for c in fit.CORNERS) + " FROM areas")
def edge_area(spark, sf_dir):
    return fit.edge_areas(demo.roads(spark, sf_dir), 1.0, 5.0).select("edge_id", *(F.round(c, 8).alias(c) for c in fit.CORNERS))


@register("area_contains", f"WITH {demo.trips_sql()}, {demo.roads_sql()}, {_areas_sql(0.0)}, b AS (SELECT t.*, e.* FROM (SELECT *, (trip_id::BIGINT % 100) * 1000 + floor((lon + 83.9005::DOUBLE) / 0.001::DOUBLE)::BIGINT * 2 + 1 AS eid FROM trips) t JOIN areas e ON e.edge_id = t.eid) SELECT trip_id, idx, edge_id, {_inside_sql()} AS inside FROM b")
def area_contains(spark, sf_dir):
    areas = fit.edge_areas(demo.roads(spark, sf_dir), 1.0, 0.0)
    beside = _beside(spark, sf_dir).select(*KEYS, "edge_id", "lat", "lon").join(areas.select("edge_id", *fit.CORNERS), "edge_id")
    return beside.select(*KEYS, "edge_id", geo.area_contains(fit.corners_of(), geo.point("lat", "lon")).alias("inside"))


@register("circle_contains", f"WITH {demo.trips_sql()} SELECT trip_id, idx, {_sql_distance('42.3::DOUBLE', '-83.875::DOUBLE', 'lat', 'lon')} <= 5000.5 AS inside FROM trips")
def circle_contains(spark, sf_dir):
    center = LatLon(F.lit(42.3), F.lit(-83.875))
    return demo.trips(spark, sf_dir).select(*KEYS, geo.circle_contains(center, F.lit(5000.5), geo.point("lat", "lon")).alias("inside"))


@register("bounds_filter", f"WITH {demo.trips_sql()} SELECT trip_id, idx, round(lat, 8) AS lat, round(lon, 8) AS lon FROM trips WHERE lat BETWEEN 42.25 AND 42.35 AND lon BETWEEN -83.89 AND -83.86")
def bounds_filter(spark, sf_dir):
    box = geo.bounds(42.25, -83.89, 42.35, -83.86)
    return demo.trips(spark, sf_dir).filter(geo.in_bounds(box, geo.point("lat", "lon"))).select(*KEYS, F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


_B = ("42.3005::DOUBLE", "-83.8803::DOUBLE", "42.3087::DOUBLE", "-83.8711::DOUBLE")
_BC = [(_B[0], _B[1]), (_B[2], _B[1]), (_B[2], _B[3]), (_B[0], _B[3])]
_inb = lambda la, lo: f"({la} BETWEEN {_B[0]} AND {_B[2]} AND {lo} BETWEEN {_B[1]} AND {_B[3]})"
_crossb = lambda a, b: "(" + " OR ".join(_sql_cross(a, b, _BC[i], _BC[(i + 1) % 4]) for i in range(4)) + ")"


@register("bounds_edges", f"WITH {demo.roads_sql()} SELECT edge_id, {_inb('v1_lat', 'v1_lon')} AND {_inb('v2_lat', 'v2_lon')} AS contained, {_crossb(('v1_lat', 'v1_lon'), ('v2_lat', 'v2_lon'))} AS crossed, {_inb('v1_lat', 'v1_lon')} OR {_inb('v2_lat', 'v2_lon')} OR {_crossb(('v1_lat', 'v1_lon'), ('v2_lat', 'v2_lon'))} AS touched FROM roads")
def bounds_edges(spark, sf_dir):
    box, (v1, v2) = geo.bounds(42.3005, -83.8803, 42.3087, -83.8711), roads.ends()
    return demo.roads(spark, sf_dir).select("edge_id", geo.bounds_contains_edge(box, v1, v2).alias("contained"), geo.bounds_cross_edge(box, v1, v2).alias("crossed"), geo.edge_touches(box, v1, v2).alias("touched"))


_CARD = [_sql_project("v1_lat", "v1_lon", f"{c}::DOUBLE", "60.5::DOUBLE") for c in (0.0, 90.0, 180.0, 270.0)]
_CC = [("n_lat", "n_lon"), ("e_lat", "e_lon"), ("s_lat", "s_lon"), ("w_lat", "w_lon")]


@register("bounds_circles", f"WITH {demo.roads_sql()}, c AS (SELECT *, " + ", ".join(f"{p[0]} AS {n[0]}, {p[1]} AS {n[1]}" for p, n in zip(_CARD, _CC)) + " FROM roads) SELECT edge_id, " + " AND ".join(_inb(*c) for c in _CC) + " AS contained, (" + " OR ".join(_crossb(_CC[i], _CC[(i + 1) % 4]) for i in range(4)) + ") AS crossed, (" + " OR ".join([_inb("v1_lat", "v1_lon"), *(_inb(*c) for c in _CC), *(f"{_sql_distance('v1_lat', 'v1_lon', *c)} <= 60.5" for c in _BC)]) + ") AS touched FROM c")
def bounds_circles(spark, sf_dir):
    """Circles of 60.5 m around the first vertex of each edge against a box."""
    box, center, r = geo.bounds(42.3005, -83.8803, 42.3087, -83.8711), roads.ends()[0], F.lit(60.5)
    return demo.roads(spark, sf_dir).select("edge_id", geo.bounds_contains_circle(box, center, r).alias("contained"), geo.bounds_cross_circle(box, center, r).alias("crossed"), geo.circle_touches(center, r, box).alias("touched"))


_AC = [(f"c{i}_lat", f"c{i}_lon") for i in range(4)]


@register("area_touches", f"WITH {demo.roads_sql()}, {_areas_sql(0.0)} SELECT edge_id, (" + " OR ".join([*(_inb(*c) for c in _AC), *(f"({_inside_sql(*c)})" for c in _BC), *(_crossb(_AC[i], _AC[(i + 1) % 4]) for i in range(4))]) + ") AS touched FROM areas")
def area_touches(spark, sf_dir):
    box = geo.bounds(42.3005, -83.8803, 42.3087, -83.8711)
    return fit.edge_areas(demo.roads(spark, sf_dir), 1.0, 0.0).select("edge_id", geo.area_touches(fit.corners_of(), box).alias("touched"))


@register("bounds_metrics", f"WITH {demo.trips_sql()}, b AS (SELECT trip_id, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM trips GROUP BY trip_id) SELECT trip_id, round(n - s, 9) AS height, round(e - w, 9) AS width, round(s + (n - s) / 2.0, 9) AS center_lat, round(w + (e - w) / 2.0, 9) AS center_lon, round(n, 9) AS north_lat, round(e, 9) AS east_lon FROM b")
def bounds_metrics(spark, sf_dir):
    rows = demo.trips(spark, sf_dir).groupBy("trip_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    box = geo.bounds("s", "w", "n", "e")
    return _rounded(rows, ["trip_id"], 9, height=box.height, width=box.width, center_lat=box.center.lat, center_lon=box.center.lon, north_lat=box.north.lat, east_lon=box.east.lon)


_GS, _GE = _sql_project("lat", "lon", "180.0::DOUBLE", "1000.0::DOUBLE"), _sql_project("lat", "lon", "90.0::DOUBLE", "1000.0::DOUBLE")


@register("grid_tiles", f"""WITH RECURSIVE {demo.trips_sql()}, box AS (SELECT min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM trips),
    r AS (SELECT 0::BIGINT AS "row", n AS lat, w AS lon, s, e FROM box UNION ALL SELECT "row" + 1, {_GS[0]}, lon, s, e FROM r WHERE {_GS[0]} > s),
    g AS (SELECT "row", 0::BIGINT AS col, lat, lon, e FROM r UNION ALL SELECT "row", col + 1, lat, {_GE[1]}, e FROM g WHERE {_GE[1]} < e)
    SELECT "row", col, round({_GS[0]}, 8) AS sw_lat, round(lon, 8) AS sw_lon, round(lat, 8) AS ne_lat, round({_GE[1]}, 8) AS ne_lon FROM g""")
def grid_tiles(spark, sf_dir):
    """Tiles over the box of all trips."""
    box = demo.trips(spark, sf_dir).agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    rows = geo.grid_tiles(box[2], box[1], 1000.0, box[0], box[3])
    df = spark.createDataFrame(rows, "row long, col long, sw_lat double, sw_lon double, ne_lat double, ne_lon double")
    return df.select("row", "col", *(F.round(c, 8).alias(c) for c in ("sw_lat", "sw_lon", "ne_lat", "ne_lon")))


@register("grid_touches", f"WITH {demo.trips_sql()}, b AS (SELECT trip_id, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM trips GROUP BY trip_id) SELECT trip_id, (" + " OR ".join([*(_inb(*c) for c in (("s", "w"), ("n", "w"), ("n", "e"), ("s", "e"))), *(f"({c[0]} BETWEEN s AND n AND {c[1]} BETWEEN w AND e)" for c in _BC)]) + ") AS touched FROM b")
def grid_touches(spark, sf_dir):
    rows = demo.trips(spark, sf_dir).groupBy("trip_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    return rows.select("trip_id", geo.bounds_touch(geo.bounds("s", "w", "n", "e"), geo.bounds(42.3005, -83.8803, 42.3087, -83.8711)).alias("touched"))


@register("heading_delta", _PAIR + f"round(CASE WHEN abs(heading - heading2) < 180.0 THEN abs(heading - heading2) ELSE 360.0 - abs(heading - heading2) END, 6) AS delta, round({_sql_diff('heading', 'heading2')}, 6) AS diff FROM pairs")
def heading_delta(spark, sf_dir):
    a, b = F.col("heading"), F.col("heading2")
    return _rounded(pairs(spark, sf_dir), KEYS, delta=geo.heading_delta(a, b), diff=geo.diff_180(a, b))


@register("angle_error", _PAIR + f"round({_sql_angle_error('heading', 'heading2')}, 6) AS error, {_sql_angle_error('heading', 'heading2')} < 15.0 AS consistent FROM pairs")
def angle_error(spark, sf_dir):
    a, b = F.col("heading"), F.col("heading2")
    return pairs(spark, sf_dir).select(*KEYS, F.round(geo.angle_error(a, b), 6).alias("error"), geo.consistent_with(a, b).alias("consistent"))


@register("edge_equals", f"WITH {demo.roads_sql()} SELECT a.edge_id, count(*) AS equal FROM roads a JOIN roads b ON (a.v1_id = b.v1_id AND a.v2_id = b.v2_id) OR (a.v1_id = b.v2_id AND a.v2_id = b.v1_id) GROUP BY a.edge_id")
def edge_equals(spark, sf_dir):
    """Each edge against those that meet it, and itself turned around."""
    e = demo.roads(spark, sf_dir)
    turned = e.select(F.col("edge_id").alias("other"), *(F.col(f"v{3 - n}_{c}").alias(f"o_v{n}_{c}") for n in (1, 2) for c in ("id", "lat", "lon")))
    met = e.join(turned, F.col("v1_id") == F.col("o_v2_id"))
    return met.filter(geo.same_edge(*roads.ends(), *roads.ends("o_"))).groupBy("edge_id").agg(F.count(F.lit(1)).alias("equal"))


@register("vertex_outdegree", f"WITH {demo.roads_sql()} SELECT vertex_id, count(*) AS degree, CASE WHEN count(*) > 2 THEN count(*) - 1 ELSE 0 END AS out_degree FROM (SELECT v1_id AS vertex_id FROM roads UNION ALL SELECT v2_id FROM roads) GROUP BY vertex_id")
def vertex_outdegree(spark, sf_dir):
    return roads.vertices(demo.roads(spark, sf_dir))


@register("heading_sector", f"WITH {demo.trips_sql()} SELECT trip_id, idx, floor(heading / (360.0::DOUBLE / 36.0::DOUBLE))::BIGINT % 36 AS sector FROM trips")
def heading_sector(spark, sf_dir):
    return demo.trips(spark, sf_dir).select(*KEYS, geo.heading_sector(F.col("heading"), 36).alias("sector"))


@register("speed_color", f"WITH {demo.trips_sql()} SELECT trip_id, idx, ({geo.SPEED_COLORS}::BIGINT[])[(least(trunc(speed / 36.0::DOUBLE * 32.0::DOUBLE), 31) + 1)::INT] AS color FROM trips")
def speed_color(spark, sf_dir):
    return demo.trips(spark, sf_dir).select(*KEYS, geo.speed_color(F.col("speed")).alias("color"))


@register("highway_dimension", f"WITH {demo.roads_sql()} SELECT t.*, count(edge_id) AS n_edges FROM (VALUES " + ", ".join(f"({i}::INT, '{n}', {roads.WIDTHS.get(n, roads.WIDTH)}::DOUBLE, {str(i in roads.EXCLUDED_WAYS).lower()})" for i, n in enumerate(roads.WAY_TYPES)) + ") t(way_type, name, width, excluded) LEFT JOIN roads r ON r.way_type = t.way_type GROUP BY ALL")
def highway_dimension(spark, sf_dir):
    """Each way type with how many roads are of it."""
    own = demo.roads(spark, sf_dir).groupBy("way_type").agg(F.count(F.lit(1)).alias("n"))
    return roads.highways(spark).join(own, "way_type", "left").select("way_type", "name", "width", "excluded", F.coalesce("n", F.lit(0)).alias("n_edges"))


@register("text_functions", """SELECT event_id, len(string_split(event_type || ';' || props, ';')) AS n_fields, trim(chr(9) || ' ' || event_type || ' ' || chr(10), ' ' || chr(9) || chr(10)) AS stripped,
    'k' || event_type AS attr_key, 'v=' || event_id::VARCHAR AS attr_value, event_id::VARCHAR || '.tar.gz' AS base, '/data/' || event_type AS folder, event_id::VARCHAR || '.tar' AS stem, event_id::DOUBLE + 0.5 AS number FROM events""")
def text_functions(spark, sf_dir):
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    key, value = txt.split_attribute(F.concat(F.lit("k"), kind, F.lit("=v="), e))
    path = F.concat(F.lit("/data/"), kind, F.lit("/"), e, F.lit(".tar.gz"))
    return demo.events(spark, sf_dir).select(
        "event_id", F.size(txt.split_fields(F.concat(kind, F.lit(";"), "props", F.lit(";")), ";")).cast("long").alias("n_fields"), txt.strip(F.concat(F.lit("\t "), kind, F.lit(" \n"))).alias("stripped"),
        key.alias("attr_key"), value.alias("attr_value"), txt.basename(path).alias("base"), txt.dirname(path).alias("folder"), txt.remove_extension(txt.basename(path)).alias("stem"), txt.number_prefix(F.concat(F.lit(" "), e, F.lit(".5m/s"))).alias("number"),
    )


# Sources


_PARSED = f"""WITH {demo.trip_lines_sql()}, s AS (SELECT *, CASE WHEN list_extract(string_split(line, ','), -1) = '' THEN string_split(line, ',')[:-2] ELSE string_split(line, ',') END AS p FROM lines),
    n AS (SELECT *, TRY_CAST(regexp_extract(p[8], '^ *([+-]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(p[9], '^ *([+-]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS lon, TRY_CAST(regexp_extract(p[12], '^([0-9]+)', 1) AS DOUBLE) AS heading, TRY_CAST(regexp_extract(p[11], '^([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS speed, TRY_CAST(p[4] AS BIGINT) AS time_us FROM s),
    o AS (SELECT *, CASE WHEN len(p) <> 19 THEN 'field' WHEN lat IS NULL THEN 'unparsable' WHEN lat > 80 OR lat < -84 THEN 'geo' WHEN lon IS NULL THEN 'unparsable' WHEN lon >= 180 OR lon <= -180 THEN 'geo' WHEN lat = 0 AND lon = 0 THEN 'geo'
          WHEN heading IS NULL THEN 'unparsable' WHEN heading > 360 OR heading < 0 THEN 'heading' WHEN speed IS NULL OR time_us IS NULL THEN 'unparsable' ELSE 'ok' END AS outcome FROM n)"""


@register("parse_validate", _PARSED + " SELECT event_id AS seq, outcome, lat, lon, heading, speed, time_us FROM o")
def parse_validate(spark, sf_dir):
    return trips.parse_records(demo.trip_lines(spark, sf_dir)).select("seq", "outcome", "lat", "lon", "heading", "speed", "time_us")


@register("trip_counters", _PARSED + " SELECT user_id::VARCHAR AS trip_id, count(*) AS n_points, count(*) FILTER (outcome = 'field') AS n_invalid_field, count(*) FILTER (outcome = 'geo') AS n_invalid_geo, count(*) FILTER (outcome = 'heading') AS n_invalid_heading FROM o GROUP BY user_id")
def trip_counters(spark, sf_dir):
    return trips.trip_counters(trips.parse_records(demo.trip_lines(spark, sf_dir)))


@register("number_points", _PARSED + " SELECT user_id::VARCHAR AS trip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, line AS raw, time_us, lat, lon, heading, speed FROM o WHERE outcome = 'ok'")
def number_points(spark, sf_dir):
    return trips.number_points(trips.parse_records(demo.trip_lines(spark, sf_dir)))


@register("split_trips", """WITH u AS (SELECT (event_id % 4)::VARCHAR AS file, event_id AS seq, ((event_id // 3) % 7)::VARCHAR AS uid FROM events), c AS (SELECT *, CASE WHEN lag(uid) OVER w IS NULL OR lag(uid) OVER w = uid THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY file ORDER BY seq))
    SELECT file, seq, uid, sum(new) OVER (PARTITION BY file ORDER BY seq)::BIGINT AS run FROM c""")
def split_trips(spark, sf_dir):
    return trips.split_trips(demo.trip_lines(spark, sf_dir)).select("file", "seq", "uid", "run")


def _shape_rows(spark, sf_dir) -> DataFrame:
    """Lines of a shape file for the lattice, and some that are wrong."""
    e = demo.roads(spark, sf_dir)
    good = shape_sink.shape_lines(e).filter("part = 2").select(F.lit("f").alias("file"), "seq", "line")
    wrong = good.filter("seq % 5 = 0").select("file", (F.col("seq") + 10_000_000).alias("seq"), F.when(F.col("seq") % 2 == 0, F.lit("edge,1")).otherwise(F.lit("edge,7,1;42;-83:1;42;-83")).alias("line"))
    return checkpointed(good.unionByName(wrong))  # lines are data: how they were made stays out of the reader's plan


@register("parse_shapes", f"WITH {demo.roads_sql()} SELECT edge_id, v1_id, round(v1_lat, 9) AS v1_lat, round(v1_lon, 9) AS v1_lon, v2_id, round(v2_lat, 9) AS v2_lat, round(v2_lon, 9) AS v2_lon, way_type::INT AS way_type, width FROM roads")
def parse_shapes(spark, sf_dir):
    found = shapes.parse_shapes(_shape_rows(spark, sf_dir)).edges
    return found.select("edge_id", "v1_id", F.round("v1_lat", 9).alias("v1_lat"), F.round("v1_lon", 9).alias("v1_lon"), "v2_id", F.round("v2_lat", 9).alias("v2_lat"), F.round("v2_lon", 9).alias("v2_lon"), "way_type", "width")


@register("bad_shapes", f"WITH {demo.roads_sql()} SELECT edge_id + 10000000 AS seq FROM roads WHERE edge_id % 5 = 0")
def bad_shapes(spark, sf_dir):
    return shapes.parse_shapes(_shape_rows(spark, sf_dir)).bad.select("seq")


@register("osm_nodes", f"WITH {demo.map_sql()} SELECT node_id, first_value(node_id) OVER (PARTITION BY lat, lon ORDER BY pos) AS unified_id FROM nodes")
def osm_nodes(spark, sf_dir):
    return osm.unify_nodes(demo.map_nodes(spark, sf_dir)).select("node_id", "unified_id")


_SEGMENTS = f"""WITH {demo.map_sql()}, u AS (SELECT *, first_value(node_id) OVER (PARTITION BY lat, lon ORDER BY pos) AS uid FROM nodes),
    p AS (SELECT r.*, uid, u.lat::DOUBLE AS la, u.lon::DOUBLE AS lo FROM refs r LEFT JOIN u ON u.node_id = r.ref),
    s AS (SELECT way_id, k, way_type, uid AS v1_id, la AS v1_lat, lo AS v1_lon, lead(uid) OVER w AS v2_id, lead(la) OVER w AS v2_lat, lead(lo) OVER w AS v2_lon FROM p WINDOW w AS (PARTITION BY way_id ORDER BY k)),
    seg AS (SELECT * FROM s WHERE v1_id IS NOT NULL AND v2_id IS NOT NULL AND v1_lat BETWEEN 42.22 AND 42.38 AND v1_lon BETWEEN -83.89 AND -83.86)"""


@register("osm_segments", _SEGMENTS + " SELECT * FROM seg")
def osm_segments(spark, sf_dir):
    return osm.way_segments(demo.map_ways(spark, sf_dir), demo.map_nodes(spark, sf_dir), geo.bounds(42.22, -83.89, 42.38, -83.86)).drop("pos")


@register("osm_dedup", _SEGMENTS + ", t AS (SELECT * FROM seg UNION ALL SELECT way_id + 1000, k, way_type, v2_id, v2_lat, v2_lon, v1_id, v1_lat, v1_lon FROM seg) SELECT way_id, k, way_type, v1_id, v2_id FROM t QUALIFY row_number() OVER (PARTITION BY least(v1_lon, v2_lon), greatest(v1_lon, v2_lon), v1_lat, v2_lat, way_type ORDER BY way_id, k) = 1")
def osm_dedup(spark, sf_dir):
    one = osm.way_segments(demo.map_ways(spark, sf_dir), demo.map_nodes(spark, sf_dir), geo.bounds(42.22, -83.89, 42.38, -83.86))
    turned = one.select((F.col("way_id") + 1000).alias("way_id"), "k", "way_type", *(F.col(f"v{3 - n}_{c}").alias(f"v{n}_{c}") for n in (1, 2) for c in ("id", "lat", "lon")), (F.col("pos") + 1000).alias("pos"))
    return osm.dedup_segments(one.unionByName(turned)).select("way_id", "k", "way_type", "v1_id", "v2_id")


@register("osm_lines", _SEGMENTS + """, o AS (SELECT *, row_number() OVER (ORDER BY way_id, k) AS seq FROM seg)
    SELECT seq, 'edge,' || seq || ',' || v1_id || ';' || v1_lat || ';' || v1_lon || ':' || v2_id || ';' || v2_lat || ';' || v2_lon || ',way_type=' || way_type || ':way_id=' || way_id AS line FROM o""")
def osm_lines(spark, sf_dir):
    """Segments as lines of a shape file, numbered in the order of the map."""
    return osm.shape_lines(osm.way_segments(demo.map_ways(spark, sf_dir), demo.map_nodes(spark, sf_dir), geo.bounds(42.22, -83.89, 42.38, -83.86)))


@register("osm_bounds", f"WITH {demo.map_sql()} SELECT min(lat::DOUBLE) AS sw_lat, min(lon::DOUBLE) AS sw_lon, max(lat::DOUBLE) AS ne_lat, max(lon::DOUBLE) AS ne_lon FROM nodes")
def osm_bounds(spark, sf_dir):
    return osm.osm_bounds(demo.map_nodes(spark, sf_dir))


# Trips


#: trips without errors, as cleaned.
CLEAN = f"""h AS (SELECT *, count(*) OVER t AS n, list_sort(list(lat) FILTER (idx < 50) OVER t)[26] AS ml, list_sort(list(lon) FILTER (idx < 50) OVER t)[26] AS mo FROM trips WINDOW t AS (PARTITION BY trip_id)),
    b AS (SELECT *, n > 25 AND {_sql_distance('lat', 'lon', 'ml', 'mo')} / (floor(least(n, 50) / 2) * 0.1::DOUBLE) > 44.7 AS bad FROM h),
    g AS (SELECT * FROM b QUALIFY NOT (bad AND coalesce(sum((NOT bad)::INT) OVER (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50)),
    k AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY trip_id) AS m FROM g),
    q AS (SELECT *, list_sort(list(lat) FILTER (pos >= m - 50) OVER t)[26] AS tl, list_sort(list(lon) FILTER (pos >= m - 50) OVER t)[26] AS tn FROM k WINDOW t AS (PARTITION BY trip_id)),
    cleaned AS (SELECT trip_id, raw, time_us, lat, lon, heading, speed, row_number() OVER (PARTITION BY trip_id ORDER BY pos) - 1 AS idx FROM q WHERE NOT (m > 50 AND pos >= m - 50 AND {_sql_distance('lat', 'lon', 'tl', 'tn')} / (25 * 0.1::DOUBLE) > 44.7))"""


@register("error_correct", f"WITH {demo.trips_sql(True)}, {CLEAN} SELECT trip_id, raw, idx FROM cleaned")
def error_correct(spark, sf_dir):
    return clean.correct_errors(demo.trips(spark, sf_dir, outliers=True)).select("trip_id", "raw", "idx")


@register("map_candidates", f"""WITH {demo.trips_sql()}, {demo.roads_sql()}, {_areas_sql(5.0)},
    x AS (SELECT *, least(c0_lat, c1_lat, c2_lat, c3_lat) AS lo_lat, greatest(c0_lat, c1_lat, c2_lat, c3_lat) AS hi_lat, least(c0_lon, c1_lon, c2_lon, c3_lon) AS lo_lon, greatest(c0_lon, c1_lon, c2_lon, c3_lon) AS hi_lon FROM areas)
    SELECT trip_id, idx, edge_id, round({_sql_angle_error('heading', 'course')}, 5) AS error FROM trips JOIN x ON lat >= lo_lat AND lat <= hi_lat AND lon >= lo_lon AND lon <= hi_lon WHERE {_inside_sql()}""")
def map_candidates(spark, sf_dir):
    found = fit.map_candidates(demo.trips(spark, sf_dir), fit.edge_areas(demo.roads(spark, sf_dir), 1.0, 5.0))
    return found.select(*KEYS, "edge_id", F.round("error", 5).alias("error"))


def _index(spark, sf_dir):
    return roads.kept_index(demo.roads(spark, sf_dir), *demo.BOX)


def _box_side(number: str) -> tuple[str, str]:
    """Whether the sides of a box allow a split: from south to north, from west to east."""
    return f"((n - s) / 2.0 >= {number})", f"((e - w) / 2.0 >= {number})"


_TALL, _WIDE = _box_side(f"{roads.LEAF_DEGREES}::DOUBLE")
_FUZZY = [("fs", "fw"), ("fn", "fw"), ("fn", "fe"), ("fs", "fe")]
_TOUCHES = " OR ".join([*(f"(v{k}_lat BETWEEN fs AND fn AND v{k}_lon BETWEEN fw AND fe)" for k in (1, 2)), *(_sql_cross(("v1_lat", "v1_lon"), ("v2_lat", "v2_lon"), _FUZZY[i], _FUZZY[(i + 1) % 4]) for i in range(4))])
#: All boxes that halving gives, the edges that touch each, and the tree that is made of full ones and their children.
TREE = f"""box AS (SELECT 'r' AS node, '' AS parent, 0 AS level, {demo.BOX[0][0]}::DOUBLE AS s, {demo.BOX[0][1]}::DOUBLE AS w, {demo.BOX[1][0]}::DOUBLE AS n, {demo.BOX[1][1]}::DOUBLE AS e
        UNION ALL SELECT node || '.' || k, node, level + 1,
            CASE WHEN tall AND (CASE WHEN wide THEN k < 2 ELSE k = 0 END) THEN clat ELSE s END, CASE WHEN wide AND k IN (1, 3) THEN clon ELSE w END,
            CASE WHEN tall AND (CASE WHEN wide THEN k > 1 ELSE k = 1 END) THEN clat ELSE n END, CASE WHEN wide AND k IN (0, 2) THEN clon ELSE e END
        FROM (SELECT *, {_TALL} AS tall, {_WIDE} AS wide, s + (n - s) / 2.0 AS clat, w + (e - w) / 2.0 AS clon FROM box), (VALUES (0), (1), (2), (3)) q(k) WHERE (tall AND wide) OR ((tall OR wide) AND k < 2)),
    held AS (SELECT node, parent, level, edge_id FROM (SELECT *, s - (n - s) / 10.0 AS fs, w - (e - w) / 10.0 AS fw, n + (n - s) / 10.0 AS fn, e + (e - w) / 10.0 AS fe FROM box) JOIN roads
             ON least(v1_lat, v2_lat) <= fn AND greatest(v1_lat, v2_lat) >= fs AND least(v1_lon, v2_lon) <= fe AND greatest(v1_lon, v2_lon) >= fw WHERE {_TOUCHES}),
    cnt AS (SELECT node, count(*) AS n_edges FROM held GROUP BY node),
    full_ AS (SELECT node FROM box JOIN cnt USING (node) WHERE n_edges > {roads.LEAF_EDGES} AND ({_TALL} OR {_WIDE})),
    nodes AS (SELECT box.*, coalesce(n_edges, 0) AS n_edges, node NOT IN (SELECT node FROM full_) AS is_leaf FROM box LEFT JOIN cnt USING (node) WHERE level = 0 OR parent IN (SELECT node FROM full_)),
    leaf_edges AS (SELECT node, edge_id FROM held JOIN nodes USING (node) WHERE is_leaf),
    lookup AS (SELECT trip_id, idx, min(node) AS node FROM trips JOIN nodes ON is_leaf AND lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY trip_id, idx)"""
_TREE = f"WITH RECURSIVE {demo.trips_sql()}, {demo.roads_sql()}, {TREE} "


@register("quad_nodes", _TREE + "SELECT node, round(s, 9) AS sw_lat, round(w, 9) AS sw_lon, round(n, 9) AS ne_lat, round(e, 9) AS ne_lon, level, is_leaf, n_edges FROM nodes")
def quad_nodes(spark, sf_dir):
    return _index(spark, sf_dir)[0].select("node", *(F.round(c, 9).alias(c) for c in ("sw_lat", "sw_lon", "ne_lat", "ne_lon")), "level", "is_leaf", "n_edges")


@register("quad_leaf_edges", _TREE + "SELECT node, edge_id FROM leaf_edges")
def quad_leaf_edges(spark, sf_dir):
    return _index(spark, sf_dir)[1]


@register("quad_leaf_lookup", _TREE + "SELECT trip_id, idx, node FROM trips LEFT JOIN lookup USING (trip_id, idx)")
def quad_leaf_lookup(spark, sf_dir):
    return roads.leaf_of(demo.trips(spark, sf_dir).select("trip_id", "idx", "lat", "lon"), _index(spark, sf_dir)[0], KEYS)


def _beyond_sql(side: int, lat: str, lon: str) -> str:
    a, b = side, (side + 1) % 4
    return f"((c{a}_lat * (c{b}_lon - c{a}_lon) - c{a}_lon * (c{b}_lat - c{a}_lat)) - {lat} * (c{b}_lon - c{a}_lon) + {lon} * (c{b}_lat - c{a}_lat) < 0.0)"


def _fit_sql(extension: float) -> str:
    """The edges at each point, and kept: the fold that keeps one while it can and infers segments where there is none."""
    return f"""{_areas_sql(extension)}, x AS (SELECT *, least(c0_lat, c1_lat, c2_lat, c3_lat) AS lo_lat, greatest(c0_lat, c1_lat, c2_lat, c3_lat) AS hi_lat, least(c0_lon, c1_lon, c2_lon, c3_lon) AS lo_lon, greatest(c0_lon, c1_lon, c2_lon, c3_lon) AS hi_lon FROM areas),
    near AS (SELECT trip_id, idx, {{'id': edge_id, 'v1': v1_id, 'v2': v2_id, 'e1': {_sql_angle_error('heading', _sql_bearing('lat', 'lon', 'v2_lat', 'v2_lon'))}, 'e2': {_sql_angle_error('heading', _sql_bearing('lat', 'lon', 'v1_lat', 'v1_lon'))}}} AS c,
                    {{'e': {_sql_angle_error('heading', 'course')}, 'id': edge_id}} AS own, l.edge_id IS NOT NULL AS in_leaf
             FROM trips JOIN x ON lat >= lo_lat AND lat <= hi_lat AND lon >= lo_lon AND lon <= hi_lon LEFT JOIN lookup USING (trip_id, idx) LEFT JOIN (SELECT node, edge_id FROM leaf_edges) l USING (node, edge_id) WHERE {_inside_sql()}),
    here AS (SELECT trip_id, idx, list(c) AS near, list(c.id) AS ids, (list_sort(list(own) FILTER (in_leaf)))[1].id AS by_index FROM near GROUP BY trip_id, idx),
    pt AS (SELECT trips.*, near, ids, by_index, floor(heading / (360.0::DOUBLE / 36.0::DOUBLE))::BIGINT % 36 AS sector FROM trips LEFT JOIN here USING (trip_id, idx)),
    kept AS (SELECT trip_id, idx, by_index AS cur, CASE WHEN by_index IS NULL THEN 0 ELSE -1 END::BIGINT AS number, sector AS was, CASE WHEN by_index IS NULL THEN 1 ELSE 0 END AS cnt FROM pt WHERE idx = 0
             UNION ALL SELECT trip_id, idx, cur, CASE WHEN cur IS NULL AND fresh THEN number + 1 ELSE number END, CASE WHEN cur IS NULL AND fresh THEN sector ELSE was END, CASE WHEN cur IS NOT NULL THEN 0 WHEN fresh THEN 1 ELSE cnt + 1 END
             FROM (SELECT *, cnt = 0 OR (sector <> was AND cnt > 10) AS fresh FROM (
                 SELECT trip_id, idx, sector, number, was, cnt, CASE WHEN old IS NULL THEN by_index WHEN list_contains(ids, old) THEN old
                        ELSE coalesce((list_sort(list_transform(list_filter(near, lambda c: c.v1 = vertex OR c.v2 = vertex), lambda c: {{'e': CASE WHEN c.v2 = vertex THEN c.e2 ELSE c.e1 END, 'id': c.id}})))[1].id, by_index) END AS cur
                 FROM (SELECT p.*, k.cur AS old, k.number, k.was, k.cnt, CASE WHEN {_beyond_sql(1, 'p.lat', 'p.lon')} THEN a.v2_id WHEN {_beyond_sql(3, 'p.lat', 'p.lon')} THEN a.v1_id END AS vertex
                       FROM kept k JOIN pt p ON p.trip_id = k.trip_id AND p.idx = k.idx + 1 LEFT JOIN areas a ON a.edge_id = k.cur))))"""


@register("map_fit", _TREE + f", {_fit_sql(5.0)} SELECT trip_id, idx, cur IS NOT NULL AS edge_explicit, coalesce(cur, number) AS edge_id FROM kept")
def map_fit(spark, sf_dir):
    return fit.fit_trips(demo.trips(spark, sf_dir), demo.roads(spark, sf_dir), _index(spark, sf_dir), 1.0, 5.0, 36, 10).select(*KEYS, "edge_explicit", "edge_id")


@register("implicit_fit", f"""WITH RECURSIVE {demo.trips_sql()}, s AS (SELECT *, floor(heading / (360.0::DOUBLE / 36.0::DOUBLE))::BIGINT % 36 AS sector FROM trips),
    f AS (SELECT trip_id, idx, 0::BIGINT AS edge_id, sector, 1 AS n FROM s WHERE idx = 0
          UNION ALL SELECT s.trip_id, s.idx, CASE WHEN s.sector <> f.sector AND f.n > 10 THEN f.edge_id + 1 ELSE f.edge_id END, CASE WHEN s.sector <> f.sector AND f.n > 10 THEN s.sector ELSE f.sector END, CASE WHEN s.sector <> f.sector AND f.n > 10 THEN 1 ELSE f.n + 1 END
          FROM f JOIN s ON s.trip_id = f.trip_id AND s.idx = f.idx + 1),
    e AS (SELECT trip_id, edge_id, min(idx) AS a, max(idx) AS b FROM f GROUP BY trip_id, edge_id), x AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY trip_id ORDER BY edge_id), b) AS z FROM e)
    SELECT f.trip_id, f.idx, f.edge_id, round(p.lon, 8) AS v1_lon, round(q.lon, 8) AS v2_lon FROM f JOIN x USING (trip_id, edge_id) JOIN trips p ON p.trip_id = f.trip_id AND p.idx = x.a JOIN trips q ON q.trip_id = f.trip_id AND q.idx = x.z""")
def implicit_fit(spark, sf_dir):
    """Without a map: inferred segments only."""
    found = fit.fit_trips(demo.trips(spark, sf_dir), None, heading_groups=36, min_edge_points=10)
    return found.select(*KEYS, "edge_id", F.round("v1_lon", 8).alias("v1_lon"), F.round("v2_lon", 8).alias("v2_lon"))


def _street(spark, sf_dir) -> DataFrame:
    return demo.street_fit(demo.trips(spark, sf_dir))


_STREET = f"WITH RECURSIVE {demo.trips_sql()}, {demo.roads_sql()}, {demo.street_fit_sql()}"


#: fitted with the choices met at intersections so far, as met.
_COUNTED = """v AS (SELECT vertex_id, CASE WHEN count(*) > 2 THEN count(*) - 1 ELSE 0 END AS choices FROM (SELECT v1_id AS vertex_id FROM roads UNION ALL SELECT v2_id FROM roads) GROUP BY vertex_id),
    r AS (SELECT *, lag(edge_id) OVER w AS oe, lag(v1_id) OVER w AS o1, lag(v2_id) OVER w AS o2 FROM fitted WHERE edge_explicit WINDOW w AS (PARTITION BY trip_id ORDER BY idx)),
    h AS (SELECT *, CASE WHEN oe <> edge_id THEN CASE WHEN o1 IN (v1_id, v2_id) THEN o1 WHEN o2 IN (v1_id, v2_id) THEN o2 END END AS shared FROM r),
    c AS (SELECT *, last_value(shared IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
    m AS (SELECT trip_id, idx, choices FROM c JOIN v ON v.vertex_id = c.shared WHERE shared IS NOT NULL AND shared IS DISTINCT FROM before),
    met AS (SELECT fitted.*, coalesce(sum(coalesce(choices, 0)) OVER (PARTITION BY trip_id ORDER BY idx), 0)::BIGINT AS out_degree FROM fitted LEFT JOIN m USING (trip_id, idx))"""
_CHOICES = f"{_STREET}, {_COUNTED}"


@register("out_degree", _CHOICES + " SELECT trip_id, idx, out_degree FROM met")
def out_degree(spark, sf_dir):
    return fit.count_choices(_street(spark, sf_dir), roads.vertices(demo.roads(spark, sf_dir))).select(*KEYS, "out_degree")


@register("turnaround_fit", _STREET + """, x AS (SELECT *, last_value(CASE WHEN edge_explicit THEN idx END IGNORE NULLS) OVER w AS xi, last_value(CASE WHEN edge_explicit THEN heading END IGNORE NULLS) OVER w AS xh FROM fitted WINDOW w AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT trip_id, xi AS "left", idx AS "right" FROM x WHERE edge_explicit AND xi < idx - 1 AND CASE WHEN abs(heading - xh) < 180.0 THEN abs(heading - xh) ELSE 360.0 - abs(heading - xh) END >= 30.0""")
def turnaround_fit(spark, sf_dir):
    return detect.turnaround_fit(_street(spark, sf_dir), 30.0).drop("aux")


def _flat(found: DataFrame) -> DataFrame:
    return found.select("trip_id", "left", "right", F.concat_ws(";", "aux").alias("aux"))


def _segment_area_sql(half: float = 30.0) -> str:
    """Corners c0 to c3 of the area of an inferred segment, of that half width in metres."""
    turned = [("v1", "-"), ("v2", "-"), ("v2", "+"), ("v1", "+")]
    corners = [_sql_project(f"{v}_lat", f"{v}_lon", f"((course {sign} 90.0::DOUBLE) % 360.0::DOUBLE)", f"{half}::DOUBLE") for v, sign in turned]
    return ", ".join(f"'c{i}_{n}': {x}" for i, c in enumerate(corners) for n, x in zip(("lat", "lon"), c))


_AT = {f"c{i}_{n}": f"q.c{i}_{n}" for i in range(4) for n in ("lat", "lon")}
_IN_QUEUED = _inside_sql("lat", "lon")
for _name, _field in _AT.items():
    _IN_QUEUED = _IN_QUEUED.replace(_name, _field)


@register("turnaround_area", f"""WITH RECURSIVE {demo.trips_sql()}, back AS (SELECT * REPLACE (-83.9::DOUBLE + (30 - abs(idx - 30)) * 0.00003::DOUBLE AS lon), floor(heading / (360.0::DOUBLE / 36.0::DOUBLE))::BIGINT % 36 AS sector FROM trips),
    f AS (SELECT trip_id, idx, 0::BIGINT AS edge_id, sector, 1 AS n FROM back WHERE idx = 0
          UNION ALL SELECT s.trip_id, s.idx, CASE WHEN s.sector <> f.sector AND f.n > 4 THEN f.edge_id + 1 ELSE f.edge_id END, CASE WHEN s.sector <> f.sector AND f.n > 4 THEN s.sector ELSE f.sector END, CASE WHEN s.sector <> f.sector AND f.n > 4 THEN 1 ELSE f.n + 1 END
          FROM f JOIN back s ON s.trip_id = f.trip_id AND s.idx = f.idx + 1),
    g AS (SELECT trip_id, edge_id, min(idx) AS a, max(idx) AS b FROM f GROUP BY trip_id, edge_id), h AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY trip_id ORDER BY edge_id), b) AS z FROM g),
    seg AS (SELECT *, {_sql_bearing('v1_lat', 'v1_lon', 'v2_lat', 'v2_lon')} AS course FROM (SELECT h.trip_id, edge_id, p.lat AS v1_lat, p.lon AS v1_lon, q.lat AS v2_lat, q.lon AS v2_lon FROM h JOIN back p ON p.trip_id = h.trip_id AND p.idx = a JOIN back q ON q.trip_id = h.trip_id AND q.idx = z)),
    area AS (SELECT trip_id, edge_id, {{{_segment_area_sql()}, 'left': 0::BIGINT}} AS area FROM seg),
    t AS (SELECT trip_id, 0::BIGINT AS idx, edge_id AS cur, [area][:0] AS queue, NULL::BIGINT AS met FROM f JOIN area USING (trip_id, edge_id) WHERE idx = 0
          UNION ALL SELECT trip_id, idx, edge_id, CASE WHEN edge_id <> cur THEN list_prepend(struct_update(area, "left" := idx), CASE WHEN met IS NULL THEN queue ELSE queue[:0] END)[:19] WHEN met IS NULL THEN queue ELSE queue[:0] END, met
          FROM (SELECT f.trip_id, f.idx, f.edge_id, t.cur, t.queue, area.area, CASE WHEN speed < 35.0 THEN list_filter(t.queue[2:], lambda q: {_IN_QUEUED})[1]."left" END AS met
                FROM t JOIN f ON f.trip_id = t.trip_id AND f.idx = t.idx + 1 JOIN back p ON p.trip_id = f.trip_id AND p.idx = f.idx JOIN area ON area.trip_id = t.trip_id AND area.edge_id = t.cur))
    SELECT trip_id, met AS "left", idx AS "right", 'ta' AS aux FROM t WHERE met IS NOT NULL""")
def turnaround_area(spark, sf_dir):
    there_and_back = F.lit(-83.9) + (30 - F.abs(F.col("idx") - 30)) * 0.00003
    fitted = fit.fit_trips(demo.trips(spark, sf_dir).withColumn("lon", there_and_back), None, heading_groups=36, min_edge_points=4)
    return _flat(detect.turnaround_area(fitted, 20, 60.0, 35.0))


def _stops_sql(limit_us: int, metres: float, speed: float) -> str:
    """The fold over fitted whose rows with an l are stops, as stopped."""
    return f"""pp AS (SELECT trip_id, idx, time_us, lat, lon, speed < {speed} AND NOT (edge_explicit AND edge_way_type IN (0, 1, 2, 8, 9, 10)) AS starts, count(*) OVER (PARTITION BY trip_id) AS n FROM fitted),
    stopped AS (SELECT trip_id, n, 0::BIGINT AS front, 0::BIGINT AS nxt, 'seek' AS phase, NULL::BIGINT AS l, NULL::BIGINT AS r FROM pp WHERE idx = 0
          UNION ALL SELECT s.trip_id, s.n,
            CASE WHEN phase = 'seek' THEN s.nxt WHEN phase = 'grow' THEN s.front WHEN phase = 'near' AND far THEN s.front + 1 WHEN phase = 'slow' AND NOT f.starts THEN s.front + 1 ELSE s.front END,
            CASE WHEN phase = 'seek' THEN s.nxt + 1 WHEN phase = 'grow' AND t.time_us - f.time_us <= {limit_us} THEN s.nxt + 1 ELSE s.nxt END,
            CASE WHEN phase = 'seek' THEN CASE WHEN t.starts THEN 'grow' ELSE 'seek' END
                 WHEN phase = 'grow' THEN CASE WHEN t.time_us - f.time_us <= {limit_us} THEN 'grow' WHEN far THEN 'near' ELSE 'seek' END
                 WHEN phase = 'near' THEN CASE WHEN far THEN 'near' ELSE 'slow' END
                 ELSE CASE WHEN f.starts THEN 'grow' WHEN s.front + 1 = s.nxt THEN 'seek' ELSE 'slow' END END,
            CASE WHEN phase = 'grow' AND t.time_us - f.time_us > {limit_us} AND NOT far THEN s.front END, CASE WHEN phase = 'grow' AND t.time_us - f.time_us > {limit_us} AND NOT far THEN s.nxt - 1 END
          FROM stopped s JOIN pp t ON t.trip_id = s.trip_id AND t.idx = s.nxt JOIN pp f ON f.trip_id = s.trip_id AND f.idx = s.front JOIN pp b ON b.trip_id = s.trip_id AND b.idx = greatest(s.nxt - 1, 0), LATERAL (SELECT {_sql_distance('f.lat', 'f.lon', 'b.lat', 'b.lon')} > {metres} AS far))"""


@register("stops", f"""WITH RECURSIVE {demo.trips_sql()}, {demo.street_fit_sql()}, {_stops_sql(750_000, 18.5, 20.0)}
    SELECT trip_id, l AS "left", r AS "right", 'stop' AS aux FROM stopped WHERE l IS NOT NULL""")
def stops(spark, sf_dir):
    return _flat(detect.stops(_street(spark, sf_dir), 0.75, 18.5, 20.0))


@register("start_end", f"WITH {demo.trips_sql()}, n AS (SELECT trip_id, count(*) AS n FROM trips GROUP BY trip_id) SELECT trip_id, 0::BIGINT AS \"left\", 1::BIGINT AS \"right\", 'start_pt' AS aux FROM n UNION ALL SELECT trip_id, n - 1, n, 'end_pt' FROM n")
def start_end(spark, sf_dir):
    return _flat(detect.start_end(demo.trips(spark, sf_dir)))


_MERGED = f"WITH {demo.trips_sql()}, {demo.spans_sql()}, " + """g AS (SELECT *, CASE WHEN "left" > max("right") OVER (PARTITION BY trip_id ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM spans),
    i AS (SELECT *, sum(new) OVER (PARTITION BY trip_id ORDER BY "left", "right" ROWS UNBOUNDED PRECEDING)::BIGINT AS id FROM g),
    merged AS (SELECT trip_id, id, min("left") AS "left", max("right") AS "right", string_agg(DISTINCT tag, ';' ORDER BY tag) AS aux FROM i GROUP BY trip_id, id)"""


@register("merge_intervals", _MERGED + " SELECT * FROM merged")
def merge_intervals(spark, sf_dir):
    found = intervals.merge_intervals(demo.spans(demo.trips(spark, sf_dir)))
    return found.select("trip_id", "id", "left", "right", F.concat_ws(";", "aux").alias("aux"))


@register("mark_points", _MERGED + ' SELECT t.trip_id, t.idx, m.id AS ci_id, m.id IS NOT NULL AS is_critical FROM trips t LEFT JOIN merged m ON m.trip_id = t.trip_id AND t.idx >= m."left" AND t.idx < m."right"')
def mark_points(spark, sf_dir):
    points = demo.trips(spark, sf_dir)
    return intervals.mark_points(points, intervals.merge_intervals(demo.spans(points))).select(*KEYS, "ci_id", "is_critical")


def _marked_twice(spark, sf_dir) -> DataFrame:
    points = demo.trips(spark, sf_dir)
    marked = intervals.mark_points(points, intervals.merge_intervals(demo.spans(points)))
    return intervals.mark_points(marked, intervals.merge_intervals(detect.start_end(points)), "pi_id", "is_private")


_TWICE = _MERGED + """, twice AS (SELECT t.*, m.id IS NOT NULL AS is_critical, idx = 0 OR idx = count(*) OVER (PARTITION BY t.trip_id) - 1 AS is_private FROM trips t LEFT JOIN merged m ON m.trip_id = t.trip_id AND t.idx >= m."left" AND t.idx < m."right")"""


@register("deidentify", _TWICE + " SELECT trip_id, idx, raw FROM twice WHERE NOT is_critical AND NOT is_private")
def deidentify(spark, sf_dir):
    return privacy.deidentify(_marked_twice(spark, sf_dir)).select(*KEYS, "raw")


@register("point_counters", _TWICE + " SELECT trip_id, count(*) AS n_points, 0::BIGINT AS n_invalid_field, 0::BIGINT AS n_invalid_geo, 0::BIGINT AS n_invalid_heading, 0::BIGINT AS n_error, count(*) FILTER (is_critical) AS n_ci, count(*) FILTER (is_private AND NOT is_critical) AS n_pi FROM twice GROUP BY trip_id")
def point_counters(spark, sf_dir):
    return privacy.point_counters(_marked_twice(spark, sf_dir))


@register("sum_counters", _TWICE + " SELECT count(*) AS n_points, 0::BIGINT AS n_invalid_field, 0::BIGINT AS n_invalid_geo, 0::BIGINT AS n_invalid_heading, 0::BIGINT AS n_error, count(*) FILTER (is_critical) AS n_ci, count(*) FILTER (is_private AND NOT is_critical) AS n_pi FROM twice")
def sum_counters(spark, sf_dir):
    return privacy.sum_counters(privacy.point_counters(_marked_twice(spark, sf_dir)))


#: Trips of the tables are about 200 m long; these limits fit them.
SMALL = DIConfig(**{**INTERACTIVE.__dict__, "sw_lat": demo.BOX[0][0], "sw_lon": demo.BOX[0][1], "ne_lat": demo.BOX[1][0], "ne_lon": demo.BOX[1][1], "stop_max_speed": 2.0, "stop_max_time": 0.45, "min_direct": 20.5, "max_direct": 60.5, "min_manhattan": 20.5, "max_manhattan": 70.5, "min_out_degree": 1, "max_out_degree": 4})


_LIMITS = pipeline.limits_of(SMALL)
_DISTANT = lambda a, b: _sql_distance(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


def _search_sql(name: str, seed: str, way: int) -> str:
    """A search in one direction as a fold over points; ``seed`` gives trip_id, gap, home and stop.  The table by that name has trip_id, gap, home, end_ and tag."""
    far = "CASE WHEN was_road THEN 'max_md' ELSE 'max_dist' END" if way < 0 else "'max_dist'"
    between = "b.idx < d.first AND b.idx > d.reached" if way < 0 else "b.idx > d.first AND b.idx < d.reached"
    return f"""{name}_walk AS (SELECT trip_id, gap, home, stop, home AS first, home AS p, 0.0::DOUBLE AS walked, NULL::VARCHAR AS why, false AS passed FROM ({seed})
        UNION ALL SELECT trip_id, gap, home, stop, CASE WHEN why IS NULL AND changed THEN p ELSE first END, p + {way}, CASE WHEN why IS NULL AND changed THEN walked + crossed ELSE walked END, why, passed AND why IN ('max_dist', 'max_md')
        FROM (SELECT *, CASE WHEN critical THEN 'ci' WHEN p = stop THEN 'pi' WHEN NOT changed THEN NULL WHEN was_road AND crossed + walked >= {_LIMITS.min_manhattan} AND direct >= {_LIMITS.min_direct} AND choices >= {_LIMITS.min_out_degree} THEN 'min'
                             WHEN passed THEN {far} WHEN was_road AND choices >= {_LIMITS.max_out_degree} THEN 'max_out_degree' END AS why
              FROM (SELECT *, crossed + walked >= {_LIMITS.max_manhattan} OR direct >= {_LIMITS.max_direct} AS passed
                    FROM (SELECT w.* EXCLUDE (why, passed), x.is_critical AS critical, x.edge_explicit <> y.edge_explicit OR x.edge_id <> y.edge_id AS changed, y.edge_explicit AS was_road, {_DISTANT('h', 'x')} AS direct, abs(x.out_degree - h.out_degree) AS choices,
                                 CASE WHEN y.edge_explicit AND NOT x.edge_explicit THEN {_DISTANT('y', 'x')} ELSE y.length END AS crossed
                          FROM {name}_walk w JOIN e x ON x.trip_id = w.trip_id AND x.idx = w.p JOIN e y ON y.trip_id = w.trip_id AND y.idx = w.first JOIN e h ON h.trip_id = w.trip_id AND h.idx = w.home WHERE w.why IS NULL)))),
    {name}_end AS (SELECT *, p - {way} AS reached FROM {name}_walk WHERE why IS NOT NULL),
    {name}_over AS (SELECT d.trip_id, d.gap, {'max' if way < 0 else 'min'}(b.idx) AS sooner FROM {name}_end d JOIN e b ON b.trip_id = d.trip_id AND {between} JOIN e y ON y.trip_id = d.trip_id AND y.idx = d.first JOIN e h ON h.trip_id = d.trip_id AND h.idx = d.home
        WHERE d.passed AND (d.walked + {_DISTANT('y', 'b')} > {_LIMITS.max_manhattan} OR {_DISTANT('h', 'b')} > {_LIMITS.max_direct}) GROUP BY d.trip_id, d.gap),
    {name} AS (SELECT trip_id, gap, home, coalesce(sooner, reached) AS end_, '{name}:' || why AS tag FROM {name}_end LEFT JOIN {name}_over USING (trip_id, gap))"""


#: The searches from e, fitted points with out_degree, length and is_critical, as private: one forwards from each critical stretch, one backwards from the next if the first leaves room.
_PRIVATE = f"""gaps AS (SELECT trip_id, idx AS gap, next AS until FROM (SELECT *, lag(is_critical) OVER t AS was, min(CASE WHEN is_critical THEN idx END) OVER (t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e WINDOW t AS (PARTITION BY trip_id ORDER BY idx)) WHERE was AND NOT is_critical),
    {_search_sql('forward', "SELECT trip_id, gap, gap AS home, NULL::BIGINT AS stop FROM gaps", 1)},
    {_search_sql('backward', "SELECT trip_id, gap, until - 1 AS home, end_ AS stop FROM forward JOIN gaps USING (trip_id, gap) WHERE until > end_", -1)},
    private AS (SELECT trip_id, home AS "left", end_ AS "right", tag AS aux FROM forward UNION ALL SELECT trip_id, end_, home + 1, tag FROM backward)"""


@register("privacy_intervals", _CHOICES + f""", e AS (SELECT *, {_sql_distance('e_lat', 'v1_lon', 'e_lat', 'v2_lon')} AS length, idx IN (0, count(*) OVER (PARTITION BY trip_id) - 1) AS is_critical FROM (
        SELECT *, 42.20005::DOUBLE + 0.002::DOUBLE * (trip_id::BIGINT % 100)::DOUBLE AS e_lat, -83.9005::DOUBLE + 0.001::DOUBLE * j::DOUBLE AS v1_lon, -83.9005::DOUBLE + 0.001::DOUBLE * (j + 1)::DOUBLE AS v2_lon FROM (SELECT *, floor((lon + 83.9005::DOUBLE) / 0.001::DOUBLE)::BIGINT AS j FROM met))),
    {_PRIVATE} SELECT * FROM private""")
def privacy_intervals(spark, sf_dir):
    fitted = fit.count_choices(_street(spark, sf_dir), roads.vertices(demo.roads(spark, sf_dir)))
    marked = intervals.mark_points(fitted, intervals.merge_intervals(detect.start_end(fitted)))
    return _flat(privacy.find_privacy(marked, pipeline.limits_of(SMALL)))


#: Area turnarounds of fitted, whose inferred segments have the areas in area: a fold with the queue of areas that were left.
_BACK = f"""area AS (SELECT trip_id, edge_id, {{{_segment_area_sql(SMALL.ta_area_width / 2)}, 'left': 0::BIGINT}} AS area FROM (SELECT DISTINCT trip_id, edge_id, v1_lat, v1_lon, v2_lat, v2_lon, {_sql_bearing('v1_lat', 'v1_lon', 'v2_lat', 'v2_lon')} AS course FROM fitted WHERE NOT edge_explicit)),
    back AS (SELECT trip_id, idx, CASE WHEN NOT edge_explicit THEN edge_id END AS cur, [area][:0] AS queue, NULL::BIGINT AS met FROM fitted LEFT JOIN area USING (trip_id, edge_id) WHERE idx = 0
          UNION ALL SELECT trip_id, idx, CASE WHEN NOT edge_explicit THEN edge_id END,
                 CASE WHEN edge_explicit THEN queue[:0] WHEN edge_id <> cur THEN list_prepend(struct_update(area, "left" := idx), CASE WHEN met IS NULL THEN queue ELSE queue[:0] END)[:{SMALL.ta_max_queue - 1}] WHEN met IS NULL THEN queue ELSE queue[:0] END, met
          FROM (SELECT p.trip_id, p.idx, p.edge_id, p.edge_explicit, b.cur, b.queue, area.area, CASE WHEN NOT edge_explicit AND b.cur IS NOT NULL AND speed < {SMALL.ta_max_speed} THEN list_filter(b.queue[2:], lambda q: {_IN_QUEUED})[1]."left" END AS met
                FROM back b JOIN fitted p ON p.trip_id = b.trip_id AND p.idx = b.idx + 1 LEFT JOIN area ON area.trip_id = b.trip_id AND area.edge_id = b.cur))"""


def _run_sql(outliers: bool, with_map: bool) -> str:
    """All stages by SMALL: sent has the points as they came, marked those without errors, on roads, with is_critical and is_private."""
    lattice = demo.roads_sql() if with_map else f"roads AS (WITH {demo.roads_sql()} SELECT * FROM roads WHERE false)"
    return f"""WITH RECURSIVE sent AS (WITH {demo.trips_sql(outliers)} SELECT * FROM trips), trips AS MATERIALIZED (WITH trips AS (SELECT * FROM sent), {CLEAN} SELECT * FROM cleaned), {lattice}, {TREE}, {_fit_sql(SMALL.fit_extension)},
    segment AS (SELECT s.trip_id, s.number, p.lat AS a_lat, p.lon AS a_lon, q.lat AS z_lat, q.lon AS z_lon
                FROM (SELECT *, CASE WHEN lead(a) OVER (PARTITION BY trip_id ORDER BY number) = b + 1 THEN b + 1 ELSE b END AS z FROM (SELECT trip_id, number, min(idx) AS a, max(idx) AS b FROM kept WHERE cur IS NULL GROUP BY trip_id, number)) s
                JOIN trips p ON p.trip_id = s.trip_id AND p.idx = a JOIN trips q ON q.trip_id = s.trip_id AND q.idx = z),
    fitted AS MATERIALIZED (SELECT t.*, cur IS NOT NULL AS edge_explicit, coalesce(cur, k.number) AS edge_id, way_type AS edge_way_type, v1_id, v2_id, coalesce(v1_lat, a_lat) AS v1_lat, coalesce(v1_lon, a_lon) AS v1_lon, coalesce(v2_lat, z_lat) AS v2_lat, coalesce(v2_lon, z_lon) AS v2_lon
                FROM kept k JOIN trips t USING (trip_id, idx) LEFT JOIN roads ON roads.edge_id = cur LEFT JOIN segment s ON cur IS NULL AND s.trip_id = k.trip_id AND s.number = k.number),
    {_COUNTED}, {_stops_sql(round(SMALL.stop_max_time * 1_000_000), SMALL.stop_min_distance, SMALL.stop_max_speed)}, {_BACK},
    met_again AS (SELECT *, last_value(CASE WHEN edge_explicit THEN idx END IGNORE NULLS) OVER w AS xi, last_value(CASE WHEN edge_explicit THEN heading END IGNORE NULLS) OVER w AS xh FROM fitted WINDOW w AS (PARTITION BY trip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    critical AS MATERIALIZED (SELECT trip_id, xi AS l, idx AS r FROM met_again WHERE edge_explicit AND xi < idx - 1 AND CASE WHEN abs(heading - xh) < 180.0 THEN abs(heading - xh) ELSE 360.0 - abs(heading - xh) END >= {SMALL.ta_heading_delta}
                 UNION ALL SELECT trip_id, met, idx FROM back WHERE met IS NOT NULL UNION ALL SELECT trip_id, l, r FROM stopped WHERE l IS NOT NULL
                 UNION ALL SELECT trip_id, 0, 1 FROM fitted WHERE idx = 0 UNION ALL SELECT trip_id, max(idx), max(idx) + 1 FROM fitted GROUP BY trip_id),
    e AS MATERIALIZED (SELECT *, {_sql_distance('v1_lat', 'v1_lon', 'v2_lat', 'v2_lon')} AS length, EXISTS (FROM critical WHERE critical.trip_id = met.trip_id AND l <= idx AND idx < r) AS is_critical FROM met),
    {_PRIVATE},
    marked AS (SELECT *, EXISTS (FROM private WHERE private.trip_id = e.trip_id AND "left" <= idx AND idx < "right") AS is_private FROM e) """


@register("pipeline_kept", _run_sql(True, True) + "SELECT trip_id, idx, raw, edge_explicit, edge_id FROM marked WHERE NOT is_critical AND NOT is_private")
def pipeline_kept(spark, sf_dir):
    return pipeline.run(demo.trips(spark, sf_dir, outliers=True), demo.roads(spark, sf_dir), SMALL).kept.select(*KEYS, "raw", "edge_explicit", "edge_id")


@register("pipeline_counters", _run_sql(True, True) + """SELECT trip_id, n AS n_points, 0::BIGINT AS n_invalid_field, 0::BIGINT AS n_invalid_geo, 0::BIGINT AS n_invalid_heading, n - coalesce(good, 0) AS n_error, coalesce(n_ci, 0) AS n_ci, coalesce(n_pi, 0) AS n_pi
    FROM (SELECT trip_id, count(*) AS n FROM sent GROUP BY trip_id) LEFT JOIN (SELECT trip_id, count(*) AS good, count(*) FILTER (is_critical) AS n_ci, count(*) FILTER (is_private AND NOT is_critical) AS n_pi FROM marked GROUP BY trip_id) USING (trip_id)""")
def pipeline_counters(spark, sf_dir):
    return pipeline.run(demo.trips(spark, sf_dir, outliers=True), demo.roads(spark, sf_dir), SMALL).counters


@register("online_kept", _run_sql(False, False) + "SELECT trip_id, idx, raw FROM marked WHERE NOT is_critical AND NOT is_private")
def online_kept(spark, sf_dir):
    """The rules of the streaming form, over whole trips."""
    return online.kept_points(demo.trips(spark, sf_dir), SMALL).select(*KEYS, "raw")


# Sinks


@register("trip_text", f"WITH {demo.trips_sql()} SELECT trip_id, 'header' || chr(10) || string_agg(raw, chr(10) ORDER BY idx) || chr(10) AS file_text FROM trips GROUP BY trip_id")
def trip_text(spark, sf_dir):
    return csv_sink.trip_text(demo.trips(spark, sf_dir), "header")


@register("counter_lines", _TWICE + " SELECT 'total,invalid_fields,invalid_GPS,invalid_heading,error,critical_interval,privacy_interval' || chr(10) || count(*)::VARCHAR || ',0,0,0,0,' || (count(*) FILTER (is_critical))::VARCHAR || ',' || (count(*) FILTER (is_private AND NOT is_critical))::VARCHAR AS summary FROM twice")
def counter_lines(spark, sf_dir):
    return csv_sink.counter_lines(privacy.sum_counters(privacy.point_counters(_marked_twice(spark, sf_dir))))


@register("kml_trips")
def kml_trips(spark, sf_dir):
    fitted = _street(spark, sf_dir)
    found = detect.start_end(fitted)
    marked = intervals.mark_points(fitted, intervals.merge_intervals(found)).withColumn("is_private", F.lit(False))
    return kml_sink.trip_kml(marked, found)
