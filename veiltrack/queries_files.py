"""Queries that write files of every kind from the driver's tables and read them back, and SQL that gives the same rows without files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions.geo import LatLon
from .operators import fit
from .operators.folds import fold_trips
from .plans import demo
from .plans.config import load_json, parse_config
from .queries import _PARSED, _SEGMENTS, KEYS, _areas_sql, register
from .session import checkpoint_root
from .sinks import csv as csv_sink
from .sinks import kml as kml_sink
from .sinks import shapes as shape_sink
from .sources import osm, shapes, trips


def _folder(spark: SparkSession, name: str) -> str:
    """A new path among the session's checkpoints, which all workers see."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text_files(lines: DataFrame, header: str, by: str, spark: SparkSession, name: str) -> str:
    """A file for each value of a column: the header, then lines in the order of seq."""
    heads = lines.select(by).distinct().select(by, F.lit(-1).cast("long").alias("seq"), F.lit(header).alias("line"))
    rows = lines.select(by, "seq", "line").unionByName(heads)
    folder = _folder(spark, name)
    rows.repartition(by).sortWithinPartitions(by, "seq").select(by, F.col("line").alias("value")).write.partitionBy(by).text(folder)
    return folder


@register("trip_files", _PARSED + """, n2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM o), first AS (SELECT user_id, p[1] || '_' || p[2] AS trip_id FROM n2 WHERE seq = 1 AND len(p) = 19)
    SELECT trip_id, seq, outcome, lat, lon, heading, speed, time_us FROM n2 JOIN first USING (user_id)""")
def trip_files(spark, sf_dir):
    """A file a trip in the fixed layout: lines in order, ids of the first records."""
    lines, folder = demo.trip_lines(spark, sf_dir).select("trip_id", F.col("seq").alias("idx"), F.col("line").alias("raw")), _folder(spark, "trips")
    csv_sink.write_trip_files(lines, folder)
    return trips.read_trips(spark, folder).select("trip_id", F.col("seq").cast("long").alias("seq"), "outcome", "lat", "lon", "heading", "speed", "time_us")


@register("mapped_files", """WITH u AS (SELECT event_id, (event_id % 4)::VARCHAR AS file, event_id AS time_us, ((event_id // 3) % 7)::VARCHAR || '_f' AS uid, CASE WHEN event_id % 13 = 0 THEN 99.5 ELSE (event_id % 1000)::DOUBLE * 0.0625 END::DOUBLE AS lat FROM events),
    c AS (SELECT *, CASE WHEN lag(uid) OVER w IS NULL OR lag(uid) OVER w = uid THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY file ORDER BY event_id))
    SELECT file, time_us, uid, sum(new) OVER (PARTITION BY file ORDER BY event_id)::BIGINT AS run, lat, CASE WHEN lat > 80 THEN 'geo' ELSE 'ok' END AS outcome FROM c""")
def mapped_files(spark, sf_dir):
    """Files of another layout, told by their headers, with several trips each."""
    e = F.col("event_id")
    lat = F.when(e % 13 == 0, F.lit("99.5")).otherwise(((e % 1000).cast("double") * 0.0625).cast("string"))
    line = F.concat_ws(",", F.lit("5"), lat, (F.floor(e / 3) % 7).cast("string"), F.lit("-83.5"), F.lit("f"), e.cast("string"), F.lit("90"))
    lines = demo.events(spark, sf_dir).select((e % 4).cast("string").alias("f"), e.alias("seq"), line.alias("line"))
    folder = _text_files(lines, "Speed,Latitude,RxDevice,Longitude,FileId,Gentime,Heading", "f", spark, "mapped")
    found = trips.read_mapped_trips(spark, f"{folder}/*")
    return found.select(F.regexp_extract("file", "/f=([0-9]+)/", 1).alias("file"), "time_us", "uid", "run", "lat", "outcome")


def _circle_lines(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    where = F.concat_ws(":", ((e % 1000).cast("double") * 0.0625).cast("string"), (-((e % 999).cast("double") * 0.125)).cast("string"), (e % 50 - 3).cast("string"))
    return demo.events(spark, sf_dir).select(F.lit("f").alias("file"), e.alias("seq"), F.concat_ws(",", F.lit("circle"), e.cast("string"), where).alias("line"))


@register("parse_circles", "SELECT event_id AS circle_id, (event_id % 1000)::DOUBLE * 0.0625 AS lat, -((event_id % 999)::DOUBLE * 0.125) AS lon, (event_id % 50 - 3)::DOUBLE AS radius FROM events WHERE event_id % 50 >= 3")
def parse_circles(spark, sf_dir):
    """Circles of a shape file; those of a negative radius are none."""
    return shapes.parse_shapes(_circle_lines(spark, sf_dir)).circles.select("circle_id", "lat", "lon", "radius")


@register("parse_grids", """SELECT event_id // 7 AS "row", event_id % 7 AS col, 42.0::DOUBLE AS sw_lat, -84.0::DOUBLE AS sw_lon, 42.0 + (event_id % 900)::DOUBLE * 0.0625 AS ne_lat, -83.5::DOUBLE AS ne_lon FROM events WHERE event_id % 5 <> 0 AND 42.0 + (event_id % 900)::DOUBLE * 0.0625 <= 90.0""")
def parse_grids(spark, sf_dir):
    """Grid cells of a shape file; of wrong ids or positions there are none."""
    e = F.col("event_id")
    ident = F.when(e % 5 == 0, F.concat(e.cast("string"), F.lit("x"))).otherwise(F.concat_ws("_", F.floor(e / 7).cast("string"), (e % 7).cast("string")))
    where = F.concat_ws(":", F.lit("42.0"), F.lit("-84.0"), (F.lit(42.0) + (e % 900).cast("double") * 0.0625).cast("string"), F.lit("-83.5"))
    lines = demo.events(spark, sf_dir).select(F.lit("f").alias("file"), e.alias("seq"), F.concat_ws(",", F.lit("grid"), ident, where).alias("line"))
    return shapes.parse_shapes(lines).grids.select("row", "col", "sw_lat", "sw_lon", "ne_lat", "ne_lon")


@register("interval_lines", "SELECT event_id AS id, event_id % 40 AS \"left\", event_id % 40 + event_id % 9 AS \"right\", CASE WHEN event_id % 3 = 0 THEN '' ELSE 'stop;ta' END AS aux FROM events WHERE event_id % 4 <> 0")
def interval_lines(spark, sf_dir):
    """Intervals of one kind from lines; tags in order, each once."""
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "privacy_interval").otherwise("critical_interval")
    span = F.concat_ws(";", (e % 40).cast("string"), (e % 40 + e % 9).cast("string"))
    lines = demo.events(spark, sf_dir).select(F.concat(F.concat_ws(",", kind, e.cast("string"), span), F.when(e % 3 == 0, "").otherwise(",ta;stop;ta")).alias("line"))
    return shapes.parse_intervals(lines, "critical_interval").select("id", "left", "right", F.concat_ws(";", "aux").alias("aux"))


@register("osm_file", _SEGMENTS + " SELECT * FROM seg")
def osm_file(spark, sf_dir):
    """A street map written as XML and read again."""
    nodes = demo.map_nodes(spark, sf_dir).select("pos", F.concat(F.lit('<node id="'), "node_id", F.lit('" lat="'), "lat", F.lit('" lon="'), "lon", F.lit('"/>')).alias("value"))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    ways = demo.map_ways(spark, sf_dir).select((F.col("pos") + 10_000_000).alias("pos"), F.concat(F.lit('<way id="'), "way_id", F.lit('">'), refs, F.lit('<tag k="name" v="x"/><tag k="highway" v="'), "way_type", F.lit('"/></way>')).alias("value"))
    ends = spark.createDataFrame([(-1, '<?xml version="1.0"?><osm>'), (1 << 60, "</osm>")], "pos long, value string")
    path = _folder(spark, "map")
    nodes.unionByName(ways).unionByName(ends).coalesce(1).sortWithinPartitions("pos").select("value").write.text(path)  # one small map
    return osm.way_segments(osm.read_ways(spark, path), osm.read_nodes(spark, path), geo.bounds(42.22, -83.89, 42.38, -83.86)).drop("pos")


def _parsed(texts: DataFrame, read) -> DataFrame:
    """id, name, value of every parameter, as read takes each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, name, str(value)) for i, text in zip(batch["id"], batch["text"]) for name, value in asdict(read(text)).items()]
            yield pd.DataFrame(rows, columns=["id", "name", "value"])

    return texts.mapInPandas(run, "id long, name string, value string")


def _nations(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", "n_regionkey")


_ASKED = ["sw_lat", "fit_scale", "fit_extension", "ta_heading_delta", "ta_area_width", "heading_groups", "plot_kml", "stop_max_time", "uid_fields", "min_out_degree"]
@register("config_values", f"""WITH n AS (SELECT n_nationkey::BIGINT AS id, n_name, n_regionkey FROM nation), f AS (SELECT n.*, form FROM n, (VALUES ('lines'), ('legacy'), ('json')) v(form))
    SELECT form, id, name, CASE name
        WHEN 'sw_lat' THEN (id + 0.5)::VARCHAR
        WHEN 'fit_scale' THEN CASE form WHEN 'lines' THEN (n_regionkey + 1.5)::VARCHAR ELSE '1.0' END
        WHEN 'fit_extension' THEN CASE form WHEN 'legacy' THEN (n_regionkey + 1.5)::VARCHAR WHEN 'lines' THEN '5.0' ELSE '0.5' END
        WHEN 'ta_heading_delta' THEN CASE form WHEN 'lines' THEN (60 + id)::VARCHAR || '.0' ELSE '90.0' END
        WHEN 'ta_area_width' THEN CASE form WHEN 'legacy' THEN (60 + id)::VARCHAR || '.0' ELSE '30.0' END
        WHEN 'heading_groups' THEN CASE form WHEN 'json' THEN '36' ELSE (12 + id)::VARCHAR END
        WHEN 'plot_kml' THEN CASE WHEN id % 2 = 1 THEN 'True' ELSE 'False' END
        WHEN 'stop_max_time' THEN CASE form WHEN 'json' THEN '1.0' ELSE '120.0' END
        WHEN 'uid_fields' THEN CASE form WHEN 'json' THEN n_name || ',B' ELSE 'RxDevice,FileId' END
        WHEN 'min_out_degree' THEN CASE form WHEN 'json' THEN n_regionkey::VARCHAR ELSE '8' END END AS value
    FROM f, (VALUES {', '.join(f"('{n}')" for n in _ASKED)}) a(name)""")
def config_values(spark, sf_dir):
    """Parameters as both file forms, and older readers, set them: a file a nation."""
    n = _nations(spark, sf_dir)
    region, flag = F.col("n_regionkey").cast("string"), (F.col("id") % 2).cast("string")
    lines = F.concat(F.lit("quad_sw_lat:"), (F.col("id") + 0.5).cast("string"), F.lit("\nmf_scale:"), (F.col("n_regionkey") + 1).cast("string"), F.lit(".5\nta_heading_delta:"), (F.col("id") + 60).cast("string"), F.lit("\nn_heading_groups:"), (F.col("id") + 12).cast("string"), F.lit("\nplot_kml:"), flag, F.lit("\nunknown:7\nstop_max_time:soon\n"))
    as_json = F.concat(F.lit('{"sw-lat": '), (F.col("id") + 0.5).cast("string"), F.lit(', "ta-max-q": 7, "kml-output": '), F.when(F.col("id") % 2 == 1, "true").otherwise("false"), F.lit(', "uid-fields": "'), "n_name", F.lit(',B", "min-out-degree": "'), region, F.lit('"}'))
    forms = {"lines": (lines, parse_config), "legacy": (lines, lambda t: parse_config(t, legacy=True)), "json": (as_json, load_json)}
    found = None
    for form, (text, read) in forms.items():
        own = _parsed(n.select("id", text.alias("text")), read).filter(F.col("name").isin(_ASKED)).select(F.lit(form).alias("form"), "id", "name", "value")
        found = own if found is None else found.unionByName(own)
    return found


#: The parameters of a run that sets none.
_DEFAULTS = """('sw_lat', '42.17'), ('sw_lon', '-83.91'), ('ne_lat', '42.431'), ('ne_lon', '-83.54'), ('plot_kml', 'False'), ('fit_extension', '5.0'), ('scale_toggle', 'False'), ('fit_scale', '1.0'),
    ('heading_groups', '36'), ('min_edge_points', '50'), ('ta_max_queue', '20'), ('ta_area_width', '30.0'), ('ta_max_speed', '15.0'), ('ta_heading_delta', '90.0'), ('stop_max_time', '120.0'), ('stop_min_distance', '15.0'), ('stop_max_speed', '3.0'),
    ('min_direct', '500.0'), ('max_direct', '2500.0'), ('min_manhattan', '650.0'), ('max_manhattan', '3000.0'), ('min_out_degree', '8'), ('max_out_degree', '16'), ('rand_direct', '0.0'), ('rand_manhattan', '0.0'), ('rand_out_degree', '0.0'), ('error_sample', '50'), ('seed', '0'),
    ('lat_field', 'Latitude'), ('lon_field', 'Longitude'), ('heading_field', 'Heading'), ('speed_field', 'Speed'), ('time_field', 'Gentime'), ('uid_fields', 'RxDevice,FileId')"""


@register("config_defaults", f"SELECT n_nationkey::BIGINT AS id, name, value FROM nation, (VALUES {_DEFAULTS}) t(name, value)")
def config_defaults(spark, sf_dir):
    """Files, one a nation, whose keys and values nobody knows."""
    return _parsed(_nations(spark, sf_dir).select("id", F.concat("n_name", F.lit(":1\nstop_max_time:"), "n_name", F.lit("\n")).alias("text")), parse_config)


@register("trip_text_all", f"WITH {demo.trips_sql()} SELECT trip_id, 'own,header' || chr(10) || coalesce(string_agg(raw, chr(10) ORDER BY idx) FILTER (idx % 3 = 0 AND trip_id::BIGINT % 2 = 0) || chr(10), '') AS file_text FROM trips GROUP BY trip_id")
def trip_text_all(spark, sf_dir):
    """Under a header of its own, carriage returns gone; trips that lost all points are there with the header only."""
    points = demo.trips(spark, sf_dir)
    kept = points.filter((F.col("idx") % 3 == 0) & (F.col("trip_id").cast("bigint") % 2 == 0)).withColumn("raw", F.concat("raw", F.lit("\r")))
    return csv_sink.trip_text(kept, "own,header", trip_ids=points)


#: Of degrees with two digits before the point, sixteen digits in all.
_DIGITS = lambda c: f"rtrim(rtrim((({c}::VARCHAR)::DECIMAL(20, 14))::VARCHAR, '0'), '.')"


@register("shape_lines", f"WITH {demo.roads_sql()} SELECT 0 AS part, 0::BIGINT AS seq, '{shapes.SHAPE_HEADER}' AS line UNION ALL SELECT 2, edge_id, 'edge,' || edge_id || ',' || v1_id || ';' || {_DIGITS('v1_lat')} || ';' || {_DIGITS('v1_lon')} || ':' || v2_id || ';' || {_DIGITS('v2_lat')} || ';' || {_DIGITS('v2_lon')} || ',way_type=' || CASE way_type WHEN 0 THEN 'motorway' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'residential' END || ':way_id=' || edge_id FROM roads")
def shape_lines(spark, sf_dir):
    return shape_sink.shape_lines(demo.roads(spark, sf_dir))


def _drawn(rows: DataFrame, draw) -> DataFrame:
    """The columns of rows that draw leaves, with the element that it makes of each batch's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "content": [draw(r) for r in batch.itertuples()]})

    return rows.mapInPandas(run, "id string, content string")


_N = "chr(10)"
_PLACES = "string_agg(printf('%.10g,%.10g,0', lon, lat), ' ' ORDER BY idx)"


@register("kml_points", f"WITH {demo.trips_sql()} SELECT trip_id || '_' || idx AS id, '<Placemark>' || {_N} || '<styleUrl>#s</styleUrl>' || {_N} || '<description>s</description>' || {_N} || '<Point>' || {_N} || '<gx:altitudeMode>clampToGround</gx:altitudeMode>' || {_N} || '<coordinates>' || printf('%.10g,%.10g,0', lon, lat) || '</coordinates>' || {_N} || '</Point>' || {_N} || '</Placemark>' AS content FROM trips")
def kml_points(spark, sf_dir):
    rows = demo.trips(spark, sf_dir).select(F.concat_ws("_", *KEYS).alias("id"), "lat", "lon")
    return _drawn(rows, lambda r: kml_sink.point_mark(LatLon(r.lat, r.lon), "s"))


@register("kml_lines", f"WITH {demo.trips_sql()} SELECT trip_id AS id, '<Placemark>' || {_N} || '<name>a &amp; b</name>' || {_N} || '<styleUrl>#s</styleUrl>' || CASE WHEN count(*) > 1 THEN {_N} || '<LineString>' || {_N} || '<coordinates>' || {_N} || {_PLACES} || {_N} || {_N} || '</coordinates>' || {_N} || '</LineString>' ELSE '' END || {_N} || '</Placemark>' AS content FROM trips GROUP BY trip_id")
def kml_lines(spark, sf_dir):
    """A worker holds one trip's places at a time."""

    def line(trip: pa.Table) -> pa.Table:
        places = [LatLon(*p) for p in zip(trip.column("lat").to_pylist(), trip.column("lon").to_pylist())]
        return pa.table({"id": trip.column(0).slice(0, 1), "content": [kml_sink.line_mark("a & b", "s", places)]})

    return fold_trips(demo.trips(spark, sf_dir).select("trip_id", "idx", "lat", "lon"), ["idx"], line, "id string, content string")


_RING = " || ' ' || ".join(f"printf('%.8g,%.8g,0', c{i}_lon, c{i}_lat)" for i in (0, 1, 2, 3, 0))


@register("kml_polygons", f"WITH {demo.roads_sql()}, {_areas_sql(5.0)} SELECT edge_id::VARCHAR AS id, '<Placemark>' || {_N} || '<styleUrl>#s</styleUrl>' || {_N} || '<Polygon>' || {_N} || '<extrude>0</extrude>' || {_N} || '<altitudeMode>clampToGround</altitudeMode>' || {_N} || '<outerBoundaryIs>' || {_N} || '<LinearRing>' || {_N} || '<coordinates>' || {_N} || {_RING} || {_N} || {_N} || '</coordinates>' || {_N} || '</LinearRing>' || {_N} || '</outerBoundaryIs>' || {_N} || '</Polygon>' || {_N} || '</Placemark>' AS content FROM areas")
def kml_polygons(spark, sf_dir):
    """The areas of edges."""
    rows = fit.edge_areas(demo.roads(spark, sf_dir), 1.0, 5.0).select(F.col("edge_id").cast("string").alias("id"), *fit.CORNERS)
    return _drawn(rows, lambda r: kml_sink.polygon_mark([LatLon(getattr(r, f"c{i}_lat"), getattr(r, f"c{i}_lon")) for i in range(4)], "s", digits=8))


def _style_sql(*inner: str) -> str:
    return "'<Style id=\"' || id || '\">' || chr(10) || " + " || chr(10) || ".join(inner) + " || chr(10) || '</Style>'"


_COLOR = "printf('%x', 4278190080 + (id * 7919 * 97) % 16777216)"
_CLEAR = "printf('%x', 1426063360 + (id * 7919 * 97) % 16777216)"


@register("kml_styles", "WITH n AS (SELECT n_name AS id_, n_nationkey::BIGINT AS k FROM nation), s AS (SELECT id_ AS id, k FROM n) SELECT id, CASE k % 3 WHEN 0 THEN " + _style_sql("'<LineStyle>'", f"'<color>' || {_COLOR.replace('id', 'k')} || '</color>'", "'<width>' || (k % 9 + 1) || '</width>'", "'<gx:labelVisibility>1</gx:labelVisibility>'", "'</LineStyle>'")
    + " WHEN 1 THEN " + _style_sql("'<LineStyle>'", f"'<color>' || {_COLOR.replace('id', 'k')} || '</color>'", "'<width>1</width>'", "'</LineStyle>'", "'<PolyStyle>'", f"'<color>' || {_CLEAR.replace('id', 'k')} || '</color>'", "'<colorMode>normal</colorMode>'", "'<fill>1</fill>'", "'<outline>0</outline>'", "'</PolyStyle>'")
    + " ELSE " + _style_sql("'<IconStyle>'", "'<Icon>'", "'<href>http://e.x/' || k || '.png</href>'", "'</Icon>'", "'<hotSpot x=\"0.5\" xunits=\"fraction\" y=\"0.5\" yunits=\"fraction\"/>'", "'<scale>2</scale>'", "'</IconStyle>'") + " END AS content FROM s")
def kml_styles(spark, sf_dir):
    """A style a nation: of a line, of an area, or an icon, by turns."""

    def draw(r) -> str:
        color = 0xFF000000 + r.k * 7919 * 97 % (1 << 24)
        return kml_sink.line_style(r.id, color, r.k % 9 + 1) if r.k % 3 == 0 else kml_sink.poly_style(r.id, color, 1, outline=False) if r.k % 3 == 1 else kml_sink.icon_style(r.id, f"http://e.x/{r.k}.png", 2)

    return _drawn(_nations(spark, sf_dir).select(F.col("n_name").alias("id"), F.col("id").alias("k")), draw)
