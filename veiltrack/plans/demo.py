"""Trips, roads and files derived from the driver's tables, written alike as DataFrames and as SQL.

The tables hold no trips.  ``events`` of one user in order become one trip
along a street, ten points a second; numbers are doubles from the start, so
that both engines make the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.roads import way_width

#: Streets of the lattice at most, from south to north, and blocks of one, from west to east.
STREETS, BLOCKS = 100, 53
#: Way types of the lattice, by turns: secondary, primary, residential, motorway.
TURNS = [3, 2, 6, 0]
BOX = ((42.19, -83.91), (42.41, -83.84))


def _double(value: float):
    return F.lit(float(value))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trips(spark: SparkSession, sf_dir: str, outliers: bool = False) -> DataFrame:
    """Points of all trips; outliers moves one in 97 a degree north."""
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    rows = events(spark, sf_dir).select("event_id", "user_id", "value", idx.alias("idx"))
    lat = _double(42.2) + _double(0.002) * (F.col("user_id") % 100).cast("double") + F.col("value") * _double(2e-7)
    if outliers:
        lat = lat + F.when(F.col("event_id") % 97 == 0, 1.0).otherwise(0.0)
    lon = _double(-83.9) + _double(0.001) * (F.col("user_id") % 50).cast("double") + _double(0.00003) * F.col("idx").cast("double")
    return rows.select(
        F.col("user_id").cast("string").alias("trip_id"), "idx", F.col("event_id").cast("string").alias("raw"), (F.col("idx") * 100000).alias("time_us"),
        lat.alias("lat"), lon.alias("lon"), ((F.col("value") * 7.0) % 360.0).alias("heading"), (F.col("value") % 40.0).alias("speed"),
    )


def trips_sql(outliers: bool = False) -> str:
    moved = " + (CASE WHEN event_id % 97 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE" if outliers else ""
    return f"""trips AS (
        SELECT user_id::VARCHAR AS trip_id, idx, event_id::VARCHAR AS raw, idx * 100000 AS time_us,
               42.2::DOUBLE + 0.002::DOUBLE * (user_id % 100)::DOUBLE + value * 2e-7::DOUBLE{moved} AS lat,
               -83.9::DOUBLE + 0.001::DOUBLE * (user_id % 50)::DOUBLE + 0.00003::DOUBLE * idx::DOUBLE AS lon,
               (value * 7.0::DOUBLE) % 360.0::DOUBLE AS heading, value % 40.0::DOUBLE AS speed
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events))"""


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, blocks: the streets on which users are, as far as their events reach."""
    return events(spark, sf_dir).groupBy((F.col("user_id") % STREETS).alias("k")).agg((F.max(F.col("event_id") % BLOCKS) + 1).alias("blocks"))


STREETS_SQL = f"street AS (SELECT user_id % {STREETS} AS k, max(event_id % {BLOCKS}) + 1 AS blocks FROM events GROUP BY 1)"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the lattice: along streets with gaps, and some across."""
    cells = streets(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    vertex = lambda k, j: [k * 100 + j + 1, _double(42.20005) + _double(0.002) * k.cast("double"), _double(-83.9005) + _double(0.001) * j.cast("double")]
    k, j = F.col("k"), F.col("j")
    names = ("id", "lat", "lon")

    def edge(kind: int, to) -> list:
        ends = [x.alias(f"v{n}_{c}") for n, v in ((1, vertex(k, j)), (2, to)) for c, x in zip(names, v)]
        way = F.element_at(F.array(*map(F.lit, TURNS)), ((k + j) % 4).cast("int") + 1)
        return [(k * 1000 + j * 2 + kind).alias("edge_id"), *ends, way.alias("way_type")]

    along = cells.filter((j < F.col("blocks") - 1) & ((k + j) % 3 != 0)).select(*edge(1, vertex(k, j + 1)))
    across = cells.filter((k < STREETS - 1) & ((k * 7 + j) % 5 == 0)).select(*edge(2, vertex(k + 1, j)))
    out = along.unionByName(across)
    return out.select("*", way_width(F.col("way_type")).alias("width"), F.lit(True).alias("is_explicit"))


def roads_sql() -> str:
    vertex = lambda k, j, n: f"({k}) * 100 + ({j}) + 1 AS v{n}_id, 42.20005::DOUBLE + 0.002::DOUBLE * ({k})::DOUBLE AS v{n}_lat, -83.9005::DOUBLE + 0.001::DOUBLE * ({j})::DOUBLE AS v{n}_lon"
    way = f"{TURNS}[((k + j) % 4 + 1)::INT]"
    edge = lambda kind, k, j: f"SELECT k * 1000 + j * 2 + {kind} AS edge_id, {vertex('k', 'j', 1)}, {vertex(k, j, 2)}, {way} AS way_type FROM cells"
    return f"""{STREETS_SQL}, cells AS (SELECT k, blocks, unnest(range(blocks)) AS j FROM street),
        roads AS (SELECT *, CASE way_type WHEN 0 THEN 22.0::DOUBLE WHEN 2 THEN 30.0::DOUBLE ELSE 17.0::DOUBLE END AS width FROM (
            {edge(1, 'k', 'j + 1')} WHERE j < blocks - 1 AND (k + j) % 3 <> 0
            UNION ALL {edge(2, 'k + 1', 'j')} WHERE k < {STREETS - 1} AND (k * 7 + j) % 5 = 0))"""


def street_fit(points: DataFrame) -> DataFrame:
    """points fit to the lattice by arithmetic, for the stages after fitting: on the street's edge where there is one, else on a segment named after the block."""
    k = F.col("trip_id").cast("bigint") % 100
    j = F.floor((F.col("lon") + _double(83.9005)) / _double(0.001)).cast("bigint")
    rows = points.withColumns({"k": k, "j": j}).withColumn("edge_explicit", (F.col("k") + F.col("j")) % 3 != 0)
    on = F.col("edge_explicit")
    lat, lon = _double(42.20005) + _double(0.002) * F.col("k").cast("double"), lambda c: _double(-83.9005) + _double(0.001) * c.cast("double")
    return rows.withColumns({
        "edge_id": F.when(on, F.col("k") * 1000 + F.col("j") * 2 + 1).otherwise(F.col("j")),
        "edge_way_type": F.when(on, F.element_at(F.array(*map(F.lit, TURNS)), ((F.col("k") + F.col("j")) % 4).cast("int") + 1)),
        "v1_id": F.when(on, F.col("k") * 100 + F.col("j") + 1), "v1_lat": lat, "v1_lon": lon(F.col("j")),
        "v2_id": F.when(on, F.col("k") * 100 + F.col("j") + 2), "v2_lat": lat, "v2_lon": lon(F.col("j") + 1),
    }).drop("k", "j")


def street_fit_sql() -> str:
    return f"""fitted AS (
        SELECT * EXCLUDE (k, j), (k + j) % 3 <> 0 AS edge_explicit,
               CASE WHEN (k + j) % 3 <> 0 THEN k * 1000 + j * 2 + 1 ELSE j END AS edge_id,
               CASE WHEN (k + j) % 3 <> 0 THEN {TURNS}[((k + j) % 4 + 1)::INT] END AS edge_way_type,
               CASE WHEN (k + j) % 3 <> 0 THEN k * 100 + j + 1 END AS v1_id, CASE WHEN (k + j) % 3 <> 0 THEN k * 100 + j + 2 END AS v2_id
        FROM (SELECT *, trip_id::BIGINT % 100 AS k, floor((lon + 83.9005::DOUBLE) / 0.001::DOUBLE)::BIGINT AS j FROM trips))"""


def spans(points: DataFrame) -> DataFrame:
    """Intervals on trips: from every event, one in seven up to ten points long, the others empty."""
    e = F.col("raw").cast("bigint")
    return points.select("trip_id", F.col("idx").alias("left"), (F.col("idx") + F.when(e % 7 == 0, e % 11).otherwise(0)).alias("right"), F.array(F.concat(F.lit("t"), (e % 3).cast("string"))).alias("aux"))


def spans_sql() -> str:
    return "spans AS (SELECT trip_id, idx AS \"left\", idx + CASE WHEN raw::BIGINT % 7 = 0 THEN raw::BIGINT % 11 ELSE 0 END AS \"right\", 't' || (raw::BIGINT % 3)::VARCHAR AS tag FROM trips)"


def trip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, block, seq, line: a record an event, one in a few of them wrong in one way or another."""
    e, u = F.col("event_id"), F.col("user_id")
    defect = e % 50
    lat = F.concat(F.lit("42."), F.lpad((F.lit(200000) + (u % 100) * 2000 + e % 1000).cast("string"), 6, "0"))
    lon = F.concat(F.lit("-83."), F.lpad((F.lit(500000) + (u % 50) * 1000 + e % 777).cast("string"), 6, "0"))
    lat = F.when(defect == 2, "85.0").when(defect == 4, "0").when(defect == 6, "abc").when(defect == 8, F.concat(F.lit("  "), lat, F.lit("xyz"))).otherwise(lat)
    lon = F.when(defect == 3, "180.0").when(defect == 4, "0.0").otherwise(lon)
    heading = F.when(defect == 5, "361").otherwise((e % 361).cast("string"))
    speed = F.when(defect == 7, "fast").otherwise(F.concat((e % 40).cast("string"), F.lit(".5")))
    fields = [u.cast("string"), F.lit("f"), F.lit("tx"), (e * 100000).cast("string"), F.lit("0"), F.lit("1"), F.lit("2"), lat, lon, F.lit("200.5"), speed, heading, *[F.lit("0")] * 6]
    line = F.concat(F.concat_ws(",", *fields), F.when(defect == 1, "").when(defect == 9, ",9,").when(defect == 10, ",").otherwise(",95"))
    return events(spark, sf_dir).select((e % 4).cast("string").alias("file"), F.floor(e / 1000).cast("bigint").alias("block"), e.alias("seq"), line.alias("line"), u.cast("string").alias("trip_id"), (F.floor(e / 3) % 7).cast("string").alias("uid"))


def trip_lines_sql() -> str:
    return """lines AS (
        SELECT *, concat_ws(',', user_id::VARCHAR, 'f', 'tx', (event_id * 100000)::VARCHAR, '0', '1', '2', la, lo, '200.5', sp, he, '0', '0', '0', '0', '0', '0')
               || CASE d WHEN 1 THEN '' WHEN 9 THEN ',9,' WHEN 10 THEN ',' ELSE ',95' END AS line
        FROM (SELECT *, CASE d WHEN 2 THEN '85.0' WHEN 4 THEN '0' WHEN 6 THEN 'abc' WHEN 8 THEN '  ' || lat0 || 'xyz' ELSE lat0 END AS la,
                     CASE d WHEN 3 THEN '180.0' WHEN 4 THEN '0.0' ELSE lon0 END AS lo,
                     CASE d WHEN 5 THEN '361' ELSE (event_id % 361)::VARCHAR END AS he,
                     CASE d WHEN 7 THEN 'fast' ELSE (event_id % 40)::VARCHAR || '.5' END AS sp
              FROM (SELECT event_id, user_id, event_id % 50 AS d, '42.' || lpad((200000 + (user_id % 100) * 2000 + event_id % 1000)::VARCHAR, 6, '0') AS lat0,
                           '-83.' || lpad((500000 + (user_id % 50) * 1000 + event_id % 777)::VARCHAR, 6, '0') AS lon0 FROM events)))"""


def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the lattice as a map file has them; one in seven twice."""
    cells = streets(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("id", F.col("k") * BLOCKS + F.col("j"))
    lat = F.concat(F.lit("42."), F.lpad((F.lit(200050) + F.col("k") * 2000).cast("string"), 6, "0"))
    lon = F.concat(F.lit("-83."), F.lpad((F.lit(900500) - F.col("j") * 1000).cast("string"), 6, "0"))
    rows = cells.select((F.col("k") * 100 + F.col("j") + 1).alias("node_id"), lat.alias("lat"), lon.alias("lon"), F.col("id").alias("pos"), "k", "j")
    again = rows.filter((F.col("k") + F.col("j")) % 7 == 0).withColumns({"node_id": F.col("node_id") + 100000, "pos": F.col("pos") + 100000})
    return rows.unionByName(again).select("node_id", "lat", "lon", "pos")


def map_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way a street, by second names where there are any, and with some nodes that are nowhere."""
    j, rows = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), streets(spark, sf_dir).select(F.col("k").alias("id"), "blocks")
    refs = F.transform(j, lambda x: F.when((F.col("id") * x) % 11 == 5, F.lit(999999)).when((F.col("id") + x) % 14 == 0, F.col("id") * 100 + x + 100001).otherwise(F.col("id") * 100 + x + 1))
    return rows.select(F.col("id").alias("way_id"), refs.alias("refs"), F.when(F.col("id") % 2 == 0, "primary").otherwise("service").alias("way_type"), F.col("id").alias("pos"))


def map_sql() -> str:
    return f"""{STREETS_SQL}, cell AS (SELECT k, j, k * {BLOCKS} + j AS id FROM (SELECT k, unnest(range(blocks)) AS j FROM street)),
        node AS (SELECT k, j, k * 100 + j + 1 AS node_id, '42.' || lpad((200050 + k * 2000)::VARCHAR, 6, '0') AS lat, '-83.' || lpad((900500 - j * 1000)::VARCHAR, 6, '0') AS lon, id AS pos FROM cell),
        nodes AS (SELECT node_id, lat, lon, pos FROM node UNION ALL SELECT node_id + 100000, lat, lon, pos + 100000 FROM node WHERE (k + j) % 7 = 0),
        refs AS (SELECT k AS way_id, j AS k, CASE WHEN (k * j) % 11 = 5 THEN 999999 WHEN (k + j) % 14 = 0 THEN k * 100 + j + 100001 ELSE k * 100 + j + 1 END AS ref, CASE WHEN k % 2 = 0 THEN 'primary' ELSE 'service' END AS way_type FROM cell)"""
