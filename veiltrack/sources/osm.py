"""Street maps in XML: nodes, ways, segments of roads, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Bounds, LatLon, in_bounds
from ..session import checkpointed

NODES = "node_id long, lat string, lon string, pos long"
WAYS = "way_id long, refs array<long>, way_type string, pos long"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lat and lon as they are written, pos (document order within a file)."""
    rows = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat string, _lon string").load(path)
    return rows.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.monotonically_increasing_id().alias("pos"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, refs in order, way_type (the last highway tag, or empty), pos."""
    rows = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>").load(path)
    return rows.select(F.col("_id").alias("way_id"), F.col("nd._ref").alias("refs"), highway_tag(F.col("tag")).alias("way_type"), F.monotonically_increasing_id().alias("pos"))


def highway_tag(tags: Column) -> Column:
    found = F.filter(tags, lambda t: t["_k"] == "highway")
    return F.when(F.size(found) > 0, F.element_at(found, -1)["_v"]).otherwise(F.lit(""))


def unify_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with unified_id: that of the first node written with the same latitude and longitude."""
    firsts = nodes.groupBy("lat", "lon").agg(F.min_by("node_id", "pos").alias("unified_id"))
    return nodes.join(firsts, ["lat", "lon"])


def way_segments(ways: DataFrame, nodes: DataFrame, box: Bounds | None = None) -> DataFrame:
    """Segments between neighbours of a way: way_id, k, way_type, v1_id, v1_lat, v1_lon, v2_id, v2_lat, v2_lon, pos.

    A neighbour that isn't among the nodes ends the segments on both its
    sides; a segment counts if its first end is in the box.
    """
    refs = ways.select("way_id", "way_type", "pos", F.posexplode("refs").alias("k", "ref"))
    known = unify_nodes(nodes).select(F.col("node_id").alias("ref"), "unified_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    placed = refs.join(known, "ref", "left")
    after = Window.partitionBy("way_id").orderBy("k")
    rows = placed.withColumns({f"v2_{c}": F.lead(s).over(after) for c, s in (("id", "unified_id"), ("lat", "lat"), ("lon", "lon"))})
    rows = rows.filter("unified_id is not null and v2_id is not null").select("way_id", "k", "way_type", F.col("unified_id").alias("v1_id"), F.col("lat").alias("v1_lat"), F.col("lon").alias("v1_lon"), "v2_id", "v2_lat", "v2_lon", "pos")
    return rows.filter(in_bounds(box, LatLon(F.col("v1_lat"), F.col("v1_lon")))) if box else rows


def dedup_segments(segments: DataFrame) -> DataFrame:
    """Of segments between the same positions, either way, and of one way type, the first."""
    a, b = (F.struct(F.col(f"v{k}_lat").alias("lat"), F.col(f"v{k}_lon").alias("lon")) for k in (1, 2))
    keys = {"__low": F.least(a, b), "__high": F.greatest(a, b)}
    columns = segments.columns
    first = segments.withColumns(keys).groupBy("__low", "__high", "way_type").agg(F.min_by(F.struct(*columns), F.struct("pos", "way_id", "k")).alias("first"))
    return first.select("first.*")


def osm_bounds(nodes: DataFrame) -> DataFrame:
    """One row sw_lat, sw_lon, ne_lat, ne_lon over all nodes; none if a bound is missing or 0."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    row = nodes.agg(F.min(lat).alias("sw_lat"), F.min(lon).alias("sw_lon"), F.max(lat).alias("ne_lat"), F.max(lon).alias("ne_lon"))
    return row.filter("sw_lat <> 0 and sw_lon <> 0 and ne_lat <> 0 and ne_lon <> 0")


def numbered(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """rows with their numbers from 1 in an order of the whole table: sorted by ranges, each of which counts on from those before it."""
    spark = rows.sparkSession
    ranges = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)  # as Spark makes these ids
    counts = sorted(tuple(r) for r in ranges.groupBy(part.alias("part")).count().collect())  # one row a range
    before, first = 0, []
    for own, n in counts:
        first.append((own, before))
        before += n
    starts = spark.createDataFrame(first, "__part long, __first long")
    found = ranges.withColumns({"__part": part, "__place": place}).join(F.broadcast(starts), "__part")
    return found.withColumn(name, F.col("__first") + F.col("__place") + 1).drop("__part", "__place", "__first", "__id")


def shape_lines(segments: DataFrame) -> DataFrame:
    """seq, line: segments as lines of a shape file, numbered in document order."""
    end = lambda k: F.concat_ws(";", F.col(f"v{k}_id"), F.col(f"v{k}_lat"), F.col(f"v{k}_lon"))
    tags = F.concat(F.lit("way_type="), F.col("way_type"), F.lit(":way_id="), F.col("way_id"))
    return numbered(segments, ["pos", "way_id", "k"]).select("seq", F.concat_ws(",", F.lit("edge"), F.col("seq"), F.concat_ws(":", end(1), end(2)), tags).alias("line"))
