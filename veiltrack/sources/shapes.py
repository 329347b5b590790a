"""Shape files: edges, circles and grids, one a line."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number_prefix, split_fields, strip, whole_prefix
from ..operators.roads import OTHER, WAY_IDS, way_width
from .trips import read_lines

#: The first line of a shape file.
SHAPE_HEADER = "type,id,geography,attributes"


class Shapes(NamedTuple):
    """edges, circles, grids, and the lines that make none of them."""

    edges: DataFrame
    circles: DataFrame
    grids: DataFrame
    bad: DataFrame


def _position(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90.0) & (F.abs(lon) <= 180.0)


def way_type(attributes: Column) -> Column:
    """Number of the way type in k=v:k=v; unknown ones and none are OTHER."""
    pairs = F.transform(split_fields(attributes, ":"), lambda a: F.split(a, "=", 2))
    named = F.filter(pairs, lambda p: strip(p[0]) == "way_type")
    name = F.lower(strip(F.get(F.element_at(named, -1), F.lit(1))))
    known = F.create_map(*(x for k, v in WAY_IDS.items() for x in (F.lit(k), F.lit(v))))
    return F.when(F.size(named) > 0, F.coalesce(F.try_element_at(known, name), F.lit(OTHER))).otherwise(F.lit(OTHER))


def parse_shapes(lines: DataFrame) -> Shapes:
    """Shapes of (file, seq, line), headers left out.

    A vertex has the position at which it is first named in its file.  Lines
    of fewer than three or more than four fields, out of range or unreadable
    are in ``bad``; a type of another name is passed over.
    """
    rows = lines.withColumn("parts", split_fields(F.col("line"), ","))
    fit = F.size("parts").between(3, 4)
    kind, ident, where, extra = (F.get("parts", F.lit(i)) for i in range(4))
    rows = rows.withColumns({"fit": fit, "kind": kind, "ident": ident, "geo": split_fields(where, ":"), "extra": extra})
    ok = rows.filter("fit")

    ends = F.transform(F.col("geo"), lambda g: split_fields(g, ";"))
    edges = ok.filter("kind in ('edge', 'line')").withColumn("ends", ends)
    end = lambda k, i: F.get(F.get("ends", F.lit(k)), F.lit(i))
    edges = edges.select("file", "seq", "line", "extra", "geo", "ends", whole_prefix(F.col("ident")).alias("edge_id"), *(f(end(k, i)).alias(f"v{k + 1}_{n}") for k in (0, 1) for i, (n, f) in enumerate((("id", whole_prefix), ("lat", number_prefix), ("lon", number_prefix)))))
    sound = (F.size("geo") == 2) & (F.size(F.get("ends", F.lit(0))) == 3) & (F.size(F.get("ends", F.lit(1))) == 3)
    for c in ("edge_id", "v1_id", "v2_id"):
        sound = sound & F.col(c).isNotNull()
    sound = sound & F.coalesce(_position(F.col("v1_lat"), F.col("v1_lon")) & _position(F.col("v2_lat"), F.col("v2_lon")), F.lit(False))
    edges = edges.withColumn("sound", F.coalesce(sound, F.lit(False)))
    named = edges.filter("sound").select("file", "seq", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}_id").alias("id"), F.col(f"v{k}_lat").alias("lat"), F.col(f"v{k}_lon").alias("lon")) for k in (1, 2)))).alias("v")).select("file", F.col("v.id").alias("id"), F.struct("seq", "v.k", "v.lat", "v.lon").alias("first"))
    named = named.groupBy("file", "id").agg(F.min("first").alias("first"))
    good = edges.filter("sound").drop("v1_lat", "v1_lon", "v2_lat", "v2_lon")
    for k in (1, 2):
        good = good.join(named.select("file", F.col("id").alias(f"v{k}_id"), F.col("first.lat").alias(f"v{k}_lat"), F.col("first.lon").alias(f"v{k}_lon")), ["file", f"v{k}_id"])
    good = good.withColumn("same", (F.col("v1_id") == F.col("v2_id")) | ((F.col("v1_lat") == F.col("v2_lat")) & (F.col("v1_lon") == F.col("v2_lon"))))
    made = good.filter("not same").withColumn("way_type", way_type(F.col("extra")))
    made = made.select("edge_id", "v1_id", "v1_lat", "v1_lon", "v2_id", "v2_lat", "v2_lon", "way_type", way_width(F.col("way_type")).alias("width"), F.lit(True).alias("is_explicit"), "file", "seq")

    circles = ok.filter("kind = 'circle'").select("file", "seq", "line", whole_prefix(F.col("ident")).alias("circle_id"), F.size("geo").alias("n"), *(number_prefix(F.get("geo", F.lit(i))).alias(c) for i, c in enumerate(("lat", "lon", "radius"))))
    circles = circles.withColumn("sound", F.coalesce((F.col("n") == 3) & F.col("circle_id").isNotNull() & _position(F.col("lat"), F.col("lon")) & (F.col("radius") >= 0.0), F.lit(False)))

    cell = F.split("ident", "_", -1)
    grids = ok.filter("kind = 'grid'").select("file", "seq", "line", F.size(cell).alias("m"), F.size("geo").alias("n"), whole_prefix(F.get(cell, F.lit(0))).alias("row"), whole_prefix(F.get(cell, F.lit(1))).alias("col"), *(number_prefix(F.get("geo", F.lit(i))).alias(c) for i, c in enumerate(("sw_lat", "sw_lon", "ne_lat", "ne_lon"))))
    grids = grids.withColumn("sound", F.coalesce((F.col("n") == 4) & (F.col("m") == 2) & F.col("row").isNotNull() & F.col("col").isNotNull() & _position(F.col("sw_lat"), F.col("sw_lon")) & _position(F.col("ne_lat"), F.col("ne_lon")), F.lit(False)))

    line = ["file", "seq", "line"]
    bad = rows.filter("not fit").select(line).unionByName(edges.filter("not sound").select(line)).unionByName(good.filter("same").select(line)).unionByName(circles.filter("not sound").select(line)).unionByName(grids.filter("not sound").select(line))
    return Shapes(made, circles.filter("sound").select("circle_id", "lat", "lon", "radius", "file", "seq"), grids.filter("sound").select("row", "col", "sw_lat", "sw_lon", "ne_lat", "ne_lon", "file", "seq"), bad)


def read_shapes(spark: SparkSession, path: str) -> Shapes:
    return parse_shapes(read_lines(spark, path).filter("seq > 0"))


def parse_intervals(lines: DataFrame, kind: str) -> DataFrame:
    """Intervals of a kind (critical_interval or privacy_interval) from lines kind,id,left;right[,tag;tag]: id, left, right, aux."""
    parts = split_fields(F.col("line"), ",")
    span = split_fields(F.get(parts, F.lit(2)), ";")
    rows = lines.filter(F.get(parts, F.lit(0)) == kind).filter(F.size(parts).between(3, 4))
    tags = F.coalesce(F.array_sort(F.array_distinct(split_fields(F.get(parts, F.lit(3)), ";"))), F.array().cast("array<string>"))
    return rows.select(whole_prefix(F.get(parts, F.lit(1))).alias("id"), whole_prefix(F.get(span, F.lit(0))).alias("left"), whole_prefix(F.get(span, F.lit(1))).alias("right"), tags.alias("aux")).filter("id is not null and left is not null and right is not null")


def parse_implicit_edges(lines: DataFrame) -> DataFrame:
    """Edges from lines implicit_edge,id,uid;lat;lon:uid;lat;lon, not explicit and without a way type of their own."""
    renamed = lines.filter(F.col("line").startswith("implicit_edge,")).withColumn("line", F.expr("substring(line, 10)"))
    return parse_shapes(renamed).edges.withColumn("is_explicit", F.lit(False))


def first_seen(edges: DataFrame) -> DataFrame:
    """One edge an id, the first in its file."""
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy("file", "edge_id").orderBy("seq"))).filter("__n = 1").drop("__n")
