"""Shape files from edges, circles and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.roads import WAY_TYPES
from ..sources.shapes import SHAPE_HEADER


def _digits(value: Column) -> Column:
    """A number in up to 16 significant digits, without trailing zeros."""
    return F.rtrim(F.rtrim(F.format_string("%.16g", value), F.lit("0")), F.lit("."))


def shape_lines(edges: DataFrame | None = None, circles: DataFrame | None = None, grids: DataFrame | None = None) -> DataFrame:
    """part, seq, line: the header, then circles, edges and grids, each kind in the order of its ids."""
    parts = []
    if circles is not None:
        parts.append(circles.select(F.lit(1).alias("part"), F.col("circle_id").alias("seq"), F.concat(F.lit("circle,"), F.col("circle_id"), F.lit(","), F.concat_ws(":", *(_digits(F.col(c)) for c in ("lat", "lon", "radius")))).alias("line")))
    if edges is not None:
        end = lambda k: F.concat_ws(";", F.col(f"v{k}_id"), _digits(F.col(f"v{k}_lat")), _digits(F.col(f"v{k}_lon")))
        name = F.coalesce(F.try_element_at(F.array(*(F.lit(n) for n in WAY_TYPES)), F.col("way_type") + 1), F.lit("unknown"))
        parts.append(edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("seq"), F.concat(F.lit("edge,"), F.col("edge_id"), F.lit(","), end(1), F.lit(":"), end(2), F.lit(",way_type="), name, F.lit(":way_id="), F.col("edge_id")).alias("line")))
    if grids is not None:
        parts.append(grids.select(F.lit(3).alias("part"), (F.col("row") * F.lit(1 << 31) + F.col("col")).alias("seq"), F.concat(F.lit("grid,"), F.col("row"), F.lit("_"), F.col("col"), F.lit(","), F.concat_ws(":", *(_digits(F.col(c)) for c in ("sw_lat", "sw_lon", "ne_lat", "ne_lon")))).alias("line")))
    if not parts:
        raise ValueError("no shapes")
    head = parts[0].sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(SHAPE_HEADER).alias("line"))
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out


def write_shapes(path: str, edges: DataFrame | None = None, circles: DataFrame | None = None, grids: DataFrame | None = None) -> None:
    """A folder of one text file; a map's shapes are a small table."""
    shape_lines(edges, circles, grids).orderBy("part", "seq").select("line").coalesce(1).write.mode("overwrite").text(path)
