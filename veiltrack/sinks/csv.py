"""Writers of trips and of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.privacy import COUNTERS
from ..sources.trips import HEADER
from .files import paths_of, write_files


def trip_text(points: DataFrame, header=HEADER, strip_cr: bool = True, trip_ids: DataFrame | None = None) -> DataFrame:
    """trip_id, file_text: header and raw lines of each trip in order, lines ended by line feeds.  Of the trips in trip_ids those without points have the header only."""
    raw = F.regexp_replace("raw", "\r$", "") if strip_cr else F.col("raw")
    rows = points.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("idx", raw.alias("raw")))).alias("rows"))
    head = F.lit(header) if isinstance(header, str) else header
    if trip_ids is not None:
        rows = trip_ids.select("trip_id").distinct().join(rows, "trip_id", "left")
    lines = F.transform(F.transform("rows", lambda r: r["raw"]), lambda x: F.concat(x, F.lit("\n")))
    return rows.select("trip_id", F.concat(head, F.lit("\n"), F.coalesce(F.array_join(lines, ""), F.lit(""))).alias("file_text"))


def write_trips(points: DataFrame, folder: str, header: str = HEADER, strip_cr: bool = True) -> None:
    """Raw lines under folder/trip_id=.../, a file a trip, with the header first; an earlier run's files are replaced.

    Points of a trip go to one partition in order and Spark's text writer
    streams them, so no trip is held in memory.
    """
    raw = F.regexp_replace("raw", "\r$", "") if strip_cr else F.col("raw")
    rows = points.select("trip_id", "idx", raw.alias("value"))
    heads = points.select("trip_id").distinct().select("trip_id", F.lit(-1).cast("long").alias("idx"), F.lit(header).alias("value"))
    rows.unionByName(heads).repartition("trip_id").sortWithinPartitions("trip_id", "idx").select("trip_id", "value").write.mode("overwrite").partitionBy("trip_id").text(folder)


def write_trip_files(points: DataFrame, folder: str, suffix: str = ".csv", header: str = HEADER, strip_cr: bool = True, trip_ids: DataFrame | None = None) -> DataFrame:
    """Files folder/trip_id + suffix, the header and each point's line in order, which appear when all are written; gives trip_id and path of each.

    Of the trips in trip_ids those without points have the header only.  No
    trip is held in memory.
    """
    raw = F.regexp_replace("raw", "\r$", "") if strip_cr else F.col("raw")
    ids = (points if trip_ids is None else trip_ids).select("trip_id").distinct()
    heads = ids.select("trip_id", F.lit(-1).cast("long").alias("idx"), F.lit(header).alias("line"))
    rows = heads.unionByName(points.select("trip_id", "idx", raw.alias("line")))
    write_files(rows, F.col("trip_id"), F.concat("line", F.lit("\n")), folder, suffix, ["idx"])
    return paths_of(ids, "trip_id", folder, suffix)


def counter_lines(counters: DataFrame) -> DataFrame:
    """The summary of a run: one row, header and values as one text."""
    names = "total,invalid_fields,invalid_GPS,invalid_heading,error,critical_interval,privacy_interval"
    return counters.select(F.concat_ws("\n", F.lit(names), F.concat_ws(",", *COUNTERS)).alias("summary"))
