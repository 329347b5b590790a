"""Intervals of points: merging them, and marking the points that they cover.

An interval is half open, [left, right), and carries the sorted distinct tags
of what found it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["trip_id", "left", "right", "aux"]


def union_intervals(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select(COLUMNS) for x in lists))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """trip_id, id, left, right, aux: intervals that overlap or touch become one; ids count from 0 within a trip."""
    order = Window.partitionBy("trip_id").orderBy("left", "right")
    before = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("left") > before, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = intervals.select(*COLUMNS).withColumn("id", group.cast("long"))
    return rows.groupBy("trip_id", "id").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aux")))).alias("aux"))


def mark_points(points: DataFrame, merged: DataFrame, id_column: str = "ci_id", flag: str = "is_critical") -> DataFrame:
    """points with the id of the merged interval that covers each, or null, and whether one does.

    Merged intervals are disjoint, so each point takes the last one that
    starts at or before it, and only if that has not ended: one pass over the
    union of both in order, without a join on a range.
    """
    columns = points.columns
    starts = merged.select("trip_id", F.col("left").alias("idx"), F.struct("left", "right", "id").alias("__span")).filter("__span.left < __span.right")
    missing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns if c not in ("trip_id", "idx")]
    both = points.withColumn("__span", F.lit(None).cast(starts.schema["__span"].dataType)).withColumn("__is", F.lit(1)).unionByName(starts.select("trip_id", "idx", *missing, "__span", F.lit(0).alias("__is")))
    last = F.last("__span", ignorenulls=True).over(Window.partitionBy("trip_id").orderBy("idx", "__is"))
    rows = both.withColumn("__last", last).filter("__is = 1")
    found = F.when(F.col("idx") < F.col("__last.right"), F.col("__last.id"))
    return rows.withColumn(id_column, found).withColumn(flag, found.isNotNull()).select(*columns, id_column, flag)
