"""Correction of GPS errors at both ends of a trip."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, LatLon, distance

SAMPLE = 50
#: Metres a second that no vehicle exceeds, and seconds between two points.
LIMIT, STEP = 44.7, 0.1


def correct_errors(points: DataFrame, sample: int = SAMPLE, by: str = "trip_id") -> DataFrame:
    """points without those that a vehicle can't have reached from the middle of the first, or the last, ``sample`` points; idx anew.

    A point counts as wrong if its distance from the median position takes a
    speed over LIMIT in half the sample's time.  Of the head, points move up
    as wrong ones go: a wrong point goes as long as fewer than ``sample`` good
    ones stand before it.  If at most ``sample`` points are left the tail is
    not looked at.  Trips of up to half a sample of points are left as they
    are: their median is undefined.
    """
    trip = Window.partitionBy(by).orderBy("idx")
    whole = Window.partitionBy(by)
    middle = int(sample / 2)

    def judged(rows: DataFrame, inside: Column, taken: Column) -> DataFrame:
        """rows with __bad: too far from the middle of the sample's positions, which are at most ``sample`` a trip."""
        place = lambda c: F.get(F.array_sort(F.collect_list(c)), F.lit(middle)).alias(f"__{c}")
        places = rows.filter(inside).groupBy(by).agg(place("lat"), place("lon"))
        away = distance(LatLon(F.col("lat"), F.col("lon")), LatLon(F.col("__lat"), F.col("__lon"))) / (F.floor(taken / 2) * STEP)
        return rows.join(places, by, "left").withColumn("__bad", F.coalesce(away > LIMIT, F.lit(False))).drop("__lat", "__lon")

    rows = points.withColumn("__pos", F.row_number().over(trip) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    rows = judged(rows, F.col("__pos") < sample, F.least(F.col("__n"), F.lit(sample)))
    rows = rows.withColumn("__bad", F.col("__bad") & (F.col("__n") > middle))
    good_before = F.coalesce(F.sum((~F.col("__bad")).cast("int")).over(trip.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__good", good_before).filter(~(F.col("__bad") & (F.col("__good") < sample)))
    rows = rows.withColumn("__pos", F.row_number().over(trip) - 1).withColumn("__m", F.count(F.lit(1)).over(whole))
    inside = (F.col("__m") > sample) & (F.col("__pos") >= F.col("__m") - sample)
    rows = judged(rows, inside, F.lit(sample)).filter(~(F.col("__bad") & inside))
    return rows.withColumn("idx", (F.row_number().over(trip) - 1).cast("long")).select(points.columns)


def correct_trip(lat: np.ndarray, lon: np.ndarray, sample: int = SAMPLE) -> np.ndarray:
    """The same for one trip that is at hand as a whole: places of the points that stay."""
    middle = int(sample / 2)

    def wrong(at: np.ndarray, of: np.ndarray, taken: int) -> np.ndarray:
        place = np.sort(lat[of])[middle], np.sort(lon[of])[middle]
        x = (np.radians(place[1]) - np.radians(lon[at])) * np.cos((np.radians(lat[at]) + np.radians(place[0])) / 2.0)
        y = np.radians(place[0]) - np.radians(lat[at])
        return np.sqrt(x * x + y * y) * EARTH_RADIUS_M / (taken // 2 * STEP) > LIMIT

    at = np.arange(len(lat))
    if len(at) <= middle:
        return at
    bad = wrong(at, at[:sample], min(len(at), sample))
    good_before = np.cumsum(~bad) - ~bad
    at = at[~(bad & (good_before < sample))]
    if len(at) > sample:
        at = np.concatenate((at[:-sample], at[-sample:][~wrong(at[-sample:], at[-sample:], sample)]))
    return at
