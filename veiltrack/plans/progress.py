"""How far a run is, while it runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def share_done(spark: SparkSession, group: str) -> float:
    """The share of its tasks, which Spark cuts by bytes, that the jobs of a group have done so far; 0 before there are any."""
    tracker, done, of = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            own = tracker.getStageInfo(stage)
            if own:
                done, of = done + own.numCompletedTasks, of + own.numTasks
    return done / of if of else 0.0


@contextmanager
def watched(spark: SparkSession, tell: Callable[[float], None], every: float = 0.5) -> Iterator[None]:
    """Tells the share that is done of what runs in here, whenever it has grown: shares rise, and the last one is 1 if all went well."""
    context, group, over, told = spark.sparkContext, uuid.uuid4().hex, threading.Event(), [0.0]
    before = context.getLocalProperty("spark.jobGroup.id")

    def look() -> None:
        while not over.wait(every):
            share = min(share_done(spark, group), 0.99)  # stages to come are not known yet
            if share > told[0]:
                told[0] = share
                tell(share)

    watcher = threading.Thread(target=look, daemon=True)
    context.setLocalProperty("spark.jobGroup.id", group)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", before)
    tell(1.0)
