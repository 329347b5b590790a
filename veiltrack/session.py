"""Sessions, and the package on the workers' path."""

from __future__ import annotations

import os
import re
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_shipped: weakref.WeakSet = weakref.WeakSet()


def plain_unions(spark: SparkSession) -> None:
    """Has Spark shuffle a union anew where rows have to stand together.

    Spark 4.1 takes a union of inputs dealt by one key as dealt by it and leaves
    out the shuffle after it; but adaptive execution merges small parts of each
    input on its own, so rows of a key come to stand in different parts.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a SparkContext, and the session plain unions."""
    plain_unions(spark)
    if spark.sparkContext in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="veiltrack-")
    with zipfile.ZipFile(f"{folder}/veiltrack.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(f"{base}/{name}", os.path.relpath(f"{base}/{name}", os.path.dirname(here)))
    spark.sparkContext.addPyFile(f"{folder}/veiltrack.zip")
    _shipped.add(spark.sparkContext)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session has none, one of this machine, which a cluster refuses."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it has to name a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="veiltrack-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of spark.checkpoint.dir."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Things made from a table that a session keeps, the latest last.
MOST_KEPT = 8
_kept: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def kept(df: DataFrame, what: tuple, make: Callable[[], T]) -> T:
    """What make gives for df, made once a session: df is known by its plan and the files that it reads, so those have to stay as they are."""
    key = (what, tuple(sorted(df.inputFiles())))
    held = _kept.setdefault(df.sparkSession.sparkContext, [])
    for i, (other, own, value) in enumerate(held):
        if own == key and other.sameSemantics(df):
            held.append(held.pop(i))
            return value
    held.append((df, key, make()))
    del held[:-MOST_KEPT]
    return held[-1][2]
