"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s should be taken target(s) / size(s) times.  The whole
part is taken as it is.  The fractions of a source are settled in pairs: a
random transfer that keeps the expected copies of both and the sum of their
*words* makes one of the pair integral, and the other goes on to the next
pair.  Documents are dealt into chunks of bounded size within their source, by
a hash of id and text, so a source that holds a third of all rows is many
tasks' work, with ids or without; rows that have no fraction to settle, those
of size 0 among them, are in no chunk.  Each chunk leaves
one open document at most, and a reduction tree settles those in the same way,
level by level.  What a source takes differs from its target by the words of
one document at most.

Random numbers are drawn by seed, level, source and chunk over rows in a fixed
order: reruns agree, however the rows are partitioned.

Sources may be many: they are ranked within ranges of names, and joined to
their documents by broadcast only if there are at most ``MOST_BROADCAST``.

Defined results: null text has size 0, and texts of any length are counted
whole; null sources are one source, the last; documents of size 0 and sources
without words take 0 words and 0 copies; ids of any type that can be ordered
are kept as they are; rows that repeat a doc_id are rounded one by one; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: Documents in a chunk on average, and residuals that a node of the tree takes.
CHUNK_ROWS = 1024
FAN_IN = 256
#: Sources that are broadcast at most (some 100 bytes each).
MOST_BROADCAST = 100_000

_EPS = 1e-9
_ROW = "doc_id {}, source_rank long, chunk long, size long, source_size long, target double, whole double, p double, copies double, row long"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, folder: str | None = None) -> DataFrame:
    """source, source_rank, source_size, source_rows, target from source and size of each document.

    Sources are ranked by code point, null last; their weights repeat.  All
    sizes together are shared by weight; a target stops at ``most`` times its
    source's size, and the excess is reshared until none is above.  Each round
    is an aggregate over the table of sources, of which two numbers reach the
    driver.
    """
    folder = folder or shared_folder(sizes.sparkSession, "mixing")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # by ranges of names, each numbered by itself; one row a range tells how many come before it
    ranged = stored(table.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()), folder, "ranges")
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("__before")
    table = ranged.join(F.broadcast(starts), "__range")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    table = stored(table.withColumn("source_rank", rank).withColumn("weight", weight).drop("__range", "__before"), folder, "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, level, ceiling = F.col("source_size") * F.lit(float(most)), 0.0, -1.0
    while level > ceiling:  # the water level rises as sources reach their caps
        ceiling = level
        open_ = F.col("weight") * F.lit(level) <= cap if level else F.lit(True)
        capped, open_weight = table.agg(F.sum(F.when(~open_, cap)), F.sum(F.when(open_, F.col("weight")))).first()
        level = max(level, (total - (capped or 0.0)) / open_weight) if open_weight else level
    return table.select("source", "source_rank", "source_size", "source_rows", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def _settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pairs fractions until all but one are 0 or 1; keeps the sum of p * size."""
    p = p.copy()
    held = -1
    draws = rng.random(len(p))
    for j in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)):
        if held < 0:
            held = j
            continue
        a, b = float(size[held]), float(size[j])
        up, down = min(a * (1 - p[held]), b * p[j]), min(a * p[held], b * (1 - p[j]))
        moved = up if draws[j] * (up + down) < down else -down
        p[held] += moved / a
        p[j] -= moved / b
        for i in (held, j):
            if p[i] < _EPS or p[i] > 1 - _EPS:
                p[i] = round(p[i])
        if p[held] in (0.0, 1.0):
            held = j if 0 < p[j] < 1 else -1
    return p


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Settles each chunk; one row of a chunk at most stays open (copies null)."""

    def settle(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([(c, "ascending") for c in ("doc_id", "size", "p", "row")])
        rank, number = chunk["source_rank"][0].as_py(), chunk["chunk"][0].as_py()
        p = _settle(chunk["p"].to_numpy(), chunk["size"].to_numpy(), np.random.default_rng([seed, level, rank, number]))
        done = (p == 0) | (p == 1)
        copies = pa.array(chunk["whole"].to_numpy() + p, mask=~done)
        return chunk.set_column(chunk.schema.get_field_index("p"), "p", pa.array(p)).set_column(chunk.schema.get_field_index("copies"), "copies", copies)

    return rows.groupBy("source_rank", "chunk").applyInArrow(settle, _ROW.format(rows.dtypes[0][1]))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies."""
    return _mixed(docs, weights, most, seed, id_col, text_col, source_col, chunk_rows, fan_in).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def _mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """mix_sources with source and row, a hash of the text."""
    folder = shared_folder(docs.sparkSession, "mixing")
    rows = stored(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (source_col, "source"))), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("row")), folder, "sizes")
    sources = source_targets(rows, weights, most, folder)
    sources = stored(sources.withColumn("chunks", F.ceil(F.col("source_rows") / chunk_rows)), folder, "targets")
    chunks, n_sources = sources.agg(F.max("chunks"), F.count(F.lit(1))).first()
    chunks, small = chunks or 1, F.broadcast if n_sources <= MOST_BROADCAST else (lambda df: df)
    rows = rows.join(small(sources), rows["source"].eqNullSafe(sources["source"])).drop("source", "source_rows")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + F.lit(_EPS)).cast("double")).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("p") < _EPS, F.lit(0.0)).otherwise(F.col("p")))
    rows = rows.withColumn("chunk", F.expr("pmod(xxhash64(doc_id, row, source_rank), chunks)")).withColumn("copies", F.when(F.col("p") == 0, F.col("whole")))
    names = [c.split()[0] for c in _ROW.split(", ")]
    is_open, rows = F.col("copies").isNull(), rows.select(names)
    settled, level, rows = [rows.filter(~is_open)], 0, rows.filter(is_open)
    while True:
        out = stored(_level(rows, level, seed), folder, f"level{level}")
        settled.append(out.filter(~is_open))
        rows = out.filter(is_open)
        if chunks <= 1:
            break
        chunks, level = math.ceil(chunks / fan_in), level + 1
        rows = rows.withColumn("chunk", F.expr(f"chunk div {fan_in}"))
    # the root of each source's tree: the last open document is drawn by itself
    draw = F.expr(f"(shiftrightunsigned(xxhash64({seed}, source_rank), 11)) / 9007199254740992D")
    settled.append(rows.withColumn("copies", F.col("whole") + (draw < F.col("p")).cast("double")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.join(small(sources.select("source_rank", "source")), "source_rank")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies (column copy counts them from 1), with size, source_size, target and taken (the words of this copy).

    Rows that agree in doc_id, source and text share their copies as evenly as
    whole copies can be; those that get one more are the first by a hash of
    their columns, so the sum of copies is kept.  Documents of size 0 are never
    taken.  A column of docs by the name of one that is added gives way to it.
    """
    names = [options.get(f"{c}_col", n) for c, n in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    keys = ["__row", "__text"]  # hashes of id and source, and of the text: the join and the numbering share one exchange
    mixed = _mixed(docs, **options).filter("size > 0").groupBy(F.xxhash64("doc_id", "source").alias("__row"), F.col("row").alias("__text"))
    mixed = mixed.agg(F.first("size").alias("__size"), F.first("source_size").alias("__source_size"), F.first("target").alias("__target"), F.sum("copies").cast("long").alias("__sum"), F.count(F.lit(1)).alias("__n")).filter("__sum > 0")
    id_, text, source = (F.col(f"`{c}`") for c in names)
    rows = docs.select("*", F.xxhash64(id_, source).alias("__row"), F.xxhash64(text).alias("__text")).join(mixed, keys)
    order = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("__copies", (F.expr("__sum div __n") + (number <= F.expr("__sum % __n")).cast("long")).cast("int")).filter("__copies > 0")
    added = ["size", "source_size", "target", "copy", "taken"]
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in added), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "__copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).withColumn("taken", F.col("size")).drop("__copies")
