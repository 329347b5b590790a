"""Language ID by prediction by partial matching.

Each language has a byte context tree of contexts up to ``order`` bytes, with
method C's escape probabilities: in a context seen n times before q distinct
bytes, a byte seen c times has c / (n + q), and the escape to the context
shorter by a byte q / (n + q); below the empty context all 256 bytes are equal.
Statistics are frozen, so a text's code length in a language is exact and does
not depend on other texts.  The language of the shortest code wins; the score
is its share among all, each weighing 2 ** -length.

The trees of some languages are laid over each other, as one table.  For each
byte that one of them has seen in a context a row holds its code length in
every one, escapes included; for all others a context's escapes are added, and
the shorter context is asked.  Workers do so for all bytes of a slice at once,
for one table after the other.  Code lengths are whole numbers of 2 ** -16
bits, and a language's tree depends on its own sample alone: how languages are
dealt to tables changes no prediction.

Training uses a bounded sample, the one bound here: about ``sample_docs``
distinct texts of each language, of those of at most ``most_bytes`` bytes, by a
hash of the text; of a language that has none so short, its shortest one.  With
many languages a language's share of ``MOST_SAMPLE`` texts is the bound.  More
than ``MOST_LANGUAGES`` labels are refused.  A context that a language's sample
has fewer than ``least_seen`` times is left out of its tree.  Spark counts a
language's bytes and lays its table in a task each; the driver gets numbers of
contexts only, and tables are files in the shared folder that workers
memory-map, of ``table_bytes`` each or of one language.  Whole texts are scored.

Defined results: null text, or text without a letter, is ``und`` with score 0,
as is everything if no language could be learned; null lang is not learned
from; equal code lengths go to the language that comes first; rows are judged
one by one; an empty table gives no rows; other columns keep their names and
values, but may not be called ``__letters``, ``__text``, ``__lang_pred``,
``__score`` or ``__bits``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import remainder
from .shared import shared_folder, stored, tally, tidy
from .tokens import buffers, slices

ORDER = 3
SAMPLE_DOCS = 250
MOST_BYTES = 16_384
MOST_LANGUAGES = 1000
#: Texts of all languages together that are learned from.
MOST_SAMPLE = 10_000
#: Contexts that a language's sample has less often are left out of its tree.
LEAST_SEEN = 2
#: Of a table of several languages, and their number.
TABLE_BYTES, MOST_TOGETHER = 64 << 20, 16
#: Bytes that are counted at once.
PIECE = 4 << 20
#: Code lengths are counted in this part of a bit.
UNIT = 1 << 16
UNKNOWN = "und"


class Trees(NamedTuple):
    """symbol: a byte's number, 0 for bytes not seen; child[context, byte before]: the longer context or -1; parent: the shorter one; cell[context, symbol]: row of cost or -1; cost[row, language] and escape[context, language] in units."""

    languages: list[str]
    order: int
    symbol: np.ndarray
    child: np.ndarray
    parent: np.ndarray
    cell: np.ndarray
    cost: np.ndarray
    escape: np.ndarray


class Model(NamedTuple):
    """All languages in order; the files of their tables, and the languages of each."""

    languages: list[str]
    files: list[tuple[str, list[str]]]


Grams = list[tuple[np.ndarray, np.ndarray]]  # by length of the context: context and byte after it as one number, how often


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """lang, text: about sample_docs distinct texts of each language."""
    rows = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.xxhash64("text")).withColumn("short", F.octet_length("text") <= most_bytes)
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("short"), F.col("draw"))).alias("n"), F.min(F.octet_length("text")).alias("least"))
    found = found.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    each = min(sample_docs, MOST_SAMPLE // max(1, len(found)))
    share = rows.sparkSession.createDataFrame([(r["lang"], each / max(r["n"], 1), r["least"] if r["least"] > most_bytes else None) for r in found], "lang string, share double, least int")
    rows = rows.join(F.broadcast(share), "lang")
    drawn = rows.filter(F.col("short") & (F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) < F.col("share"))).dropDuplicates(["lang", "draw"]).select("lang", "text")
    if any(r["least"] > most_bytes for r in found):
        shortest = rows.filter(F.octet_length("text") == F.col("least")).groupBy("lang").agg(F.min(F.struct("draw", "text")).alias("t"))
        drawn = drawn.unionByName(shortest.select("lang", "t.text"))
    return drawn


def count_grams(texts: Iterable[bytes], order: int = ORDER, least_seen: int = LEAST_SEEN) -> Grams:
    """What a language's tree holds, from its texts; in memory are a piece of text and the distinct grams."""
    if not 0 <= order <= 6:
        raise ValueError("the order is 0 to 6")
    held: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
    sums = [(np.empty(0, np.int64), np.empty(0, np.int64))] * (order + 1)

    def settle() -> None:
        for d, made in enumerate(held):
            keys, n = tally(np.concatenate([np.empty(0, np.int64), *made]))
            sums[d] = tally(np.concatenate([sums[d][0], keys]), np.concatenate([sums[d][1], n]))
            made.clear()

    size = 0
    for text in texts:
        for lo in range(0, len(text), PIECE):
            before = min(order, lo)
            b = np.frombuffer(text[lo - before : lo + PIECE], np.uint8).astype(np.int64)
            for d in range(order + 1):
                first = max(before, d)
                if len(b) > first:
                    c = np.zeros(len(b) - first, np.int64)
                    for k in range(d, -1, -1):
                        c = c << 8 | b[first - k : len(b) - k]
                    held[d].append(c)
            size += len(b)
            if size >= PIECE:
                settle()
                size = 0
    settle()
    for d in range(1, order + 1):
        keys, n = sums[d]
        if len(keys):
            context = keys >> 8
            at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            stay = np.repeat(np.add.reduceat(n, at) >= least_seen, np.diff(np.append(at, len(keys))))
            sums[d] = keys[stay], n[stay]
    return sums


def overlay(counted: list[tuple[str, Grams]]) -> Trees:
    """The trees of some languages, each with its grams, as one table."""
    counted = sorted(counted, key=lambda x: x[0])
    n_lang, order = max(1, len(counted)), len(counted[0][1]) - 1 if counted else 0
    levels = []  # of each length: distinct grams, and how often each language has them
    for length in range(order + 1):
        keys = np.unique(np.concatenate([g[length][0] for _, g in counted]))
        seen = np.zeros((len(keys), n_lang), np.int64)
        for k, (_, g) in enumerate(counted):
            seen[np.searchsorted(keys, g[length][0]), k] = g[length][1]
        levels.append((keys, seen))
    used = levels[0][0] if levels else np.empty(0, np.int64)
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    contexts = [np.zeros(1, np.int64), *(np.unique(keys >> 8) for keys, _ in levels[1:])]
    starts = np.cumsum([0, *map(len, contexts)])
    total, width, cells = int(starts[-1]), len(used) + 1, sum(len(keys) for keys, _ in levels)
    child, cell, parent = np.full((total, width), -1, np.int32), np.full((total, width), -1, np.int32), np.full(total, -1, np.int32)
    cost, escape = np.empty((cells, n_lang), np.int32), np.zeros((total, n_lang), np.int32)
    units = lambda share: np.rint(-np.log2(share) * UNIT)
    filled = 0
    for length, (keys, seen) in enumerate(levels):
        own = contexts[length]
        which = np.searchsorted(own, keys >> 8)
        ids, s, rows = starts[length] + which, symbol[keys & 255], filled + np.arange(len(keys))
        cell[ids, s] = rows
        filled += len(keys)
        if length:
            up = starts[length - 1] + np.searchsorted(contexts[length - 1], own & (1 << 8 * (length - 1)) - 1)
            parent[starts[length] : starts[length + 1]] = up
            child[up, symbol[own >> 8 * (length - 1)]] = starts[length] + np.arange(len(own))
        if not len(keys):
            continue
        at = np.searchsorted(which, np.arange(len(own)))
        n, q = np.add.reduceat(seen, at), np.add.reduceat((seen > 0).astype(np.int64), at)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape[starts[length] : starts[length + 1]] = np.where(n > 0, units(q / (n + q)), 0)
            below = cost[cell[parent[ids], s]] if length else np.full((len(keys), n_lang), 8 * UNIT)
            cost[rows] = np.where(seen > 0, units(seen / (n + q)[which]), escape[ids] + below)
    return Trees([k for k, _ in counted], order, symbol, child, parent, cell, cost, escape)


def fit(texts: list[tuple[str, str]], order: int = ORDER, least_seen: int = LEAST_SEEN) -> Trees:
    """One table from (language, text) at hand."""
    return overlay([(k, count_grams((t.encode() for lang, t in texts if lang == k), order, least_seen)) for k in {k for k, _ in texts}])


_SHAPES = 5


def save(trees: Trees, path: str) -> None:
    """The table as one file of integers: its shapes, then its arrays."""
    shapes = [trees.order, *trees.cell.shape, *trees.cost.shape]
    flat = np.concatenate([np.array(shapes, np.int32), *(a.ravel() for a in trees[2:])])
    mine = f"{path}.{uuid.uuid4().hex}"
    with open(mine, "wb") as f:
        np.save(f, flat)
    os.replace(mine, path)


@lru_cache(maxsize=256)
def opened(path: str, *languages: str) -> Trees:
    """A saved table, memory-mapped."""
    flat = np.asarray(np.load(path, mmap_mode="r"))
    order, contexts, width, cells, n_lang = flat[:_SHAPES].tolist()
    shapes = [(256,), (contexts, width), (contexts,), (contexts, width), (cells, n_lang), (contexts, n_lang)]
    ends = np.cumsum([_SHAPES, *(int(np.prod(x)) for x in shapes)])
    return Trees(list(languages), order, *(flat[lo:hi].reshape(x) for lo, hi, x in zip(ends, ends[1:], shapes)))


def code_lengths(texts: pa.Array, trees: Trees) -> np.ndarray:
    """Bits of every text in every language of a table."""
    raw, at = buffers(texts)
    n = np.diff(at)
    out = np.zeros((len(n), len(trees.languages)))
    if not len(raw):
        return out
    order, width = trees.order, trees.child.shape[1]
    s = trees.symbol[raw]
    place = np.arange(len(raw)) + np.repeat((np.arange(len(n)) + 1) * order, n)
    padded = np.zeros(len(raw) + (len(n) + 1) * order, np.int64)  # symbol 0 is no context
    padded[place] = s
    node, alive = np.zeros(len(raw), np.int64), np.ones(len(raw), bool)
    child, cell = trees.child.ravel(), trees.cell.ravel()
    for d in range(1, order + 1):
        longer = child[node * width + padded[place - d]]
        alive &= longer >= 0
        node = np.where(alive, longer, node)
    row = cell[node * width + s]
    bits = trees.cost[row].astype(np.int64)  # where row is -1 it is put right below
    left = np.flatnonzero(row < 0)
    bits[left], here = 0, node[left]
    while len(left):  # up to the context that knows the byte
        row = cell[here * width + s[left]]
        known = row >= 0
        bits[left[known]] += trees.cost[row[known]]
        left, here = left[~known], here[~known]
        bits[left] += trees.escape[here]
        here = trees.parent[here]
        bits[left[here < 0]] += 8 * UNIT
        left, here = left[here >= 0], here[here >= 0]
    full = np.flatnonzero(n)
    out[full] = np.add.reduceat(bits, at[full]) / UNIT
    return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs (all by default) with __lang_pred, __score and __bits (the shortest code)."""
    keep = list(docs.columns if keep is None else keep)
    letters = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    # the text is sent once: among the columns that stay, or besides them
    besides = [] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]
    rows = docs.select(letters.alias("__letters"), *(F.col(f"`{c}`") for c in keep), *besides)
    at, stay = 1 + (keep.index(text_col) if text_col in keep else len(keep)), 1 + len(keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:stay]), "__lang_pred string, __score double, __bits double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(model.languages, object)
        tables = [opened(path, *own) for path, own in model.files]
        for batch in batches:
            for lo, hi in slices(batch.column(at), 1 << 19):
                part = batch.slice(lo, hi - lo)
                ok = part.column(0).to_numpy(zero_copy_only=False).astype(bool) & bool(tables)
                if tables:
                    bits = np.concatenate([code_lengths(part.column(at), t) for t in tables], axis=1)
                    best = bits.argmin(1)
                    least = bits.min(1)
                    share = 1 / np.exp2(least[:, None] - bits).sum(1)
                else:
                    best, least, share = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part))
                pred = [languages[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:stay], pa.array(pred, pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(least)], names=[*part.schema.names[1:stay], "__lang_pred", "__score", "__bits"])

    return rows.mapInArrow(predict, schema)


def _counted(order: int, least_seen: int) -> Callable[[pa.Table], pa.Table]:
    def count(texts: pa.Table) -> pa.Table:
        grams = count_grams((t.as_py().encode() for t in texts["text"]), order, least_seen)
        contexts = sum(len(np.unique(keys >> 8)) for keys, _ in grams)
        row = {"lang": texts["lang"][0].as_py(), "symbols": len(grams[0][0]), "contexts": contexts, "cells": sum(len(keys) for keys, _ in grams)}
        return pa.Table.from_pylist([{**row, "grams": [keys.tobytes() for keys, _ in grams], "counts": [n.tobytes() for _, n in grams]}], pa.schema([("lang", pa.string()), ("symbols", pa.int64()), ("contexts", pa.int64()), ("cells", pa.int64()), ("grams", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]))

    return count


def _dealt(found: list, table_bytes: int) -> list[list[str]]:
    """Languages in order, dealt to tables that stay within table_bytes, or hold one."""
    out, symbols, contexts, cells = [], 0, 0, 0
    for r in sorted(found, key=lambda r: r["lang"]):
        symbols, contexts, cells = min(256, symbols + r["symbols"]), contexts + r["contexts"], cells + r["cells"]
        if not out or len(out[-1]) == MOST_TOGETHER or contexts * (symbols + 1) * 8 + (cells + contexts) * (len(out[-1]) + 1) * 4 > table_bytes:
            out.append([])
            symbols, contexts, cells = r["symbols"], r["contexts"], r["cells"]
        out[-1].append(r["lang"])
    return out


def learn(docs: DataFrame, folds: int = 4, held: int = 2, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", least_seen: int = LEAST_SEEN, table_bytes: int | None = None) -> Model:
    """A model from the rows whose crc32 of doc_id is of another remainder than ``held``."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "languages")
    drawn = sample(docs.filter(remainder(F.col(id_col), folds) != held), sample_docs, most_bytes)
    # a group is a language's sample: of bounded size, or one text
    grams = drawn.groupBy("lang").applyInArrow(_counted(order, least_seen), "lang string, symbols long, contexts long, cells long, grams array<binary>, counts array<binary>")
    grams = stored(grams, folder, "grams")
    dealt = _dealt(grams.select("lang", "symbols", "contexts", "cells").collect(), table_bytes or TABLE_BYTES)
    if not dealt:
        return Model([], [])
    files = [(os.path.join(folder, f"table-{i}.npy"), own) for i, own in enumerate(dealt)]

    def lay(rows: pa.Table) -> pa.Table:
        i = rows["number"][0].as_py()
        numbers = lambda lists: [np.frombuffer(x, np.int64) for x in lists]
        save(overlay([(r["lang"], list(zip(numbers(r["grams"]), numbers(r["counts"])))) for r in rows.to_pylist()]), files[i][0])
        return pa.table({"number": pa.array([i], pa.int32())})

    number = spark.createDataFrame([(k, i) for i, own in enumerate(dealt) for k in own], "lang string, number int")
    with tidy(spark):
        made = grams.join(F.broadcast(number), "lang").groupBy("number").applyInArrow(lay, "number int").collect()
    if len(made) != len(files):
        raise OSError(f"{len(files)} tables of languages were to be written, {len(made)} were")
    return Model([k for own in dealt for k in own], files)


def predict_held_out(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for each row of docs."""
    model = learn(docs, folds, held, id_col=id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), folds) == held).alias("held_out"), "text")
    out = identify(rows, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits"))


def drop_unknown(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, without those whose language is ``und``."""
    return identify(docs, learn(docs, id_col=id_col)).filter(F.col("__lang_pred") != UNKNOWN).select([F.col(f"`{c}`") for c in docs.columns])
