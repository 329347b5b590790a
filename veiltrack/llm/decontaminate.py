"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over all token windows.

Words are runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters.  A
benchmark item's windows are its runs of ``n`` words; an item of fewer words,
but not none, is one window.  Workers slide a hash over each document's words,
look it up in the set, and compare the words of every hit, so an equal hash of
other words counts for nothing.

The set is broadcast only while the benchmark's text, measured first, is at
most ``broadcast_bytes``.  The windows of a larger one are dealt by hash to
owner tasks, which keep sorted hash arrays, and the words behind them, on
shared files.  Workers map the arrays, look up a slice's distinct hashes in
order, and read the words of a hash only when it is hit.

Defined results: null text has no words, and a document without words has no
hits; texts of any length are scanned whole; an item without words, or whose
item_id is null, is in no result; rows of one item_id count as one item;
repeated rows and ids of documents are judged row by row; empty tables give no
hits or no rows; columns of documents keep their names and values, but may not
be called ``__text``, ``__n_words``, ``__n_hit``, ``__spans`` or ``__item_ids``.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Mapped, find, owned, part_of, parts_of, save, shared_folder
from .tokens import ALNUM_WORDS, rolling, slices, words

N_WORDS = 13
BROADCAST_BYTES = 8 << 20
#: A document is contaminated if a word is hit, and at least one in so many.
ONE_IN = 20


def _windows(ids: list, texts: pa.Array, n: int) -> Iterator[tuple[int, int, bytes, str]]:
    """(size, hash, words, item) of every window of the items."""
    w = words(texts, ALNUM_WORDS, lower=True)
    lower = w.data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    for i, item in enumerate(ids):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        size = min(n, hi - lo)
        if item is None or not size:
            continue
        own = [lower[w.start[k] : w.end[k]].tobytes() for k in range(lo, hi)]
        for k, h in enumerate(rolling(w.hash[lo:hi], size).tolist()):
            yield size, h, b" ".join(own[k : k + size]), str(item)


class _Broadcast:
    """The set in memory: for each size a bitmap, sorted hashes, and for each hash its windows: the words and who has them."""

    def __init__(self, windows: Iterator[tuple[int, int, bytes, str]]):
        found: dict[int, dict[int, dict[bytes, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for size, h, own, item in windows:
            found[size][h][own].add(item)
        self.sizes = {}
        for size, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            bits = np.zeros(1 << 16, bool)
            bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.sizes[size] = (bits, keys, [dict(by_hash[int(k)]) for k in keys])

    def hits(self, h: np.ndarray, size: int) -> Iterator[tuple[int, dict[bytes, set]]]:
        """Places in h whose hash the set has, with the windows of that hash."""
        bits, keys, held = self.sizes[size]
        at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        same = keys[k] == h[at]
        for a, j in zip(at[same].tolist(), k[same].tolist()):
            yield a, held[j]


class _OnFiles:
    """The set as sorted hash arrays on shared files; windows of a hash are read when it is hit.  Hashes of all sizes stand together, as they depend on the size."""

    def __init__(self, folder: str, parts: int, sizes: list[int]):
        self.sizes = dict.fromkeys(sizes)
        self.keys, self.at, self.rows = Mapped(folder, "keys", parts, np.uint64), Mapped(folder, "at", parts, np.int64), Mapped(folder, "rows", parts, np.uint8)

    def hits(self, h: np.ndarray, size: int) -> Iterator[tuple[int, dict[bytes, set]]]:
        keys, back = np.unique(h, return_inverse=True)
        part, at = find(keys, self.keys)
        held: dict[int, dict[bytes, set]] = {}
        for a in np.flatnonzero((at >= 0)[back]).tolist():
            i = int(back[a])
            if i not in held:
                p, k = int(part[i]), int(at[i])
                held[i] = pickle.loads(self.rows[p][self.at[p][k] : self.at[p][k + 1]].tobytes())
            yield a, held[i]


def _scan(texts: pa.Array, index: _Broadcast | _OnFiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set]]:
    """First word of each text, word starts and ends, which words are hit, and the items of each text."""
    w = words(texts, ALNUM_WORDS, lower=True)
    total = len(w.hash)
    hit, items = np.zeros(total, bool), defaultdict(set)
    for size in index.sizes:
        if total < size:
            continue
        for a, held in index.hits(rolling(w.hash, size), size):
            doc = int(np.searchsorted(w.first, a, side="right")) - 1
            if a + size > w.first[doc + 1]:
                continue
            own = b" ".join(w.data[w.start[x] : w.end[x]].tobytes().lower() for x in range(a, a + size))
            if (who := held.get(own)) is not None:
                hit[a : a + size] = True
                items[doc] |= who
    return w.first, w.start, w.end, hit, items


def _index(benchmark: DataFrame, n: int, broadcast_bytes: int):
    """A function that gives workers the set."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= broadcast_bytes:
        rows = items.toArrow()
        held = spark.sparkContext.broadcast(_Broadcast(_windows(rows.column(0).to_pylist(), rows.column(1).combine_chunks(), n)))
        return lambda: held.value
    folder, parts = shared_folder(spark, "ngrams"), parts_of(items)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                found = list(_windows(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo), n))
                if found:
                    size, h, own, item = zip(*found)
                    keys = np.array(h, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(part_of(keys, parts).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(size, pa.int32()), pa.array(own, pa.binary()), pa.array(item, pa.string())], names=["part", "hash", "size", "words", "item"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes, found = None, set(), defaultdict(lambda: defaultdict(set))
        for batch in batches:
            for part, h, size, own, item in zip(*(c.to_pylist() for c in batch.columns)):
                sizes.add(size)
                found[h & 0xFFFFFFFFFFFFFFFF][own].add(item)
        if part is not None:
            keys = sorted(found)
            rows = [pickle.dumps(dict(found[k])) for k in keys]
            save(folder, "keys", part, np.array(keys, np.uint64))
            save(folder, "at", part, np.concatenate(([0], np.cumsum([len(r) for r in rows]))))
            save(folder, "rows", part, np.frombuffer(b"".join(rows), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["sizes"])

    made = owned(items.mapInArrow(deal, "part int, hash long, size int, words binary, item string"), parts, keep, "sizes array<int>", folder, "keys", "at", "rows")
    sizes = sorted({x for row in made for x in row[0]})  # n at most
    return lambda: _OnFiles(folder, parts, sizes)


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with n_words, n_hit, spans (words and UTF-8 bytes, end exclusive) and item_ids (sorted as strings) under the names __n_words, __n_hit, __spans, __item_ids."""
    keep = list(docs.columns if keep is None else keep)
    index_of = _index(benchmark, n, broadcast_bytes)
    # the text is sent once: among the columns that stay, or besides them
    besides = [] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *besides)
    at, stay = keep.index(text_col) if text_col in keep else len(keep), len(keep)
    fields = "__n_words long, __n_hit long, __spans array<struct<first:long,end:long,first_byte:long,end_byte:long>>, __item_ids array<string>"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:stay]), fields])
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                first, start, end, hit, items = _scan(part.column(at), index)
                sums = np.concatenate(([0], np.cumsum(hit)))
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                spans: list[list] = [[] for _ in range(len(part))]
                base = np.concatenate(([0], np.cumsum([0 if x is None else x for x in pa.compute.binary_length(part.column(at)).to_pylist()])))
                for d in items:
                    a, b = int(first[d]), int(first[d + 1])
                    s = np.flatnonzero((edge[a:b] == 1) | ((np.arange(a, b) == a) & hit[a:b])) + a
                    for x in s.tolist():
                        y = x
                        while y < b and hit[y]:
                            y += 1
                        spans[d].append({"first": x - a, "end": y - a, "first_byte": int(start[x] - base[d]), "end_byte": int(end[y - 1] - base[d])})
                made = [pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(spans, span), pa.array([sorted(items.get(d, ())) for d in range(len(part))], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:stay], *made], names=[*part.schema.names[:stay], "__n_words", "__n_hit", "__spans", "__item_ids"])

    return rows.mapInArrow(scan, schema)


def is_contaminated(n_hit, n_words):
    """The rule on columns: a word is hit, and at least one in ONE_IN."""
    return (n_hit > 0) & (n_hit * ONE_IN >= n_words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated for each row of docs."""
    found = scan_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n, "text", broadcast_bytes, keep=["doc_id"])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__item_ids").cast("long").alias("n_items"), F.col("__item_ids").alias("item_ids"), F.col("__spans").alias("spans"), is_contaminated(F.col("__n_hit"), F.col("__n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, all columns, without the contaminated ones."""
    found = scan_documents(docs, benchmark, n, text_col, broadcast_bytes)
    return found.filter(~is_contaminated(F.col("__n_hit"), F.col("__n_words"))).select([F.col(f"`{c}`") for c in docs.columns])


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, all columns, with every hit span cut out of the text (from a span's first byte to its last); null stays null."""
    found = scan_documents(docs, benchmark, n, text_col, broadcast_bytes)
    raw = F.col(f"`{text_col}`").cast("binary")
    cut = F.aggregate(
        F.reverse("__spans"), F.struct(F.lit(None).cast("binary").alias("tail"), F.octet_length(F.col(f"`{text_col}`")).cast("long").alias("until")),
        lambda acc, s: F.struct(F.concat(F.substring(raw, (s["end_byte"] + 1).cast("int"), (acc["until"] - s["end_byte"]).cast("int")), F.coalesce(acc["tail"], F.lit(b""))).alias("tail"), s["first_byte"].alias("until")),
        lambda acc: F.concat(F.substring(raw, F.lit(1), acc["until"].cast("int")), F.coalesce(acc["tail"], F.lit(b""))).cast("string"),
    )
    return found.withColumn(text_col, F.when(F.col("__n_hit") > 0, cut).otherwise(F.col(f"`{text_col}`"))).select([F.col(f"`{c}`") for c in docs.columns])
