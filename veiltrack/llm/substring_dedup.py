"""Substring dedup by recompression.

Rounds rewrite every text's words: maximal runs of one symbol get a name, then
adjacent symbols (a, b) with a in the left and b in the right half of the
alphabet (a bit of their hash, another one each round) get a name.  Names are
64-bit hashes of what they stand for, so they are global without a table:
wherever the same words stand, the symbols inside them are the same, but for
those whose making depended on words outside.  For each symbol the stretch of
words that decided it is kept.

1. Symbols decided within ``window`` words are counted over the corpus: packed
   blocks of hashes go to the owner of their key range, which keeps those that
   occur twice or more as a sorted array on shared files.
2. A window can repeat only if every symbol decided inside it repeats.  The
   windows that pass (and those that hold no such symbol) are verified: they
   are counted in the same way by two 64-bit hashes, each of its own hashes of
   the words, which have no number in common.
3. Each document's windows are looked up, and the words they cover go.

Everything is a map over documents and an exchange by uniform hashes; a group
of copies is summed in each task before it is sent.  No window is dropped or
sampled.

Defined results: null text has no words; a text of fewer words than a window
keeps all; texts of any length are worked on whole, one of more than a slice
by itself; rows are judged one by one, so a repeated row repeats all its
windows; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOCKS, FLUSH_KEYS, Mapped, Packer, find, gathered, owned, part_of, parts_of, save, shared_folder
from .tokens import Words, mix, rolling, slices, windows, words

WINDOW = 35
ROUNDS = 6
#: Rounds that name runs before pairs.
RUN_ROUNDS = (0, 3)

_U = np.uint64
_FAR = np.int64(1) << np.int64(60)


def recompress(w: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, with the first word and the end of the stretch that decided each; a stretch that reaches over a text's edge is unbounded there."""
    sym, n = w.hash, len(w.hash)
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    opens = np.zeros(n, bool)
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    for r in range(rounds):
        if len(sym) < 2:
            break
        if r in RUN_ROUNDS:
            starts = opens.copy()
            starts[1:] |= sym[1:] != sym[:-1]
            at = np.flatnonzero(starts)
            size = np.diff(np.append(at, len(sym)))
            # a run is as long as it is because of its neighbours: all that decided those counts
            new_lo, new_hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            edge, before, after = opens[at[1:]], at[1:] - 1, at[1:]
            for mine, near in ((slice(1, None), before), (slice(None, -1), after)):
                new_lo[mine] = np.minimum(new_lo[mine], np.where(edge, new_lo[mine], lo[near]))
                new_hi[mine] = np.maximum(new_hi[mine], np.where(edge, new_hi[mine], hi[near]))
            new_lo[0], new_hi[-1] = -_FAR, _FAR
            new_lo[1:][edge], new_hi[:-1][edge] = -_FAR, _FAR
            many = size > 1
            sym = sym[at].copy()
            sym[many] = mix(sym[many] + size[many].astype(np.uint64) * _U(0xA24BAED4963EE407))
            lo, hi, opens = new_lo, new_hi, opens[at]
            if len(sym) < 2:
                break
        right_half = (mix(sym + _U(0x632BE59BD9B4E019 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) & _U(1)).astype(bool)
        pair = np.zeros(len(sym), bool)  # of its first element
        pair[:-1] = ~right_half[:-1] & right_half[1:] & ~opens[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        alone = ~pair & ~second
        new_lo, new_hi = lo.copy(), hi.copy()
        # left out of a pair: it depended on the neighbour it could have had
        a = np.flatnonzero(alone & ~right_half)
        b = np.minimum(a + 1, len(sym) - 1)
        edge = (a + 1 >= len(sym)) | opens[b]
        new_hi[a] = np.where(edge, _FAR, np.maximum(hi[a], hi[b]))
        new_lo[a] = np.where(edge, lo[a], np.minimum(lo[a], lo[b]))
        a = np.flatnonzero(alone & right_half)
        b = np.maximum(a - 1, 0)
        edge = opens[a]
        new_lo[a] = np.where(edge, -_FAR, np.minimum(new_lo[a], lo[b]))
        new_hi[a] = np.where(edge, hi[a], np.maximum(hi[a], hi[b]))
        a = np.flatnonzero(pair)
        new_lo[a] = np.minimum(lo[a], lo[a + 1])
        new_hi[a] = np.maximum(hi[a], hi[a + 1])
        sym = sym.copy()
        sym[a] = mix(sym[a] * _U(0x9FB21C651E98DF25) + mix(sym[a + 1] + _U(r)))
        keep = ~second
        sym, lo, hi, opens = sym[keep], new_lo[keep], new_hi[keep], opens[keep]
    return sym, lo, hi


def _inside(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that a window can decide."""
    sym, lo, hi = recompress(w)
    ok = hi - lo <= window
    return sym[ok], lo[ok], hi[ok]


def _candidates(w: Words, shared: Mapped, window: int) -> np.ndarray:
    """First words of the windows that may repeat."""
    may = windows(w.first, window, len(w.hash))
    if not may.any():
        return np.empty(0, np.int64)
    sym, lo, hi = _inside(w, window)
    keys, back = np.unique(sym, return_inverse=True)
    alone = (find(keys, shared)[1] < 0)[back]
    change = np.zeros(len(may) + 1, np.int32)
    np.add.at(change, np.clip(hi[alone] - window, 0, len(may)), 1)
    np.add.at(change, np.clip(lo[alone] + 1, 0, len(may)), -1)
    return np.flatnonzero(may & (np.cumsum(change[:-1]) == 0))


class _PairPacker:
    """Packs 128-bit hashes as a Packer does; one that a task saw more than once is sent twice."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(_twice(a, b))
        self.n += len(self.held[-1][0])
        if self.n >= FLUSH_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        a, b = _twice(np.concatenate([x for x, _ in self.held]), np.concatenate([x for _, x in self.held]))
        self.held, self.n = [], 0
        cut = np.searchsorted(part_of(a, self.parts), np.arange(self.parts + 1))
        rows = [(p, a[i:j].tobytes(), b[i:j].tobytes()) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])


def _twice(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each at most twice."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    third = same.copy()
    third[1:] &= same[:-1]
    return a[~third], b[~third]


def _repeated(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    part, held, n = None, [], 0
    for batch in batches:
        for p, a, b in zip(*(batch.column(i) for i in range(3))):
            part = p.as_py()
            held.append((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)))
            n += len(held[-1][0])
            if n > FLUSH_KEYS and n > 2 * len(held[0][0]):
                held = [_twice(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                n = len(held[0][0])
    if not held:
        return part, np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = _twice(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return part, a[again], b[again]


def _found(a: np.ndarray, b: np.ndarray, one: Mapped, two: Mapped) -> np.ndarray:
    """Which pairs are in the sorted array of pairs."""
    keys, back = np.unique(a, return_inverse=True)
    part, at = find(keys, one)
    part, at = part[back], at[back]
    hit = np.zeros(len(a), bool)
    open_ = np.flatnonzero(at >= 0)
    step = 0
    open_ = open_[np.argsort(part[open_], kind="stable")]
    while len(open_):  # equal first halves stand together
        still = []
        for own in np.split(open_, np.flatnonzero(np.diff(part[open_])) + 1):
            p = part[own[0]]
            x, y = one[int(p)], two[int(p)]
            k = at[own] + step
            there = (k < len(x)) & (x[np.minimum(k, len(x) - 1)] == a[own])
            same = there & (y[np.minimum(k, len(y) - 1)] == b[own])
            hit[own[same]] = True
            still.append(own[there & ~same])
        open_, step = np.concatenate(still), step + 1
    return hit


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text (the kept words, joined by one space)."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).alias("text"))
    parts, folder = parts_of(text), shared_folder(spark, "repeats")
    shared = Mapped(folder, "symbols", parts, np.uint64)
    one, two = Mapped(folder, "windows1", parts, np.uint64), Mapped(folder, "windows2", parts, np.uint64)

    def name_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                yield from packer.add(_inside(words(batch.column(0).slice(lo, hi - lo)), window)[0])
        yield from packer.flush()

    def keep_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = gathered(batches)
        if part is not None:
            save(folder, "symbols", part, keys[counts > 1])
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 1).sum())])], names=["n"])

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _PairPacker(parts)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                w = words(batch.column(0).slice(lo, hi - lo), second=True)
                at = _candidates(w, shared, window)
                if len(at):
                    yield from packer.add(rolling(w.hash, window)[at], rolling(w.other, window, 1)[at])
        yield from packer.flush()

    def keep_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, a, b = _repeated(batches)
        if part is not None:
            save(folder, "windows1", part, a)
            save(folder, "windows2", part, b)
            yield pa.RecordBatch.from_arrays([pa.array([len(a)])], names=["n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                w = words(part.column(1), second=True)
                gone = np.zeros(len(w.hash) + 1, np.int32)
                at = np.flatnonzero(windows(w.first, window, len(w.hash)))
                if len(at):
                    at = at[_found(rolling(w.hash, window)[at], rolling(w.other, window, 1)[at], one, two)]
                    gone[at] += 1
                    gone[at + window] -= 1  # window ends are distinct, as their starts are
                kept = np.cumsum(gone[:-1]) == 0
                sums = np.concatenate(([0], np.cumsum(~kept)))
                removed = sums[w.first[1:]] - sums[w.first[:-1]]
                raw, out = w.data.tobytes(), []
                for d in range(len(part)):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if a == b:
                        out.append("")
                        continue
                    own = raw[w.start[a] : w.end[b - 1]].split()
                    out.append(b" ".join(compress(own, kept[a:b].tolist()) if removed[d] else own).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first)), pa.array(removed), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    owned(text.mapInArrow(name_symbols, BLOCKS), parts, keep_symbols, "n long", folder, "symbols")
    owned(text.mapInArrow(name_windows, BLOCKS), parts, keep_windows, "n long", folder, "windows1", "windows2")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.dtypes[0][1]}, n_words long, n_removed long, kept_text string")
