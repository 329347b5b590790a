"""Vectorised tokens over Arrow string arrays.

Words are runs of bytes outside a separator class; every word gets a 64-bit
content hash: the sum of its bytes' numbers, each times an odd number of its
own for the byte's place in the word.  On demand it gets a second one, from
numbers that have nothing in common with the first one's.  All work is done with NumPy on the UTF-8 bytes in pieces of
bounded size, so one very long text needs no more memory than many short ones
(apart from 24 bytes a word).  Separator classes hold ASCII bytes only, hence
bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together.
SLICE_BYTES = 1 << 20
_PIECE = 1 << 19

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Numbers of the bytes, for each of the two hashes.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _class(excluded: list[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[excluded] = False
    return out


#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = _class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, on text whose A-Z are lower case.
ALNUM_WORDS = _class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out, s = x.copy(), by
    while s < 64:
        out = x ^ (out >> _U(by))
        s += by
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = _unshift(x, 31)
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27)
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(x, 30)


_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, r: np.uint64 = _R, inv: np.uint64 = _R_INV) -> tuple[np.ndarray, np.ndarray]:
    """Powers of r and of its inverse, at least n of them."""
    have = _pow_cache.get(int(r))
    if have is None or len(have[0]) < n:
        size = max(1 << 19, 1 << int(n).bit_length())
        out = []
        for base in (r, inv):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _pow_cache[int(r)] = (out[0], out[1])
    return have


_places: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _place(n: int, which: int) -> np.ndarray:
    """Odd numbers of the first n places in a word, at least."""
    if len(_places[which]) < n:
        at = np.arange(1 << max(12, int(n).bit_length()), dtype=np.uint64)
        _places[which] = mix(mix(at + _U(0xC2B2AE3D27D4EB4F if which else 0x165667B19E3779F9))) | _U(1)
    return _places[which]


class Words(NamedTuple):
    """Words of several texts, in order: byte starts and ends in ``data``, hashes, each text's first word (n + 1 offsets), and second hashes where they were asked for."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    other: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or of one row."""
    _, at = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(texts: pa.Array, kind: np.ndarray = SPACE_WORDS, lower: bool = False, second: bool = False) -> Words:
    """The words of every text, with a hash that depends on the word's bytes only; ``second`` asks for two of them."""
    raw, at = buffers(texts)
    fold = _LOWER if lower else _SAME
    member = kind[fold]
    tables = [np.where(member, _BYTE[k][fold], _U(0)) for k in range(1 + second)]
    starts, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [[np.empty(0, np.uint64)] for _ in tables]
    cut = np.unique(at)
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(lo + _PIECE, n)
        if hi < n:  # a piece ends at a text's end or at a separator
            edge = cut[np.searchsorted(cut, hi, side="right") - 1]
            if edge > lo:
                hi = int(edge)
            else:
                gap = np.flatnonzero(~member[raw[lo:hi]])
                if len(gap):
                    hi = lo + int(gap[-1]) + 1
                else:
                    while hi < n and member[raw[hi]] and hi != cut[min(np.searchsorted(cut, hi), len(cut) - 1)]:
                        hi += 1
        piece = raw[lo:hi]
        is_word = np.zeros(hi - lo + 2, bool)
        is_word[1:-1] = member[piece]
        begins = is_word[1:-1] & ~is_word[:-2]
        stops = is_word[1:-1] & ~is_word[2:]
        inner = cut[np.searchsorted(cut, lo, side="right") : np.searchsorted(cut, hi)] - lo
        begins[inner] |= is_word[1:-1][inner]
        stops[inner - 1] |= is_word[1:-1][inner - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if len(b):
            step = np.ones(hi - lo, np.int32)  # a byte's place in its word, by a running sum that each start sets back
            step[0] = 0
            step[b[1:]] = 1 - np.diff(b)
            if b[0]:
                step[b[0]] = 1 - b[0]
            place = np.cumsum(step, dtype=np.int32)
            most = int(max((e - b).max(), np.diff(np.append(b, hi - lo)).max(), b[0]))
            starts.append(b + lo)
            ends.append(e + lo)
            for k, table in enumerate(tables):
                hashes[k].append(mix(np.add.reduceat(table[piece] * _place(most, k)[place], b)))  # separators count as 0
        lo = hi
    start = np.concatenate(starts)
    made = [np.concatenate(x) for x in hashes]
    return Words(raw, start, np.concatenate(ends), made[0], np.searchsorted(start, at), made[1] if second else None)


_R2 = _U(0xD6E8FEB86659FD93)
_ROLL = ((_R, _R_INV), (_R2, _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words (across texts, too); ``which`` chooses one of two functions."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    r, inv = _ROLL[which]
    out = np.empty(len(h) - n + 1, np.uint64)
    step = 1 << 18
    for lo in range(0, len(out), step):
        hi = min(lo + step, len(out))
        part = h[lo : hi + n - 1]
        power, inverse = _powers(len(part), r, inv)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[n:] - total[: len(part) - n + 1]) * inverse[: hi - lo] + _U(n))
    return out


def windows(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 runs of n words lie inside one text."""
    count = max(0, total - n + 1)
    ok = np.zeros(count, bool)
    if count:
        change = np.zeros(count + 1, np.int32)
        lo, hi = first[:-1], first[1:] - n + 1
        full = hi > lo
        np.add.at(change, lo[full], 1)
        np.add.at(change, hi[full], -1)
        ok = np.cumsum(change[:count]) > 0
    return ok
