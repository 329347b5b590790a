"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Words are lower-case runs of letters and digits.  Of every ``window``
consecutive k-word hashes of a template the least is kept, so any run of
k + window - 1 words that a document shares with it holds a kept one; of a
template of ``SHORT`` words or fewer all are kept.  The
inverted index, hash to (template, position), is broadcast: its size is that of
the templates, which are a parameter and bounded by ``MOST_WORDS``.

Workers look up all k-word hashes of a text.  Hits on nearby diagonals are one
candidate, and a local alignment in a band around them finds the words that match
(2 for a match, -1 for a word more, less or other).  It is reported if the
matched words cover enough of the template.  A copy so altered that no run of
k + window - 1 words of it is left (k words of a short template) is no candidate.  Of overlapping matches in one text
the one with more matched words counts, of equal ones that of the shorter template.

Defined results: null and empty texts have no matches; texts of any length are
scanned whole; a text that holds a template twice gives two matches; rows are
scanned one by one; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .tokens import ALNUM_WORDS, rolling, slices, words

K, WINDOW = 3, 3
#: Templates of so many words or fewer are indexed by all their k-word hashes.
SHORT = 30
BAND = 8
COVERAGE = 0.75
#: Words of all templates together; more of them are refused.
MOST_WORDS = 1_000_000

MATCH = "template string, coverage double, n_matched long, template_words long, first_word long, end_word long, first_byte long, end_byte long"


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the least hash of each window, the last one of equals; all of a shorter list's least."""
    kept: list[int] = []
    for lo in range(max(1, len(hashes) - window + 1)):
        part = hashes[lo : lo + window]
        if len(part):
            at = lo + len(part) - 1 - int(part[::-1].argmin())
            if not kept or kept[-1] != at:
                kept.append(at)
    return kept


def build_index(templates: Mapping[str, str], k: int = K, window: int = WINDOW) -> dict:
    """names, word hashes of each template, sorted fingerprints, and for each its (template, position)s."""
    names = sorted(templates)
    w = words(pa.array([templates[n] for n in names]), ALNUM_WORDS, lower=True)
    if len(w.hash) > MOST_WORDS:
        raise ValueError(f"templates have {len(w.hash)} words; at most {MOST_WORDS} are broadcast")
    own = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
    inverted: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, h in enumerate(own):
        grams = rolling(h, min(k, len(h))) if len(h) else h
        for at in (range(len(grams)) if len(h) <= SHORT else winnow(grams, window)) if len(h) >= k else []:
            inverted[int(grams[at])].append((t, at))
    keys = np.array(sorted(inverted), np.uint64)
    return {"names": names, "words": own, "keys": keys, "at": [inverted[int(x)] for x in keys], "k": k}


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and first and end word in text, of the best local alignment whose positions differ by diagonal, give or take the band."""
    m, n = len(template), len(text)
    width = 2 * band + 1
    score, ramp = np.zeros((m + 1, width + 2), np.int32), np.arange(width, dtype=np.int32)
    for i in range(1, m + 1):
        low = i + diagonal - band  # text position (from 1) of band column 1
        a, b = max(1, 2 - low), min(width, n - low + 1) + 1
        if a < b:
            same = text[low + a - 2 : low + b - 2] == template[i - 1]
            own = np.maximum(score[i - 1, a:b] + np.where(same, 2, -1), score[i - 1, a + 1 : b + 1] - 1)
            # text words alone, one a column: a running maximum of what stands further left
            score[i, a:b] = np.maximum.accumulate(np.maximum(own, 0) + ramp[: b - a]) - ramp[: b - a]
    i, c = (int(x) for x in np.unravel_index(score.argmax(), score.shape))
    matched, first, end = 0, 0, 0
    while i > 0 and score[i, c]:
        j = i + diagonal - band + c - 1
        same = template[i - 1] == text[j - 1]
        if score[i, c] == score[i - 1, c] + (2 if same else -1):
            if same:
                matched, first, end = matched + 1, j - 1, end or j
            i -= 1
        elif score[i, c] == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return matched, first, end


def _most(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> int:
    """Template words that stand anywhere in their part of the band: no alignment in it matches more."""
    there = np.zeros(len(template), bool)
    for d in range(diagonal - band, diagonal + band + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        if a < b:
            there[a:b] |= template[a:b] == text[a + d : b + d]
    return int(there.sum())


def _spread(diagonals: list[int], diagonal: int, band: int, reach: int) -> tuple[int, int]:
    """The diagonals around one that a copy may drift over: from hit to hit a band at most, and as far as words may be missing or added."""
    low = high = bisect_left(diagonals, diagonal)
    while high + 1 < len(diagonals) and diagonals[high + 1] - diagonals[high] <= band and diagonals[high + 1] - diagonal <= reach:
        high += 1
    while low > 0 and diagonals[low] - diagonals[low - 1] <= band and diagonal - diagonals[low - 1] <= reach:
        low -= 1
    return diagonals[low], diagonals[high]


def matches(text: np.ndarray, hits: list[tuple[int, int, int]], index: dict, coverage: float, band: int) -> list[tuple]:
    """(template, matched, first, end) of a text's word hashes and its hits (template, diagonal, position)."""
    found, done = [], defaultdict(list)
    times = Counter((t, diagonal) for t, diagonal, _ in hits)
    all_of = defaultdict(list)
    for t, diagonal in sorted(times):
        all_of[t].append(diagonal)
    for t, diagonal in sorted(times, key=lambda x: (-times[x], x)):
        own = index["words"][t]
        near = min(band, len(own) - 1)
        if any(lo - near <= diagonal <= hi + near for lo, hi in done[t]):
            continue  # the band around one with more hits holds it
        low, high = _spread(all_of[t], diagonal, band, int((1 - coverage) * len(own)))
        done[t].append((low, high))
        middle, wide = (low + high) // 2, band + (high - low + 1) // 2
        lo, hi = max(0, low - band), min(len(text), high + len(own) + band)
        start = max(0, diagonal)
        if np.array_equal(text[start : start + len(own)], own):
            matched, first, end = len(own), start, start + len(own)
        elif _most(own, text, middle, wide) < coverage * len(own):
            continue
        else:
            matched, first, end = align(own, text[lo:hi], middle - lo, wide)
            first, end = first + lo, end + lo
        if matched >= coverage * len(own):
            found.append((t, matched, first, end))
    kept: list[tuple] = []
    for t, matched, first, end in sorted(found, key=lambda x: (-x[1], len(index["words"][x[0]]), x[2], x[0])):
        if all(end <= a or first >= b for _, _, a, b in kept):
            kept.append((t, matched, first, end))
    return sorted(kept, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, k: int = K, window: int = WINDOW, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a match: doc_id, template, coverage, n_matched, template_words, and the span in words and UTF-8 bytes (ends exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(build_index(templates, k, window))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        names, keys = index["names"], index["keys"]
        bits = np.zeros(1 << 16, bool)
        bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                w = words(part.column(1), ALNUM_WORDS, lower=True)
                grams = rolling(w.hash, k)
                at = np.flatnonzero(bits[(grams & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, grams[at]), max(0, len(keys) - 1))
                same = keys[place] == grams[at] if len(keys) else np.zeros(len(at), bool)
                at, place = at[same], place[same]
                doc = np.searchsorted(w.first, at, side="right") - 1
                inside = at + k <= w.first[doc + 1]
                hits: dict[int, list] = defaultdict(list)
                for a, p, d in zip(at[inside].tolist(), place[inside].tolist(), doc[inside].tolist()):
                    own = a - int(w.first[d])
                    hits[d] += [(t, own - pos, own) for t, pos in index["at"][p]]
                if not hits:
                    continue
                lengths = [0 if x is None else x for x in pa.compute.binary_length(part.column(1)).to_pylist()]
                base = np.concatenate(([0], np.cumsum(lengths)))
                out = []
                for d, own in hits.items():
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    for t, n, first, end in matches(w.hash[a:b], own, index, coverage, band):
                        total = len(index["words"][t])
                        out.append((d, names[t], n / total, n, total, first, end, int(w.start[a + first] - base[d]), int(w.end[a + end - 1] - base[d])))
                if out:
                    columns = list(zip(*out))
                    kinds = [pa.string(), pa.float64(), *[pa.int64()] * 6]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0])), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=["doc_id", *(x.split()[0] for x in MATCH.split(", "))])

    return rows.mapInArrow(scan, f"doc_id {rows.dtypes[0][1]}, {MATCH}")
