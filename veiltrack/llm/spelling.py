"""Spelling variants: words of a corpus that one edit turns into a far more frequent one.

Words are counted over all texts, then joined on one edit by an index of
variable-length grams:

* The dictionary has the grams of ``SHORTEST`` to ``LONGEST`` code points that
  occur in many words.  It grows length by length, a gram only below a frequent
  one, and its size is bounded whatever the vocabulary: a gram is frequent from
  a share of all places on.
* A word is decomposed into a gram at each place: the shortest that is not
  frequent, or else the longest there is.
* An edit at a place, a *cut*, can affect only grams that contain it and those
  that would have gone on over it.  All others are shared by any word that the
  edit leads to, so their count bounds what two lists have in common, place by
  place: for each cut a word stands in one list alone, that of the rarest gram
  that the cut leaves, and merging a list brings together the words whose left
  grams all agree.  A cut that leaves no gram has a list by the remaining text.
* What comes together is verified: the texts left of and right of the cut are
  compared.  A group of words that agree in them are neighbours of each other,
  so a group is counted at once, without its pairs.

Owners of lists get a key range each.  A list that may be long, by its gram's
count, is dealt to several owners by the remaining text.

Defined results: null text has no words; null doc_id counts as an empty one in
the draw of runs; repeated rows count each; an empty table gives no rows; runs
and texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOCKS, FLUSH_KEYS, Packer, dealt, gathered, part_of, parts_of, shared_folder, stored
from .tokens import _BYTE, _LOWER, buffers, mix, slices, unmix, words

LEAST_LENGTH, LEAST_COUNT, EDIT_EVERY, TIMES = 7, 2, 31, 10
SHORTEST, LONGEST = 2, 6
#: Grams of a length that the dictionary holds at most, and the places from which a gram is frequent at least.
MOST_GRAMS, LEAST_PLACES = 1 << 14, 32
#: Words of a list that one owner gets at most, by what its gram's count allows.
LIST_WORDS = 200_000
#: Words that owners get, on average, and bytes that are compared together.
OWNER_WORDS, COMPARE_BYTES = 150_000, 1 << 24
_HELD_WORDS = 500_000

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RUN = np.zeros(256, bool)
_RUN[[*range(97, 123), *range(0x80, 0xC0), 0xC3]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 64) -> np.ndarray:
    """crc32 of texts that go on with data[start:end], from the crc32 of what is before."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    n, s = size[order], start[order]
    c = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    alive = np.searchsorted(-n, -np.arange(1, most + 1), side="right")  # how many have a byte at each step
    for step in range(min(most, int(n[0]) if len(n) else 0)):
        k = alive[step]
        c[:k] = _CRC[(c[:k] ^ data[s[:k] + step]) & 255] ^ (c[:k] >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > most).tolist():
        c[i] = zlib.crc32(data[s[i] + most : s[i] + n[i]].tobytes(), int(c[i]))
    out = np.empty_like(c)
    out[order] = c
    return out


def count_words(ids: pa.Array, texts: pa.Array, found: dict[bytes, int]) -> None:
    """Adds the words of texts to found, as UTF-8: runs of letters up to U+00FF in lower case, of which some lose a letter."""
    raw, at = buffers(texts)
    data = _LOWER[raw]
    before = np.concatenate((np.zeros(1, np.uint8), data[:-1])) if len(data) else data
    data[(data >= 0x80) & (data != 0xC3) & (before != 0xC3)] = 0x20  # of characters beyond U+00FF, or below U+00C0
    w = words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(data)]), _RUN)
    if not len(w.start):
        return
    heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else i.encode())) for i in ids.to_pylist()], np.uint32)
    draw = crc_after(heads[w.doc], data, w.start, w.end)
    later = np.concatenate(([0], np.cumsum((data >= 0x80) & (data < 0xC0))))  # bytes that go on a character
    size = w.end - w.start - (later[w.end] - later[w.start])
    edited = draw % EDIT_EVERY == 0
    plain = np.flatnonzero(~edited & (size >= LEAST_LENGTH))
    _, first, n = np.unique(w.hash[plain], return_index=True, return_counts=True)
    for i, k in zip(plain[first].tolist(), n.tolist()):
        own = w.bytes_of(i)
        found[own] = found.get(own, 0) + k
    for i in np.flatnonzero(edited & (size > LEAST_LENGTH)).tolist():
        run = w.bytes_of(i).decode()
        k = int(draw[i]) % len(run)
        own = (run[:k] + run[k + 1 :]).encode()
        found[own] = found.get(own, 0) + 1


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least LEAST_LENGTH code points and least_count occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for i, j in slices(batch.column(1)):
                count_words(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), found)
                if len(found) >= _HELD_WORDS:
                    yield rows()
        if found:
            yield rows()

    counts = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# The dictionary and the decomposition.  Words are rows of a matrix of bytes (Latin-1), all of one length.


def by_length(own: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in own of the words of each length, and their matrix."""
    size = np.array([len(x) for x in own], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = max(1, (1 << 22) // n)
        for i in range(0, len(at), step):
            yield at[i : i + step], np.frombuffer(b"".join(own[k] for k in at[i : i + step].tolist()), np.uint8).reshape(-1, n)


def gram_codes(matrix: np.ndarray, q: int) -> np.ndarray:
    """A number for the gram of q code points at each place, which has its bytes and its length."""
    n = matrix.shape[1] - q + 1
    out = np.zeros((len(matrix), max(n, 0)), np.uint64)
    for k in range(q if n > 0 else 0):
        out = out << _U(8) | matrix[:, k : k + n]
    return out << _U(4) | _U(q)


class Grams:
    """The frequent grams, sorted, with the number of places where each occurs; grams that aren't in it occur at fewer than ``least``."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, least: int):
        order = np.argsort(codes)
        self.codes, self.counts, self.least = codes[order], counts[order], least

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Places of grams, 0 for those that aren't frequent."""
        if not len(self.codes):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)


def decompose(matrix: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The gram at each place: its number, length and count (0 if it isn't frequent), and whether what follows it doesn't matter."""
    rows, n = matrix.shape
    places = max(n - SHORTEST + 1, 0)
    code = gram_codes(matrix, SHORTEST)
    size, count = np.full((rows, places), SHORTEST), grams.count(code)
    going = count > 0
    for q in range(SHORTEST + 1, LONGEST + 1):
        width = max(n - q + 1, 0)
        if not width or not going.any():
            break
        longer = gram_codes(matrix, q)
        own = grams.count(longer)
        on = going[:, :width]
        code[:, :width] = np.where(on, longer, code[:, :width])
        size[:, :width] = np.where(on, q, size[:, :width])
        count[:, :width] = np.where(on, own, count[:, :width])
        going = going & (np.arange(places) >= width)
        going[:, :width] |= on & (own > 0)
    return code, size, count, (count == 0) | (size == LONGEST)


def index_keys(matrix: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """The list of each word for each cut, and a digest of the grams that the cut leaves.

    Cuts 0 to n - 1 delete or replace a code point, n to 2 n insert one before
    a place or at the end.
    """
    rows, n = matrix.shape
    code, size, count, closed = decompose(matrix, grams)
    places = code.shape[1]
    at = np.arange(places, dtype=np.uint64)
    rank = np.minimum(count, (1 << 31) - 1).astype(np.uint64) << _U(32) | mix(code) >> _U(32)  # the rarest first
    # of grams that end before a cut and don't depend on it
    low, left = np.full((rows, n + 1), _NONE), np.zeros((rows, n + 1), np.uint64)
    own = mix(code ^ mix(at + _U(1)))
    for q in range(SHORTEST, LONGEST + 1):
        width = max(n - q + 1, 0)
        here = (size[:, :width] == q) & closed[:, :width]
        low[:, q : q + width] = np.minimum(low[:, q : q + width], np.where(here, rank[:, :width], _NONE))
        left[:, q : q + width] += np.where(here, own[:, :width], _U(0))
    low, left = np.minimum.accumulate(low, axis=1), np.cumsum(left, axis=1, dtype=np.uint64)
    # of grams that begin after it
    high, right = np.full((rows, n + 1), _NONE), np.zeros((rows, n + 1), np.uint64)
    high[:, :places], right[:, :places] = rank, mix(code ^ mix(_U(n) - at + _U(1 << 32)))
    high, right = np.minimum.accumulate(high[:, ::-1], axis=1)[:, ::-1], np.cumsum(right[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    best = np.concatenate((np.minimum(low[:, :n], high[:, 1:]), np.minimum(low, high)), axis=1)
    sums = np.concatenate((left[:, :n] + right[:, 1:], left + right), axis=1)
    place = np.concatenate((np.arange(n), np.arange(n + 1))).astype(np.uint64)
    length = np.repeat(np.array([n - 1, n], np.uint64), (n, n + 1))  # of what remains
    texts = remaining(matrix)
    spread = np.maximum(1, np.maximum((best >> _U(32)).astype(np.int64), grams.least) // LIST_WORDS)
    key = mix(best ^ mix(length + _U(1 << 40))) + mix(texts) % spread.astype(np.uint64)
    key = np.where(best == _NONE, texts, mix(key))
    return key, (mix(sums + mix(place)) >> _U(32)).astype(np.uint32)


def remaining(matrix: np.ndarray) -> np.ndarray:
    """A hash of the text that each cut leaves, with the place of the cut."""
    rows, n = matrix.shape
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _R))))
    terms = _BYTE[0][matrix] * power[:n]
    total = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(terms, axis=1, out=total[:, 1:])
    after = total[:, -1:] - total
    place = mix(np.concatenate((np.arange(n), np.arange(n + 1))).astype(np.uint64) + _U(7))
    return mix(np.concatenate((total[:, :n] + after[:, 1:] * _R_INV, np.broadcast_to(total[:, -1:], (rows, n + 1))), axis=1) ^ place)


def frequent_grams(words_: DataFrame, parts: int) -> Grams:
    """The dictionary of a vocabulary, length by length; its size is bounded, so it goes to the driver."""
    spark = words_.sparkSession
    codes, counts, least = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    for q in range(SHORTEST, LONGEST + 1):
        have = spark.sparkContext.broadcast(Grams(codes, counts, least))

        def tallied(batches: Iterator[pa.RecordBatch], q=q, have=have) -> Iterator[pa.RecordBatch]:
            packer = Packer(parts, FLUSH_KEYS)
            for batch in batches:
                for _, matrix in by_length([x.encode("latin-1") for x in batch.column(0).to_pylist()]):
                    code = gram_codes(matrix, q)
                    if q > SHORTEST:
                        code = code[have.value.count(gram_codes(matrix, q - 1)[:, : code.shape[1]]) > 0]
                    yield from packer.add(mix(code.ravel()))
            yield from packer.flush()

        def summed(batches: Iterator[pa.RecordBatch], q=q, least=least) -> Iterator[pa.RecordBatch]:
            part, keys, n = gathered(batches)
            at = np.flatnonzero(n >= max(least, LEAST_PLACES))
            if part is not None:
                total = pa.array([int(n.sum())] * (len(at) + 1), pa.int64())  # once with no gram, for the sum of all places
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[at], _U(0)).view(np.int64)), pa.array(np.append(n[at], 0)), total], names=["gram", "n", "total"])

        blocks = words_.select("word").mapInArrow(tallied, BLOCKS)
        table = dealt(blocks, parts).mapInArrow(summed, "gram long, n long, total long")
        if q == SHORTEST:  # at most 2 ** 16 of these
            rows = table.collect()
            least = max(LEAST_PLACES, -(-sum(r["total"] for r in rows if r["n"] == 0) // MOST_GRAMS))
        else:
            rows = table.filter(F.col("n") > 0).collect()
        rows = [r for r in rows if r["n"] >= least]
        codes = np.concatenate((codes, unmix(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))))
        counts = np.concatenate((counts, np.array([r["n"] for r in rows], np.int64)))
        if not rows:
            break
    return Grams(codes, counts, max(least, LEAST_PLACES))


# Lists and their owners

ENTRIES = "part int, key binary, word binary, n long, cuts binary, grams binary"
NEAR = "word string, n_near long, best_n long, best string"


def list_entries(words_: DataFrame, grams: Grams, parts: int) -> DataFrame:
    """A row for each word and owner: its cuts there, with the list and the digest of grams of each."""
    shared = words_.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = [x.encode("latin-1") for x in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            for at, matrix in by_length(own):
                key, digest = index_keys(matrix, shared.value)
                part = part_of(key, parts)
                order = np.argsort(part, axis=1, kind="stable")
                row = np.arange(len(at))[:, None]
                part = part[row, order]
                new = np.ones(part.shape, bool)
                new[:, 1:] = part[:, 1:] != part[:, :-1]
                first = np.flatnonzero(new.ravel())
                of = first // part.shape[1]

                def packed(values: np.ndarray) -> pa.Array:
                    flat = np.ascontiguousarray(values).ravel()
                    offsets = (np.append(first, flat.size) * flat.itemsize).astype(np.int32)
                    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

                columns = [pa.array(part.ravel()[first].astype(np.int32)), packed(key[row, order]), pa.array([own[at[k]] for k in of.tolist()], pa.binary()), pa.array(n[at[of]]), packed(order.astype(np.uint32)), packed(digest[row, order])]
                rows = pa.RecordBatch.from_arrays(columns, names=["part", "key", "word", "n", "cuts", "grams"])
                for i in range(0, rows.num_rows, 20_000):
                    yield rows.slice(i, 20_000)

    return words_.mapInArrow(run, ENTRIES)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Whether each of some sorted values is other than the one before."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return new


def _same(own: list[bytes], word: np.ndarray, place: np.ndarray, gap: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Groups, taken apart where the remaining texts differ: numbers of groups whose texts are all equal."""
    out = group.copy()
    leader = np.flatnonzero(_runs(group))[np.cumsum(_runs(group)) - 1]
    size = np.array([len(own[w]) for w in word.tolist()]) - ~gap
    wrong = size != size[leader]
    for m in np.unique(size).tolist():
        at = np.flatnonzero(size == m)
        for i in range(0, len(at), max(1, COMPARE_BYTES // max(m, 1))):
            some = at[i : i + max(1, COMPARE_BYTES // max(m, 1))]

            def texts(which: np.ndarray) -> np.ndarray:
                made = np.frombuffer(b"".join(own[word[k]] if gap[k] else own[word[k]][: place[k]] + own[word[k]][place[k] + 1 :] for k in which.tolist()), np.uint8)
                return made.reshape(len(which), -1)

            fits = some[~wrong[some]]
            if len(fits) and m:
                wrong[fits] = (texts(fits) != texts(leader[fits])).any(axis=1) | (place[fits] != place[leader[fits]])
    bad = np.unique(group[wrong])
    if len(bad):  # words that agree in their hashes alone
        free, seen = int(group.max()) + 1, {}
        for k in np.flatnonzero(np.isin(group, bad)).tolist():
            w, p = own[word[k]], int(place[k])
            out[k] = seen.setdefault((int(group[k]), p, w if gap[k] else w[:p] + w[p + 1 :]), free + len(seen))
    return out


def merge_lists(own: list[bytes], n: np.ndarray, word: np.ndarray, cut: np.ndarray, key: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cuts of words, by their lists: for each meeting the word, how many it met, and the one of largest n (ties: the first in order)."""
    size = np.array([len(x) for x in own], np.int64)
    gap = cut >= size[word]
    place = np.where(gap, cut - size[word], cut)
    # candidates share a list, the place of the cut, and all grams that it leaves
    meets = mix(key ^ mix(digest.astype(np.uint64) << _U(24) | place.astype(np.uint64) & _U(0xFFFFFF)))
    order = np.argsort(meets, kind="stable")
    new = _runs(meets[order])
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    at = order[several]
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    word, place, gap, meets = word[at], place[at], gap[at], meets[at]
    # of those, the ones that leave the same text
    left = np.empty(len(at), np.uint64)
    for some, matrix in by_length([own[w] for w in word.tolist()]):
        width = matrix.shape[1]
        left[some] = _left_hash(matrix, np.where(gap[some], width + place[some], place[some]))
    group = mix(meets ^ left)
    order = np.argsort(group, kind="stable")
    word, place, gap, group = word[order], place[order], gap[order], np.cumsum(_runs(group[order])) - 1
    several = np.bincount(group)[group] > 1
    word, place, gap, group = word[several], place[several], gap[several], group[several]
    if not len(word):
        return (np.empty(0, np.int64),) * 3
    group = _same(own, word, place, gap, group)

    alphabetical = np.empty(len(own), np.int64)
    alphabetical[np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)] = np.arange(len(own))
    # words that lose a code point for the same text; those that lose it at the first of equal ones also meet the text itself
    first = ~gap & np.array([g or p == 0 or own[w][p] != own[w][p - 1] for w, p, g in zip(word.tolist(), place.tolist(), gap.tolist())], bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best_two(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members ordered by group, n and alphabet; where each one's group begins, and how many it has."""
        m = members[np.lexsort((alphabetical[word[members]], -n[word[members]], group[members]))]
        begin = _runs(group[m])
        number = np.cumsum(begin) - 1
        return m, np.flatnonzero(begin)[number] if len(m) else number, np.bincount(number)[number] if len(m) else number

    m, start, count = best_two(np.flatnonzero(~gap))
    of = np.flatnonzero(count > 1)
    best = np.where(of == start[of], start[of] + 1, start[of])
    out.append((word[m[of]], count[of] - 1, word[m[best]]))
    texts = np.flatnonzero(gap)
    texts = texts[np.argsort(group[texts], kind="stable")]
    m, start, count = best_two(np.flatnonzero(first))
    if len(texts) and len(m):
        at = np.minimum(np.searchsorted(group[texts], group[m]), len(texts) - 1)
        met = group[texts][at] == group[m]
        out.append((word[m[met]], np.ones(int(met.sum()), np.int64), word[texts[at[met]]]))
        top = np.flatnonzero(met & (np.arange(len(m)) == start))
        out.append((word[texts[at[top]]], count[top], word[m[top]]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _left_hash(matrix: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The hash of the text that one cut of each row leaves."""
    rows, n = matrix.shape
    place = np.where(cut >= n, n + 1, cut)[:, None]
    k = np.arange(n)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _R))))
    return mix(np.where(k == place, _U(0), _BYTE[1][matrix] * power[np.maximum(k - (k > place), 0)]).sum(axis=1, dtype=np.uint64))


def near_words(entries: DataFrame, parts: int) -> DataFrame:
    """word, n_near, best_n, best: how many words are one edit away, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, word, cut, key, digest = [], [], [], [], [], []
        for batch in batches:
            cuts = batch.column(4).to_pylist()
            word.append(np.repeat(np.arange(len(cuts)) + len(own), [len(c) // 4 for c in cuts]))
            cut.append(np.frombuffer(b"".join(cuts), np.uint32).astype(np.int64))
            key.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64))
            digest.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32))
            own += batch.column(2).to_pylist()
            n.append(batch.column(3).to_numpy())
        if not own:
            return
        n = np.concatenate(n)
        who, met, best = merge_lists(own, n, *(np.concatenate(x) for x in (word, cut, key, digest)))
        if not len(who):
            return
        order = np.lexsort((-n[best], who))
        begin = np.flatnonzero(_runs(who[order]))
        total = np.add.reduceat(met[order], begin)
        top: dict[int, bytes] = {}
        most = np.maximum.reduceat(n[best[order]], begin)
        ties = np.flatnonzero(n[best[order]] == np.repeat(most, np.diff(np.append(begin, len(order)))))
        for k in order[ties].tolist():
            w, b = int(who[k]), own[best[k]]
            if w not in top or b < top[w]:
                top[w] = b
        ids = who[order][begin].tolist()
        text = lambda x: x.decode("latin-1")
        rows = pa.RecordBatch.from_arrays([pa.array([text(own[w]) for w in ids]), pa.array(total), pa.array(most), pa.array([text(top[w]) for w in ids])], names=["word", "n_near", "best_n", "best"])
        for i in range(0, rows.num_rows, 20_000):
            yield rows.slice(i, 20_000)

    met = dealt(entries, parts).mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def group_variants(docs: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n, n_near, form, form_n, root: form is the most frequent word one edit away, if it is times as frequent; root follows forms to the last."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "spelling")
    known = stored(vocabulary(docs, least_count), folder, "words")
    size = known.agg(F.count(F.lit(1)), F.max("n")).first()
    parts = max(parts_of(known), min(-(-size[0] // OWNER_WORDS), 1 << 15))
    grams = frequent_grams(known, parts)
    near = stored(near_words(list_entries(known, grams, parts), parts), folder, "near")
    rows = known.join(near, "word", "left")
    fits = F.col("best_n") >= times * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), folder, "forms")
    # each step along forms is times as frequent, so few doublings reach the last
    steps = math.log(max(size[1] or 1, 1), max(times, 2)) + 1
    roots = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for k in range(max(1, math.ceil(math.log2(steps)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("__further", "root").alias("root")), folder, f"roots{k}")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
