"""LM scoring with an interpolated modified Kneser-Ney model of order three (or two).

Counting: tasks hash the words of their documents, sum the hashes, and send
packed blocks to the owner of each key range.  Owners write sorted hash arrays
with their counts to shared files: first the words, whose place in the sorted
order is their id, then the pairs of ids, whose key is a bijective hash of
(history id, word id).  From the distinct pairs come, by id range, each word's
continuation count and each history's total and numbers of followers seen
once, twice and oftener.  Everything is counted over all training documents.

Scoring: workers memory-map the arrays and look up the distinct words and
pairs of a slice of text in order.

    p(w | h) = max(c(h, w) - D(c), 0) / c(h) + gamma(h) * p(w)
    p(w)     = max(k(w) - D(k), 0) / K + lambda / (V + 1)

k counts the distinct words before w, K is their sum, V the number of distinct
tokens; one more stands for all unknown ones, so p sums to 1 over both.  D has
three values a level, from its counts of counts.

At order three a third level stands on these, and the middle one counts words
before a pair in place of the pair (but for pairs at the start of a text,
before which there is none):

    p(w | g, h) = max(c(g, h, w) - D(c), 0) / c(g, h) + gamma(g, h) * p(w | h)

A triple's key is a bijective hash of its first pair's place in the sorted
pairs, then the id of its word, so a history's triples stand side by side with
one owner.  A history's numbers are summed from its triples as they are looked
up; of histories with more than ``HEAVY`` triples they are stored.  Triples are
counted in ``ROUNDS`` rounds, each over all texts and a share of the histories,
so that a share's blocks are off the disk before the next one's come.  A text's
first token has a history of one.

Ids have 32 bits at most, and the bits of a pair's place and of an id are 64
together (4 billion distinct tokens with as many pairs; or 16 million with a
million million pairs); a corpus beyond that is refused.

Defined results: null text is empty, and its only token is the end; texts of
any length are scored whole; null doc_ids count as empty text in the split;
rows are scored one by one, repeated rows are counted each; without training
rows the scores are those of a model of unknown words only; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLOCKS, Mapped, Packer, dealt, find, gathered, owned, part_of, parts_of, save, seal, shared_folder, spread, squeeze, take, tidy
from .tokens import mix, slices, unmix, words

ORDER = 3
#: Rounds in which triples are counted, and the number of triples of a history above which its numbers are stored.
ROUNDS = 3
HEAVY = 32

#: Bytes of text whose words, pairs and triples are looked up together: a larger share of them repeats than in less text, and they stand closer in the tables.
TOGETHER_BYTES = 4 << 20

_U = np.uint64
_IDS = _U(0xFFFFFFFF)
#: The end of a text, as a word's hash.
_END = _U(0x5BD1E9955BD1E995)
#: Multiplier of _history.
_ODD = 0x9E3779B97F4A7C15
_STATS = "part int, ids binary, total binary, n1 binary, n2 binary, n3 binary, cont binary, summary array<long>"


class Model(NamedTuple):
    """Arrays on shared files and the numbers that go with them."""

    folder: str
    parts: int
    first_id: list[int]
    tokens: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float
    distinct_pairs: int
    order: int = 2
    rounds: int = ROUNDS
    first_pair: list[int] = []
    triple_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)

    def mapped(self, name: str, dtype) -> Mapped:
        return Mapped(self.folder, name, self.parts, dtype)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of a doc_id as text, by its remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return slices(texts, TOGETHER_BYTES)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end, and n + 1 offsets."""
    w = words(texts, lower=True)
    n = len(w.first) - 1
    at = w.first + np.arange(n + 1)
    out = np.empty(len(w.hash) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end], out[~is_end] = _END, w.hash
    return out, at


def _ids(tokens: np.ndarray, table: Mapped, first_id: np.ndarray) -> np.ndarray:
    """Ids of token hashes, -1 for unknown ones."""
    keys, back = np.unique(tokens, return_inverse=True)
    part, at = find(keys, table)
    return np.where(at >= 0, first_id[part] + at, -1)[back]


def _pairs(ids: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; a text's first token follows ``begin``."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[at[:-1]] = begin
    return before


def _key(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(before.astype(np.uint64) << _U(32) | ids.astype(np.uint64))


def _round(pair_keys: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which the triples of a history, by the pair's key, are counted."""
    return ((pair_keys & _IDS) * _U(rounds) >> _U(32)).astype(np.int64)


def _two_before(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The id before the one before each token; -1 for a text's first token."""
    out = np.empty(len(before), np.int64)
    out[1:] = before[:-1]
    out[at[:-1]] = -1
    return out


def _place_bits(pairs: int) -> int:
    """Bits of a pair's place in the sorted pairs; at least those by which parts are told apart."""
    return max(32, pairs.bit_length())


def _history(pair: np.ndarray, bits: int) -> np.ndarray:
    """The first key of a pair's triples: a hash of its place in the upper bits; odd multiples are a bijection."""
    return pair.astype(np.uint64) * _U(_ODD) << _U(64 - bits)


def _place(history: np.ndarray, bits: int) -> np.ndarray:
    return ((history >> _U(64 - bits)) * _U(pow(_ODD, -1, 1 << 64)) & _U((1 << bits) - 1)).astype(np.int64)


def _save_counts(folder: str, name: str, part: int, counts: np.ndarray) -> None:
    """Counts in a byte each; where they stand and what they are for those of 255 and more."""
    many = np.flatnonzero(counts >= 255)
    save(folder, name, part, np.minimum(counts, 255).astype(np.uint8))
    save(folder, f"{name}-at", part, many)
    save(folder, f"{name}-many", part, counts[many].astype(np.int64))


def _seal_counts(folder: str, name: str) -> None:
    for suffix in ("", "-at", "-many"):
        seal(folder, name + suffix)


class _Counts:
    """A worker's view of what _save_counts wrote."""

    def __init__(self, folder: str, name: str, parts: int):
        self.low, self.at, self.many = Mapped(folder, name, parts, np.uint8), Mapped(folder, f"{name}-at", parts, np.int64), Mapped(folder, f"{name}-many", parts, np.int64)

    def of(self, part: int, at: np.ndarray) -> np.ndarray:
        out = self.low[part][at].astype(np.int64)
        many = np.flatnonzero(out == 255)
        if len(many):
            out[many] = self.many[part][np.searchsorted(self.at[part], at[many])]
        return out

    def take(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """At places that find gave (parts rise); 0 where there is none."""
        out = np.zeros(len(at), np.int64)
        cut = np.searchsorted(part, np.arange(self.low.parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            own = at[cut[p] : cut[p + 1]]
            there = np.flatnonzero(own >= 0)
            if len(there):
                out[cut[p] + there] = self.of(int(p), own[there])
        return out


def _numbers(counts: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sum, and numbers of ones, twos and more, of each run of counts that starts at ``at``."""
    total, one, two = (np.add.reduceat(x, at, dtype=np.int64) for x in (counts, counts == 1, counts == 2))
    return [total, one, two, np.diff(np.append(at, len(counts))) - one - two]


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams seen once to four times; where those are too few, 0.5, 1 and 1.5."""
    plain = (0.5, 1.0, 1.5)
    if min(n) <= 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return tuple(d if 0 < d < k else plain[k - 1] for k, d in enumerate(found, 1))


def _discount(d: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(counts, 3)]


def train(docs: DataFrame, order: int = ORDER, rounds: int = ROUNDS) -> Model:
    """A model of all texts of docs (column text), of order two or three."""
    if order not in (2, 3):
        raise ValueError(f"order is {order}; it has to be 2 or 3")
    spark, text = docs.sparkSession, docs.select("text")
    parts, folder = parts_of(text), shared_folder(spark, "model")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                yield from packer.add(_tokens(batch.column(0).slice(lo, hi - lo))[0])
        yield from packer.flush()

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = gathered(batches)
        if part is not None:
            save(folder, "words", part, keys)
            save(folder, "counts", part, counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["part", "n", "total"])

    sizes = np.zeros(parts, np.int64)
    tokens = 0
    for part, n, total in owned(text.mapInArrow(count_words, BLOCKS), parts, keep_words, "part int, n long, total long", folder, "words", "counts"):
        sizes[part] = n
        tokens += total
    first_id = np.concatenate(([0], np.cumsum(sizes)))
    types = int(first_id[-1])
    if types >= (1 << 32) - 1:
        raise ValueError(f"{types} distinct tokens; ids have 32 bits")
    vocabulary, wide = Mapped(folder, "words", parts, np.uint64), -(-(types + 1) // parts)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                token, at = _tokens(batch.column(0).slice(lo, hi - lo))
                ids = _ids(token, vocabulary, first_id)
                yield from packer.add(_key(_pairs(ids, at, types), ids))
        yield from packer.flush()

    def blocks(ids: np.ndarray, columns: dict[str, np.ndarray], summary: list[int] | None = None) -> pa.RecordBatch:
        """Rows of _STATS for sorted ids: one for each id range."""
        cut = np.searchsorted(ids, np.arange(parts + 1) * wide)
        ranges = [(p, i, j) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        names = ["total", "n1", "n2", "n3", "cont"]
        made = [pa.array([p for p, _, _ in ranges], pa.int32()), pa.array([(ids[i:j] - p * wide).astype(np.uint32).tobytes() for p, i, j in ranges], pa.binary())]
        made += [pa.array([squeeze(columns[c][i:j]) if c in columns else None for _, i, j in ranges], pa.binary()) for c in names]
        made.append(pa.array([summary if k == 0 else None for k in range(len(ranges))], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(made, names=["part", "ids", *names, "summary"])

    def keep_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = gathered(batches)
        if part is None:
            return
        save(folder, "pairs", part, keys)
        if order == 2:
            yield from pair_stats(part, keys, counts)
        else:
            starts = np.flatnonzero((unmix(keys) >> _U(32)).astype(np.int64) == types)
            save(folder, "starts", part, starts)
            save(folder, "starts-seen", part, counts[starts])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)])], names=["part", "n"])

    def pair_stats(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Saves the counts of a part's pairs and gives what they add to the numbers of words."""
        _save_counts(folder, "pair-counts", part, counts)
        both = unmix(keys)
        before, after = (both >> _U(32)).astype(np.int64), (both & _IDS).astype(np.int64)
        del both
        order = np.argsort(before, kind="stable")
        before, own = before[order], counts[order]
        at = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        yield blocks(before[at], dict(zip(("total", "n1", "n2", "n3"), _numbers(own, at))), [*_counts_of_counts(counts), len(keys)])
        after.sort()
        at = np.flatnonzero(np.concatenate(([True], after[1:] != after[:-1])))
        yield blocks(after[at], {"cont": np.diff(np.append(at, len(after)))})

    def keep_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, summary = None, {}, np.zeros(5, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                ids = np.frombuffer(row["ids"], np.uint32).astype(np.int64)
                for name in ("total", "n1", "n2", "n3", "cont"):
                    if row[name] is not None:
                        sums.setdefault(name, np.zeros(wide, np.int64))[ids] += spread(row[name])
                if row["summary"]:
                    summary += np.array(row["summary"])
        if part is None:
            return
        for name in ("total", "n1", "n2", "n3", "cont"):
            save(folder, name, part, sums.get(name, np.zeros(wide, np.int64)))
        cont = sums.get("cont", np.zeros(1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([[*summary.tolist(), *_counts_of_counts(cont), int((cont > 2).sum())]], pa.list_(pa.int64()))], names=["numbers"])

    first_pair, bits = np.zeros(parts + 1, np.int64), 32
    pairs = Mapped(folder, "pairs", parts, np.uint64)

    def triples(number: int) -> DataFrame:
        """Counts the triples of a round: saves them, and for each pair how many of them end with it."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(parts)
            for batch in batches:
                for lo, hi in _slices(batch.column(0)):
                    token, at = _tokens(batch.column(0).slice(lo, hi - lo))
                    ids = _ids(token, vocabulary, first_id)
                    before = _pairs(ids, at, types)
                    two = _two_before(before, at)
                    own = np.flatnonzero(two >= 0)
                    pair = _key(two[own], before[own])
                    mine = _round(pair, rounds) == number
                    own, pair = own[mine], pair[mine]
                    yield from packer.add(_history(_ids(pair, pairs, first_pair), bits) | ids[own].astype(np.uint64))
            yield from packer.flush()

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, keys, counts = gathered(batches)
            if part is None:
                return
            save(folder, f"triples{number}", part, keys)
            _save_counts(folder, f"triple-counts{number}", part, counts)
            save(folder, f"triple-kinds{number}", part, np.array(_counts_of_counts(counts)))
            history = keys >> _U(64 - bits) << _U(64 - bits)
            at = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
            size = np.diff(np.append(at, len(keys)))
            heavy = size > HEAVY
            save(folder, f"heavy{number}", part, history[at[heavy]])
            save(folder, f"heavy-numbers{number}", part, np.stack(_numbers(counts, at), 1)[heavy])
            place = _place(history[at], bits)
            order_ = np.argsort(place)
            owner = np.searchsorted(first_pair, place[order_], side="right") - 1
            middle = np.empty(len(place), np.int64)
            middle[order_] = (unmix(take(pairs, owner, place[order_] - first_pair[owner])) & _IDS).astype(np.int64)
            middle = np.repeat(middle, size)
            packer = Packer(parts)
            for lo in range(0, len(keys), 500_000):
                yield from packer.add(_key(middle[lo : lo + 500_000], (keys[lo : lo + 500_000] & _U((1 << 64 - bits) - 1)).astype(np.int64)))
            yield from packer.flush()

        def keep_middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, keys, counts = gathered(batches)
            if part is not None:
                every = np.zeros(len(pairs[part]), np.int64)
                every[np.searchsorted(pairs[part], keys)] = counts
                _save_counts(folder, f"middle{number}", part, every)
                yield pa.RecordBatch.from_arrays([pa.array([len(keys)])], names=["n"])

        with tidy(spark):
            ends = dealt(text.mapInArrow(count, BLOCKS), parts).mapInArrow(keep, BLOCKS)
            dealt(ends, parts).mapInArrow(keep_middle, "n long").collect()  # a row a part
        for name in ("triples", "triple-kinds", "heavy", "heavy-numbers"):
            seal(folder, f"{name}{number}")
        _seal_counts(folder, f"triple-counts{number}")
        _seal_counts(folder, f"middle{number}")

    def middle_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the middle level: distinct words before a pair, or how often a pair at the start was seen."""
        starts, seen = Mapped(folder, "starts", parts, np.int64), Mapped(folder, "starts-seen", parts, np.int64)
        found = [_Counts(folder, f"middle{number}", parts) for number in range(rounds)]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                every = np.array(pairs[part])
                if len(every):
                    counts = np.zeros(len(every), np.int64)
                    counts[starts[part]] = seen[part]
                    for own in found:
                        if len(own.low[part]):
                            counts += own.of(part, np.arange(len(every)))
                    yield from pair_stats(part, every, counts)

    sent = text.mapInArrow(count_pairs, BLOCKS)
    if order == 2:
        stats = dealt(sent, parts).mapInArrow(keep_pairs, _STATS)
    else:
        for part, n in owned(sent, parts, keep_pairs, "part int, n long", folder, "pairs", "starts", "starts-seen"):
            first_pair[part + 1] = n
        np.cumsum(first_pair, out=first_pair)
        bits = _place_bits(int(first_pair[-1]))
        if bits + types.bit_length() > 64:
            raise ValueError(f"{types} distinct tokens and {first_pair[-1]} distinct pairs; their bits are more than 64 together")
        for number in range(rounds):
            triples(number)
        stats = spark.range(0, parts, 1, parts).mapInArrow(middle_level, _STATS)
    found = owned(stats, parts, keep_stats, "numbers array<long>", folder, "total", "n1", "n2", "n3", "cont")
    if order == 2:
        seal(folder, "pairs")
    _seal_counts(folder, "pair-counts")
    numbers = np.sum([r[0] for r in found] or [[0] * 10], axis=0).tolist()
    pair_d, word_d, distinct = discounts(numbers[:4]), discounts(numbers[5:9]), numbers[4]
    # the mass that the discounts free: by words seen after one, two and more distinct words
    mass = (word_d[0] * numbers[5] + word_d[1] * numbers[6] + word_d[2] * numbers[9]) / distinct if distinct else 1.0
    model = Model(folder, parts, first_id.tolist(), int(tokens), types, pair_d, word_d, mass, int(distinct))
    if order == 2:
        return model
    kinds = [model.mapped(f"triple-kinds{number}", np.int64) for number in range(rounds)]
    triple_d = discounts(np.sum([k[p] if len(k[p]) else [0] * 4 for p in range(parts) for k in kinds], axis=0).tolist())
    return model._replace(order=3, rounds=rounds, first_pair=first_pair.tolist(), triple_discounts=triple_d)


class _Scorer:
    """A worker's view of a model."""

    def __init__(self, model: Model):
        self.m, self.first_id = model, np.array(model.first_id)
        self.wide = -(-(model.types + 1) // model.parts)
        self.words, self.counts = model.mapped("words", np.uint64), model.mapped("counts", np.int64)
        self.pairs, self.pair_counts = model.mapped("pairs", np.uint64), _Counts(model.folder, "pair-counts", model.parts)
        if model.order == 3:
            self.first_pair = np.array(model.first_pair)
            self.bits = _place_bits(model.first_pair[-1])
        self.stats = {k: model.mapped(k, np.int64) for k in ("total", "n1", "n2", "n3", "cont")}
        self.rounds = [_Round(model, number, self.bits) for number in range(model.rounds)] if model.order == 3 else []

    def _take(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of ids that rise but for those of -1, which get 0."""
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        part = ids[known] // self.wide
        cut = np.searchsorted(part, np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            own, at = self.stats[name][int(p)], known[cut[p] : cut[p + 1]]
            if len(own):
                out[at] = own[ids[at] - p * self.wide]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        m = self.m
        token, at = _tokens(texts)
        keys, back = np.unique(token, return_inverse=True)
        part, place = find(keys, self.words)
        id_of, count = np.where(place >= 0, self.first_id[part] + place, -1), take(self.counts, part, place)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        k = self._take("cont", id_of)  # ids rise with hashes
        low = m.word_mass / (m.types + 1) + np.maximum(k - _discount(m.word_discounts, k), 0) / max(m.distinct_pairs, 1)
        ids = id_of[back]
        before = _pairs(ids, at, m.types)
        low_each = low[back]
        p = low_each.copy()
        which = _pairs(back, at, len(keys))  # histories are the slice's words, and after them the start of a text
        total, n1, n2, n3 = (self._take(name, np.append(id_of, m.types)) for name in ("total", "n1", "n2", "n3"))
        d = m.pair_discounts
        safe = np.maximum(total, 1)
        gamma = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe, 1.0)
        p *= gamma[which]
        both = np.flatnonzero((ids >= 0) & (before >= 0))
        if len(both):
            pair, again = np.unique(_key(before[both], ids[both]), return_inverse=True)
            place = find(pair, self.pairs)
            seen = self.pair_counts.take(*place)
            p[both] += (np.maximum(seen - _discount(d, seen), 0))[again] / safe[which[both]]
            if m.order == 3:
                of_pair = np.full(len(ids), -1, np.int64)
                of_pair[both] = again
                self._third(p, ids, at, pair, place, of_pair)
        logs = np.log10(p)
        known = (count > 0)[back]
        return np.diff(at), np.add.reduceat(known, at[:-1], dtype=np.int64), np.add.reduceat(base[back], at[:-1]), np.add.reduceat(logs, at[:-1])

    def _third(self, p: np.ndarray, ids: np.ndarray, at: np.ndarray, keys: np.ndarray, place: tuple[np.ndarray, np.ndarray], of_pair: np.ndarray) -> None:
        """Puts the third level on the probabilities p of the second, where a history of two was seen.

        keys are the distinct pairs of the slice, place where they stand, and
        of_pair which of them ends at each token: a token's history is the
        pair that ends before it.
        """
        own = np.flatnonzero(of_pair[:-1] >= 0) + 1
        first = np.zeros(len(ids) + 1, bool)
        first[at] = True
        own = own[~first[own]]
        back, (part, k) = of_pair[own - 1], place
        history, number = _history(np.where(k >= 0, self.first_pair[part] + k, 0), self.bits), np.where(k >= 0, _round(keys, self.m.rounds), -1)
        for r, tables in enumerate(self.rounds):
            mine = np.flatnonzero(number == r)
            mine = mine[np.argsort(history[mine])]
            numbers = np.zeros((len(keys), 4), np.int64)
            numbers[mine] = tables.numbers(history[mine])
            here = np.flatnonzero(numbers[back, 0])
            total, n1, n2, n3 = numbers[back[here]].T
            d, each = self.m.triple_discounts, own[here]
            p[each] *= (d[0] * n1 + d[1] * n2 + d[2] * n3) / total
            known = np.flatnonzero(ids[each] >= 0)
            triple, again = np.unique(history[back[here[known]]] | ids[each[known]].astype(np.uint64), return_inverse=True)
            seen = tables.counts.take(*find(triple, tables.triples))
            p[each[known]] += np.maximum(seen - _discount(d, seen), 0)[again] / total[known]


class _Round:
    """A worker's view of the triples of one round."""

    def __init__(self, model: Model, number: int, bits: int):
        self.last = _U((1 << 64 - bits) - 1)
        self.triples, self.counts = model.mapped(f"triples{number}", np.uint64), _Counts(model.folder, f"triple-counts{number}", model.parts)
        self.heavy, self.stored = model.mapped(f"heavy{number}", np.uint64), model.mapped(f"heavy-numbers{number}", np.int64)

    def numbers(self, history: np.ndarray) -> np.ndarray:
        """Sum of counts, and numbers of triples seen once, twice and oftener, of sorted histories."""
        out = np.zeros((len(history), 4), np.int64)
        part = part_of(history, self.triples.parts)
        cut = np.searchsorted(part, np.arange(self.triples.parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own, every, heavy = history[cut[p] : cut[p + 1]], self.triples[p], self.heavy[p]
            first, end = np.searchsorted(every, own), np.searchsorted(every, own | self.last, side="right")
            many = end - first > HEAVY
            if many.any():
                out[cut[p] : cut[p + 1]][many] = self.stored[p].reshape(-1, 4)[np.searchsorted(heavy, own[many])]
            few = np.flatnonzero(~many & (end > first))
            if len(few):
                size = (end - first)[few]
                starts = np.cumsum(size) - size
                counts = self.counts.of(p, np.arange(size.sum()) + np.repeat(first[few] - starts, size))
                out[cut[p] + few] = np.stack(_numbers(counts, starts), 1)
        return out


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with n_tokens, n_known, base_score, score of each text (base 10 logarithms)."""
    rows = docs.select(F.col("text").alias("__text"), *keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(x) for x in scorer.score(part.column(0)))], names=[*part.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(each, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), "n_tokens long, n_known long, base_score double, score double"]))


def perplexity(score_: Column, n_tokens: Column) -> Column:
    """Perplexity a token, from a text's score."""
    return F.pow(F.lit(10.0), -score_ / n_tokens)


def score_held_out(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores every row with a model of those whose crc32 is of another remainder: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (remainder(F.col(id_col), folds) == held).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")), order)
    out = score(rows, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
