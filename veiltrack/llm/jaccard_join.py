"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Documents of the same set of shingles are one unit; units are known by a
   hash of their set.  A sketch of fixed size counts all shingles, and shingles
   are ordered by it, rare ones first.  Two sets that are similar enough share
   one of their first n - ceil(t * n) + 1 shingles, their prefixes.
2. Units of identical prefix and size are one group.  Prefix shingles that
   groups of sizes and places that may link have are found by exchanging hashes;
   of those in a prefix that the same groups have, the first gives postings.
3. Group pairs pass a bound on size and one on what can follow the shared
   shingle in the prefixes.  The sets of the units concerned are kept on shared
   files, and workers verify pairs of units on the memory-mapped sets.

Pairs are made in turns.  First every posting's members are paired with one
leader only; the links found give components.  Of a posting whose members lie
in several components, those outside the largest are paired with some members
of it, then with more of them.  At last members of different components are
paired with each other wherever they may link.  A group of near copies costs as
many pairs as it has members, times a constant, and no link between two
components is left out.  Components come from contracting the links.

Defined results: null text, or text without words, has the empty set: it is
linked with nothing and is its own component; texts of any length are worked
on whole; a null doc_id is larger than any other as a component's name;
repeated rows are copies; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOCKS, Mapped, Packer, drop, drop_all_but, find, gathered, mapped_file, owned, part_of, parts_of_tables, save, seal, shared_folder, stored, take, tidy
from .tokens import mix, rolling, slices, windows, words

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch (4 bytes each; this many are broadcast).
SKETCH = 1 << 21
_STRIPES = 64
#: Classes of set sizes between a size and the largest that it may link with; low bits of a shingle's key for the class of a size, and for the step from it to that of the largest partner.
_STEPS, _CLASS_BITS, _STEP_BITS = 4, 9, 4
#: Prefix shingles that are looked up together, at least.
_TOGETHER = 200_000
#: Leaders that units outside a component are tried against, turn by turn, before all pairs that are left.
MORE_LEADERS = (8, 32, 128)

_U = np.uint64
POSTING = "token long, unit long, n long, pos long, last long, most long"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and n + 1 offsets."""
    w = words(texts, lower=True)
    count = np.diff(w.first)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(count >= size, number)
    out[full] = rolling(w.hash, size)[windows(w.first, size, len(w.hash))]
    for d in np.flatnonzero((count > 0) & (count < size)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        out[at[d]] = rolling(w.hash[a:b], b - a)[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][number > 0]] = True
    sums = np.concatenate(([0], np.cumsum(new)))
    return out[new], sums[at]


def _set_hash(sets: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]])


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _keys(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Shingles at places in the prefixes of sets of n, as keys: the hash's upper bits, the class of n, and the step to the class of the largest set that may link if this is the first shingle in common."""
    ratio = max(100 / percent, 1.05) ** (1 / _STEPS)
    bounds = np.unique(np.ceil(ratio ** np.arange(int(40 * np.log(2) / np.log(ratio)))).astype(np.int64))[: (1 << _CLASS_BITS) - 1]
    most = ((n - pos) * (100 + percent) - n * percent) // percent
    own = np.searchsorted(bounds, n, side="right")
    step = np.clip(np.searchsorted(bounds, most, side="right") - own + _STEPS + 1, 0, (1 << _STEP_BITS) - 1)
    low = _CLASS_BITS + _STEP_BITS
    return (token >> _U(low) << _U(low)) | (own << _STEP_BITS | step).astype(np.uint64)


def _partners(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct keys with their counts, those whose shingle a set of a size that may link has as well, and those where it may be the first in common with such a set."""
    token = keys >> _U(_CLASS_BITS + _STEP_BITS)
    low = (keys & _U((1 << _CLASS_BITS + _STEP_BITS) - 1)).astype(np.int64)
    own = low >> _STEP_BITS
    most = own + (low & (1 << _STEP_BITS) - 1) - _STEPS - 1
    met = counts > 1
    first = met & (own <= most)
    i, by = np.arange(len(keys)), 1
    while len(i):
        i = i[i + by < len(keys)]
        i = i[(token[i + by] == token[i]) & (own[i + by] - own[i] <= _STEPS + 1)]  # classes rise: what is too far stays so
        j = i + by
        met[i] = met[j] = True
        ok = (own[j] <= most[i]) & (own[i] <= most[j])
        first[i[ok]] = first[j[ok]] = True
        by += 1
    return met, first


def _table(df: DataFrame, folder: str, name: str, parts: int) -> DataFrame:
    """df as a table of so many files at most, whatever the number of partitions of its last shuffle."""
    return stored(df.coalesce(parts), folder, name)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles by the low bits of their hash, summed in stripes over the tasks."""
    wide = SKETCH // _STRIPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                sets, _ = shingle_sets(batch.column(0).slice(lo, hi - lo), size)
                sums += np.bincount((sets & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_STRIPES), pa.int32()), pa.array([sums[i * wide : (i + 1) * wide].tobytes() for i in range(_STRIPES)], pa.binary())], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64)
                sums[p] = sums[p] + own if p in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    striped = docs.select("text").mapInArrow(count, "part int, counts binary").repartitionById(_STRIPES, F.col("part")).mapInArrow(total, "part int, counts binary")
    out = np.zeros(SKETCH, np.uint32)
    with tidy(docs.sparkSession):
        found = striped.select("*").collect()  # SKETCH counters in all
    for part, counts in found:
        out[part * wide : (part + 1) * wide] = np.frombuffer(bytes(counts), np.uint32)
    return out


_FOUND = "doc_id {}, tag long, text_hash long, n long, unit long, check long, head1 long, head2 long, last long, prefix binary"


def _units(docs: DataFrame, sketch, size: int, percent: int, salt: int) -> DataFrame:
    """doc_id, n, unit, check (the set's hash, twice), head1, head2 (the prefix's hash), prefix (hashes, rare first)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sketch.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                sets, at = shingle_sets(batch.column(1).slice(lo, hi - lo), size)
                n = np.diff(at)
                need = prefix_size(n, percent)
                # sorted by hash within a document; a stable sort by count keeps that order among equals
                weight = rare[(sets & _U(SKETCH - 1)).astype(np.int64)]
                order = np.concatenate([np.argsort(weight[a:b], kind="stable")[:k] + a for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), need.tolist())] or [np.empty(0, np.int64)])
                heads, cut = sets[order], np.concatenate(([0], np.cumsum(need)))
                head = [_set_hash(heads, cut, salt + k) for k in (3, 4)]
                # rank of the last prefix shingle: its whole count, then the upper bits of its hash, so it never goes against the order by which prefixes are cut
                end = order[np.maximum(cut[1:] - 1, 0)] if len(order) else np.zeros(len(n), np.int64)
                last = np.where(n > 0, (weight[end].astype(np.int64) << 31) | (sets[end] >> _U(33)).astype(np.int64), 0) if len(order) else np.zeros(len(n), np.int64)
                prefix = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(heads.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(n), _signed(_set_hash(sets, at, salt)), _signed(_set_hash(sets, at, salt + 1)), _signed(head[0]), _signed(head[1]), pa.array(last), prefix], names=["doc_id", "tag", "text_hash", "n", "unit", "check", "head1", "head2", "last", "prefix"])

    return docs.mapInArrow(build, _FOUND.format(docs.dtypes[0][1]))


def _save_ids(df: DataFrame, column: str, folder: str, name: str, parts: int) -> Mapped:
    """Distinct ids of a column as sorted arrays on shared files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            yield from packer.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from packer.flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, _ = gathered(batches)
        if part is not None:
            save(folder, name, part, keys)
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)])], names=["n"])

    owned(df.select(column).coalesce(parts).mapInArrow(pack, BLOCKS), parts, keep, "n long", folder, name)
    return Mapped(folder, name, parts, np.uint64)


def _save_tags(df: DataFrame, folder: str, name: str, parts: int) -> tuple[Mapped, Mapped]:
    """Distinct units and their tags as sorted arrays on shared files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            part = part_of(unit.view(np.uint64), parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, unit[order[i:j]].tobytes(), tag[order[i:j]].tobytes()) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit, tag = None, [], []
        for batch in batches:
            for p, u, t in zip(*(batch.column(i) for i in range(3))):
                part = p.as_py()
                unit.append(np.frombuffer(u.as_buffer(), np.uint64))
                tag.append(np.frombuffer(t.as_buffer(), np.int64))
        if part is not None:
            order = np.argsort(np.concatenate(unit))
            save(folder, name, part, np.concatenate(unit)[order])
            save(folder, f"{name}-tags", part, np.concatenate(tag)[order])
        yield pa.RecordBatch.from_arrays([pa.array([len(unit)])], names=["n"])

    owned(df.select("unit", "tag").mapInArrow(pack, BLOCKS), parts, keep, "n long", folder, name, f"{name}-tags")
    return Mapped(folder, name, parts, np.uint64), Mapped(folder, f"{name}-tags", parts, np.int64)


def _have(ids: np.ndarray, table: Mapped) -> np.ndarray:
    keys, back = np.unique(ids, return_inverse=True)
    return (find(keys, table)[1] >= 0)[back]


def _postings(groups: DataFrame, units: DataFrame, folder: str, parts: int, percent: int) -> DataFrame:
    """token, unit, n, pos, last, most for prefix tokens that may be the first in common of two groups; one row for a group, under the name of its first unit.

    Of a prefix's tokens that the same groups have, only the first is posted:
    the others are not the first in common of any two.  most is how many of a
    set's shingles can be in a set of another group of a size that may link
    whose prefix ends no earlier than its own (at ``last``): those after the
    prefix, and those in it that such a group's prefix has.
    """
    heads, tags = _save_tags(groups, folder, "heads", parts)
    tokens, firsts = Mapped(folder, "tokens", parts, np.uint64), Mapped(folder, "tokens-first", parts, np.uint8)
    posted, signs = Mapped(folder, "posted", parts, np.uint64), Mapped(folder, "posted-signs", parts, np.uint64)

    def own(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, tag = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
        keys, first = np.unique(ids, return_index=True)
        part, at = find(keys, heads)
        for u, i, p, k in zip(keys, first.tolist(), part.tolist(), at.tolist()):
            same = np.flatnonzero(ids == u) if k >= 0 and tag[i] != tags[p][k] else [i]
            if k >= 0 and (tag[same] == tags[p][k]).any():  # the row that stands for its unit
                yield u, batch.column(1)[i].as_py(), batch.column(4)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)

    def laid(rows: list) -> tuple[np.ndarray, ...]:
        unit, n, last = (np.array([r[k] for r in rows], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        size = np.array([len(r[3]) for r in rows])
        row, token = np.repeat(np.arange(len(rows)), size), np.concatenate([r[3] for r in rows])
        pos = np.arange(len(token)) - (np.cumsum(size) - size)[row]
        return unit, n, last, size, row, pos, token, _keys(token, n[row], pos, percent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Some rows at a time: their unit, n, last and prefix size, and of each of their tokens row, place, hash and key."""
        for batch in batches:
            rows, held = [], 0
            for r in own(batch):
                rows.append(r)
                held += len(r[3])
                if held >= _TOGETHER:
                    yield laid(rows)
                    rows, held = [], 0
            if rows:
                yield laid(rows)

    def look(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(key, return_inverse=True)
        part, at = find(keys, tokens)
        return (at >= 0)[back], (take(firsts, part, at) > 0)[back]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for *_, key in keyed(batches):
            yield from packer.add(key)
        yield from packer.flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = gathered(batches)
        if part is not None:
            met, first = _partners(keys, counts)
            save(folder, "tokens", part, keys[met])
            save(folder, "tokens-first", part, first[met].astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)])], names=["n"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for unit, *_, row, _, token, key in keyed(batches):
            first = look(key)[1]
            yield from packer.add(token[first], mix(unit)[row[first]].view(np.int64))
        yield from packer.flush()

    def keep_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, sums = gathered(batches)
        if part is not None:
            save(folder, "posted", part, keys)
            save(folder, "posted-signs", part, sums.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([len(keys)])], names=["n"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, n, last, size, row, pos, token, key in keyed(batches):
            met, first = look(key)
            most = n - size + np.add.reduceat(met.astype(np.int64), np.cumsum(size) - size)
            at = np.flatnonzero(first)
            keys, back = np.unique(token[at], return_inverse=True)
            who = take(signs, *find(keys, posted))[back]  # the sum over the groups that have it
            order = np.lexsort((at, who, row[at]))
            new = np.ones(len(at), bool)
            new[1:] = (who[order][1:] != who[order][:-1]) | (row[at][order][1:] != row[at][order][:-1])
            new &= who[order] != mix(unit)[row[at]][order]  # no other group has it
            at = np.sort(at[order][new])
            yield pa.RecordBatch.from_arrays([_signed(token[at]), _signed(unit[row[at]]), pa.array(n[row[at]]), pa.array(pos[at]), pa.array(last[row[at]]), pa.array(most[row[at]])], names=["token", "unit", "n", "pos", "last", "most"])

    prefixes = units.filter("n > 0").select("unit", "n", "prefix", "tag", "last")
    owned(prefixes.mapInArrow(pack, BLOCKS), parts, keep, "n long", folder, "tokens", "tokens-first")
    owned(prefixes.mapInArrow(sign, BLOCKS), parts, keep_signs, "n long", folder, "posted", "posted-signs")
    return _table(prefixes.mapInArrow(post, POSTING).distinct(), folder, "postings", parts)


def _may_link(a: str, b: str, percent: int, first: bool = True):
    """Bounds for two postings: sizes, what can be common at all by the set whose prefix ends first, and, if this token is to be the first in common, what can be common from here on."""
    na, nb, la, lb, ma, mb = (F.col(f"{x}.{c}") for c in ("n", "last", "most") for x in (a, b))
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    most = F.when(la < lb, ma).when(lb < la, mb).otherwise(F.greatest(ma, mb))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & ((F.least(rest, most) if first else most) * (100 + percent) >= (na + nb) * percent)


class _Sets:
    """Sets of units on shared files: each task that found some wrote one file, and an index by unit tells file, first hash and size."""

    def __init__(self, folder: str, name: str, parts: int):
        self.folder, self.name = folder, name
        self.ids = Mapped(folder, f"{name}-ids", parts, np.uint64)
        self.where = Mapped(folder, f"{name}-where", parts, np.int64)

    def get(self, keys: np.ndarray) -> dict[int, np.ndarray]:
        """Sets of distinct sorted units, of those that are here."""
        part, at = find(keys, self.ids)
        out = {}
        for u, p, k in zip(keys.tolist(), part.tolist(), at.tolist()):
            if k >= 0:
                file, first, size = self.where[p][3 * k : 3 * k + 3].tolist()
                out[u] = mapped_file(f"{self.folder}/{self.name}-sets.{file}", np.uint64)[first : first + size]
        return out


def _verify(pairs: DataFrame, held: list[_Sets], percent: int) -> DataFrame:
    """Of distinct pairs a, b, those whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                a, b = (part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                sets = {}
                for own in held:
                    sets |= own.get(np.unique(np.concatenate((a, b))))
                ok = np.zeros(len(a), bool)
                for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
                    x, y = sets[u], sets[v]
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield part.filter(pa.array(ok))

    return pairs.select("a", "b").mapInArrow(check, "a long, b long")


def _save_sets(docs: DataFrame, units: DataFrame, pairs: DataFrame, have: list[_Sets], folder: str, name: str, parts: int, size: int, salt: int) -> _Sets:
    """Puts the sets of the units in pairs a, b on shared files, but for those that are there.  Only texts that stand for such a unit, one for each, are taken apart."""

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            gone = np.zeros(len(units), bool)
            for other in have:
                gone |= _have(units, other.ids)
            yield batch.filter(pa.array(~gone))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("unit"))
    missing = _table(ends.distinct().coalesce(parts).mapInArrow(lacking, "unit long"), folder, f"{name}-missing", parts)
    if missing.isEmpty():
        for array in ("ids", "where"):
            seal(folder, f"{name}-{array}")
        return _Sets(folder, name, parts)
    wanted = _save_ids(missing, "unit", folder, f"{name}-wanted", parts)
    texts = units.select("unit", "text_hash").join(missing, "unit").groupBy("unit").agg(F.min("text_hash").alias("text_hash"))
    needed = _save_ids(texts, "text_hash", folder, f"{name}-needed", parts)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, first, path = TaskContext.get().taskAttemptId(), set(), 0, None
        for batch in batches:
            batch = batch.filter(pa.array(_have(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64), needed)))
            for lo, hi in slices(batch.column(1)):
                sets, at = shingle_sets(batch.column(1).slice(lo, hi - lo), size)
                unit = _set_hash(sets, at, salt)
                need = _have(unit, wanted) & (np.diff(at) > 0)
                rows = [i for i in np.flatnonzero(need).tolist() if not (int(unit[i]) in seen or seen.add(int(unit[i])))]
                if rows:
                    path = path or f"{folder}/{name}-sets.{task}"
                    with open(path, "ab") as f:
                        for i in rows:
                            f.write(sets[at[i] : at[i + 1]].tobytes())
                    n = np.diff(at)[rows]
                    where = np.stack([np.full(len(rows), task), first + np.cumsum(n) - n, n], 1)
                    first += int(n.sum())
                    part = part_of(unit[rows], parts)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    cut = [(p, order[i:j]) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in cut], pa.int32()), pa.array([unit[rows][k].tobytes() for _, k in cut], pa.binary()), pa.array([where[k].tobytes() for _, k in cut], pa.binary())], names=["part", "keys", "counts"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit, where = None, [], []
        for batch in batches:
            for p, u, w in zip(*(batch.column(i) for i in range(3))):
                part = p.as_py()
                unit.append(np.frombuffer(u.as_buffer(), np.uint64))
                where.append(np.frombuffer(w.as_buffer(), np.int64).reshape(-1, 3))
        if part is not None:
            keys, first = np.unique(np.concatenate(unit), return_index=True)
            save(folder, f"{name}-ids", part, keys)
            save(folder, f"{name}-where", part, np.concatenate(where)[first])
        yield pa.RecordBatch.from_arrays([pa.array([len(unit)])], names=["n"])

    owned(docs.mapInArrow(pick, BLOCKS), parts, keep, "n long", folder, f"{name}-ids", f"{name}-where")
    return _Sets(folder, name, parts)


def _relabelled(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Distinct edges a < b between the labels of their ends; ends without a label keep their name."""
    for end in ("a", "b"):
        named = label.select(F.col("unit").alias(end), F.col("label").alias("to"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, folder: str, name: str, parts: int) -> DataFrame:
    """unit, label (one unit of those that links reach, the same for all of them) for units that have links.

    Each turn every unit takes its smallest neighbour for its parent, parents
    are followed to their roots by pointer jumping, and the links between
    roots are the next turn's; they are a fraction of those before.
    """
    edges = _table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-edges0", parts)
    label, turn = None, 0
    while True:
        both = edges.select(F.col("a").alias("unit"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("unit"), F.col("a").alias("other")))
        root, jump = both.groupBy("unit").agg(F.min("other").alias("label")).select("unit", F.least("unit", "label").alias("label")), 0
        while True:
            root = _table(root, folder, f"{name}-root{turn}-{jump}", parts)
            further = root.select(F.col("unit").alias("label"), F.col("label").alias("further"))
            next_root = root.join(further, "label").select("unit", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved"))
            next_root, jump = _table(next_root, folder, f"{name}-next{turn}-{jump}", parts), jump + 1
            if next_root.filter("moved").isEmpty():
                break
            root = next_root.drop("moved")
        if label is None:
            label = root
        else:
            step = root.select(F.col("unit").alias("label"), F.col("label").alias("to"))
            label = _table(label.join(step, "label", "left").select("unit", F.coalesce("to", "label").alias("label")), folder, f"{name}-label{turn}", parts)
        edges, turn = _table(_relabelled(edges, root), folder, f"{name}-edges{turn + 1}", parts), turn + 1
        if edges.isEmpty():
            return label


def _several(everyone: DataFrame, label: DataFrame, folder: str, turn: int, parts: int) -> DataFrame:
    """Postings whose members lie in several components, with the label of each, the major label and how many members have it."""
    rows = _table(everyone.join(label, "unit", "left").withColumn("label", F.coalesce("label", "unit")), folder, f"labelled{turn}", parts)
    sizes = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    split = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("most_of"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    out = _table(rows.join(split.select("token", F.col("most_of.label").alias("major"), F.col("most_of.k").alias("k")), "token"), folder, f"split{turn}", parts)
    drop(folder, f"labelled{turn}")
    return out


def _pair(p: str, q: str) -> list:
    return [F.least(f"{p}.unit", f"{q}.unit").alias("a"), F.greatest(f"{p}.unit", f"{q}.unit").alias("b")]


def _with_leaders(split: DataFrame, leaders: int, turn: int, percent: int) -> DataFrame:
    """Units outside a major component, each with about so many of its members, by a hash, in one posting: the one with the most of them.  Most of what belongs to a component joins it here, at a cost of its size."""
    one = split.filter("label <> major").groupBy("unit").agg(F.max_by(F.struct("token", "n", "pos", "last", "most"), F.struct("k", "token")).alias("own")).select("unit", "own.*")
    draw = F.shiftrightunsigned(F.xxhash64("unit", F.lit(turn)), 11) / F.lit(float(1 << 53))
    some = split.filter("label = major").filter(draw * F.col("k") < leaders)
    return one.alias("p").join(some.alias("q"), "token").filter(_may_link("p", "q", percent, first=False)).select(*_pair("p", "q")).distinct()


def _across(split: DataFrame, percent: int) -> DataFrame:
    """All pairs of a posting's members in different components that may link: those outside the major one with each other and with it."""
    pairs = split.filter("label <> major").alias("p").join(split.alias("q"), "token").filter("p.label <> q.label and (q.label = q.major or p.unit < q.unit)")
    return pairs.filter(_may_link("p", "q", percent)).select(*_pair("p", "q")).distinct()


def link_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id."""
    return _linked(docs, shingle, percent, id_col, text_col).drop("text_hash")


def _linked(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """link_documents with text_hash, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("tag"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    parts = parts_of_tables(rows)
    sketch = spark.sparkContext.broadcast(_sketch(rows, shingle))
    salt = 11
    while True:
        units = _table(_units(rows, sketch, shingle, percent, salt), folder, f"units{salt}", parts)
        sets = _table(units.filter("n > 0").groupBy("unit").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("tag").alias("tag"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("head1").alias("head1"), F.first("head2").alias("head2")), folder, f"sets{salt}", parts)
        if sets.filter("c1 <> c2").isEmpty():
            break
        drop(folder, f"units{salt}", f"sets{salt}")
        salt += 10  # two sets under one name: name them anew
    groups = _table(sets.groupBy("head1", "head2", "n").agg(F.min(F.struct("unit", "tag")).alias("first"), F.count(F.lit(1)).alias("members")).select("head1", "head2", "n", "first.*", "members"), folder, "groups", parts)
    # a group's members beyond the first, with the group's name
    crowd = groups.filter("members > 1").select("head1", "head2", "n", F.col("unit").alias("head"))
    members = _table(sets.join(crowd, ["head1", "head2", "n"]).select("head", "unit").filter("head <> unit"), folder, "members", parts)
    postings = _postings(groups, units, folder, parts, percent)
    # prefixes have had their use
    units = _table(units.select("doc_id", "text_hash", "n", "unit"), folder, "rows", parts)
    drop(folder, f"units{salt}", "heads", "heads-tags", "tokens", "tokens-first", "posted", "posted-signs")

    leader = postings.groupBy("token").agg(F.min(F.struct("unit", "n", "pos", "last", "most")).alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    star = postings.alias("p").join(leader.select("token", "lead.*").alias("q"), "token").filter("p.unit <> q.unit").filter(_may_link("p", "q", percent))
    star = star.select(F.col("q.unit").alias("a"), F.col("p.unit").alias("b")).unionByName(members.select(F.col("head").alias("a"), F.col("unit").alias("b")))
    star = _table(star.distinct(), folder, "star", parts)

    held = [_save_sets(rows, units, star, [], folder, "star", parts, shingle, salt)]
    links = _table(_verify(star.repartition("a", "b").coalesce(parts), held, percent), folder, "links", parts)
    label, tested = components(links, folder, "first", parts), star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # postings by unit, a group's members included
    everyone = postings.unionByName(postings.withColumnRenamed("unit", "head").join(members, "head").drop("head"))
    # a group meets under its own name too, and there its members can have all in common
    crowded = crowd.select(F.col("head"), F.col("head").alias("unit"), "n").unionByName(members.join(crowd.select("head", "n"), "head"))
    own = F.xxhash64(F.lit("group"), F.col("head")).alias("token")
    zero = F.lit(0).cast("long")
    everyone = everyone.unionByName(crowded.select(own, "unit", "n", zero.alias("pos"), zero.alias("last"), F.col("n").alias("most")))

    split, before = None, "postings"
    for turn, leaders in enumerate((*MORE_LEADERS, None)):
        if split is None:  # else it is as it was, as no link has been found since
            split = _several(everyone, label, folder, turn, parts)
            everyone = split.select(everyone.columns)  # postings of one component stay so: components only grow
            drop(folder, before)
            before = f"split{turn}"
        if split.isEmpty():
            break
        pairs = _with_leaders(split, leaders, turn, percent) if leaders else _across(split, percent)
        pairs = _table(pairs, folder, f"asked{turn}", parts)  # distinct before those that were tested go
        pairs = _table(pairs.join(tested, ["a", "b"], "left_anti"), folder, f"pairs{turn}", parts)
        drop(folder, f"asked{turn}")
        if pairs.isEmpty():
            continue
        held.append(_save_sets(rows, units, pairs, held, folder, f"held{turn}", parts, shingle, salt))
        more = _table(_verify(pairs.repartition("a", "b").coalesce(parts), held, percent), folder, f"more{turn}", parts)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            step = components(_relabelled(more, label), folder, f"turn{turn}", parts).select(F.col("unit").alias("label"), F.col("label").alias("to"))
            alone = step.join(label.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("unit"), F.col("to").alias("label"))
            label = _table(label.join(step, "label", "left").select("unit", F.coalesce("to", "label").alias("label")).unionByName(alone), folder, f"label{turn}", parts)
            split = None

    named = sets.select("unit", "least").join(label, "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = _table(named.join(names, "label").select("unit", "component_id"), folder, "final", parts)
    drop_all_but(folder, "rows", "final")
    out = units.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("unit")).alias("unit")).filter("unit is not null").join(final, "unit").select("doc_id", "n_shingles", "component_id", "text_hash")
    return out.unionByName(units.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest doc_id.  Rows whose doc_id is null go if they are linked with one that is not.  Each row goes by its own text: others of its doc_id stay."""
    linked = _linked(docs, shingle, percent, id_col, text_col)
    gone = linked.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__gone_text")), "left_anti")
