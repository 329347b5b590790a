"""Files that the driver and all executors share, and exchanges of packed hash blocks.

Intermediate tables and sorted hash arrays go to a folder of their own under
``spark.checkpoint.dir``.  That setting is read from the session and set only
where it is unset, and only on one machine.  The folder has to be mounted on
every node, as the arrays are memory-mapped, by a bounded number of maps a worker.  Files appear under their final
name by a rename, so a task that runs twice leaves one whole file.  When all
parts of an array are there the driver seals it with a list of them; a reader
that misses the list, or a file of the list, fails.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import re
import shutil
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Bytes of input, by Spark's estimate, for each part of an exchange of blocks, and the most parts.
PART_BYTES, MOST_PARTS = 256 << 20, 1 << 15
#: Bytes of input for each part where one query makes many exchanges and tables, most of them small.
TABLE_BYTES = 8 << 20
BLOCKS = "part int, keys binary, counts binary"
#: Keys that a task gathers before it packs and sends them.
FLUSH_KEYS = 1_000_000

_made: list[str] = []


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new, empty folder that every node sees; a plain path."""
    root = checkpoint_root(spark)
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", root)
    if scheme and scheme[1] != "file":
        raise ValueError(f"spark.checkpoint.dir is {root}; a folder that every node mounts is needed to map files from it")
    path = os.path.join(re.sub(r"^file:/*", "/", root), f"{what}-{uuid.uuid4().hex}")
    os.makedirs(path)
    _made.append(path)
    return path


def _remove() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_remove)


def drop_all_but(folder: str, *names: str) -> None:
    """Removes what is in a folder of its own but for those tables, which all that is still to be computed reads."""
    for entry in os.scandir(folder):
        if entry.name not in names:
            (shutil.rmtree if entry.is_dir() else os.remove)(entry.path)


def drop(folder: str, *names: str) -> None:
    """Removes those tables and arrays from a folder of its own; nothing that is still to be computed reads them."""
    for entry in os.scandir(folder):
        if entry.name.partition(".")[0] in names:
            (shutil.rmtree if entry.is_dir() else os.remove)(entry.path)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files: what they found is on shared files or with the driver."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors."""
    path = f"file://{folder}/{name}"
    with tidy(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(docs: DataFrame) -> int:
    """Partitions of an exchange of blocks: those of Spark's shuffles, more of them for an input that is large by Spark's estimate."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // PART_BYTES) if size < 1 << 60 else 0  # of rows made by the driver it knows nothing
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_PARTS))


def parts_of_tables(docs: DataFrame) -> int:
    """Partitions for a query that makes many exchanges and tables of one input: those of parts_of, but no more than one for each TABLE_BYTES of it, or two a core.  Tasks of a few rows cost more than their rows."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = max(-(-size // TABLE_BYTES), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    return min(parts_of(docs), wanted)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Key ranges of equal width: the part of a uniform 64-bit key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        s = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return s[at], np.diff(np.append(at, len(s)))
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.add.reduceat(counts[order], at)


class Packer:
    """Gathers keys of a task, sums them, and gives rows of BLOCKS: one for each part that has keys."""

    def __init__(self, parts: int, most: int = FLUSH_KEYS):
        self.parts, self.most, self.held, self.n = parts, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append(tally(keys, counts))
        self.n += len(self.held[-1][0])
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, counts = tally(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))
        self.held, self.n = [], 0
        cut = np.searchsorted(part_of(keys, self.parts), np.arange(self.parts + 1))
        rows = [(p, keys[i:j].tobytes(), squeeze(counts[i:j])) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])


def squeeze(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all, after a byte that says how many; sums beyond 63 bits wrap around."""
    most = int(counts.astype(np.uint64).max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def spread(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """All blocks of a partition of an exchange, summed by key: part, keys in order, counts."""
    part, keys, counts, n = None, [], [], 0

    def summed() -> None:
        keys[:], counts[:] = (([x] for x in tally(np.concatenate(keys), np.concatenate(counts))) if keys else ([], []))

    for batch in batches:
        for p, k, c in zip(*(batch.column(i) for i in range(3))):
            part = p.as_py()
            keys.append(np.frombuffer(k.as_buffer(), np.uint64))
            counts.append(spread(c.as_py()))
            n += len(keys[-1])
            if n > FLUSH_KEYS and n > 2 * len(keys[0]):
                summed()
                n = len(keys[0])
    summed()
    return (part, keys[0], counts[0]) if keys else (part, np.empty(0, np.uint64), np.empty(0, np.int64))


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks with each part in its own partition."""
    return blocks.repartitionById(parts, F.col("part"))


def owned(blocks: DataFrame, parts: int, keep, schema: str, folder: str, *names: str) -> list:
    """Runs ``keep`` over each part's blocks, which saves the part's files of the named arrays, and seals those; gives the rows that it made."""
    with tidy(blocks.sparkSession):
        rows = dealt(blocks, parts).mapInArrow(keep, schema).collect()  # a row a part
    for name in names:
        seal(folder, name)
    return rows


def save(folder: str, name: str, part: int, array: np.ndarray) -> None:
    """An array as a part's file of a named array."""
    path = os.path.join(folder, f"{name}.{part}")
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(np.ascontiguousarray(array).data)
    os.replace(tmp, path)


def seal(folder: str, name: str) -> None:
    """Lists the parts of a named array that are there, which are all that it will have."""
    start = f"{name}."
    parts = sorted(int(x.name[len(start) :]) for x in os.scandir(folder) if x.name.startswith(start) and x.name[len(start) :].isdigit() and x.stat().st_size)
    with open(tmp := os.path.join(folder, f"{name}.{uuid.uuid4().hex}"), "w") as f:
        json.dump(parts, f)
    os.replace(tmp, os.path.join(folder, f"{name}.parts"))


#: Maps that a worker keeps, of all arrays together; where a map costs a file descriptor, far fewer.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MOST_MAPPED = 8192 if _UNTRACKED else 128
_maps: OrderedDict[str | tuple[str, int], np.ndarray] = OrderedDict()


def mapped_file(path: str, dtype, key: str | tuple[str, int] | None = None) -> np.ndarray:
    """A file's array.  Of all that a worker has mapped, those go that haven't been asked for longest, as many as are too many (and end with the last that reads them)."""
    key = key or path
    own = _maps.get(key)
    if own is not None:
        _maps.move_to_end(key)
        return own
    with open(path, "rb") as f:
        own = _maps[key] = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED), dtype)
    while len(_maps) > MOST_MAPPED:
        _maps.popitem(last=False)
    return own


class Mapped:
    """A worker's view of the part files of a named array, memory-mapped when used; a part that isn't in the sealed list is empty."""

    def __init__(self, folder: str, name: str, parts: int, dtype):
        self.path, self.parts, self.dtype, self.there = os.path.join(folder, name), parts, np.dtype(dtype), None
        self.seen: set[int] = set()

    def __getitem__(self, part: int) -> np.ndarray:
        key = (self.path, part)
        own = _maps.get(key)
        if own is not None and part in self.seen:
            _maps.move_to_end(key)
            return own
        if self.there is None:
            with open(f"{self.path}.parts") as f:
                self.there = set(json.load(f))
        if part not in self.there:
            return np.empty(0, self.dtype)
        os.stat(f"{self.path}.{part}")  # an earlier view's map may outlast its file
        self.seen.add(part)
        return mapped_file(f"{self.path}.{part}", self.dtype, key)

    def __getstate__(self):
        return {**self.__dict__, "there": None, "seen": set()}


def find(keys: np.ndarray, table: Mapped) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted distinct keys stand in a table of sorted parts: part, and index there or -1."""
    part = part_of(keys, table.parts)
    at = np.full(len(keys), -1, np.int64)
    cut = np.searchsorted(part, np.arange(table.parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        i, j = cut[p], cut[p + 1]
        own = table[int(p)]
        if len(own):
            k = np.searchsorted(own, keys[i:j])
            hit = own[np.minimum(k, len(own) - 1)] == keys[i:j]
            at[i:j] = np.where(hit, k, -1)
    return part, at


def take(table: Mapped, part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places that find gave (parts rise); 0 where there is none."""
    out = np.zeros(len(at), table.dtype)
    cut = np.searchsorted(part, np.arange(table.parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        own = at[cut[p] : cut[p + 1]]
        there = np.flatnonzero(own >= 0)
        if len(there):
            out[cut[p] + there] = table[int(p)][own[there]]
    return out
