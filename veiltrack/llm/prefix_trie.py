"""The trie of conversations by their first turns, with sums over every subtree.

A conversation is a path of units, one a turn: 16 bytes of the SHA-256 of role
and text, and the number of words.  Paths are sorted and dealt by ranges of
(path, conv_id), so that equal conversations, however many, are split.  Each
partition makes its own forest: union-find over the longest common prefixes of
sorted neighbours, in descending depth, where every merge of two components is
a branching node, and the nodes between two branchings follow from the path.

What other partitions can share with it are the nodes above its first and its
last path.  Those are contracted: each keeps the sums of the complete subtrees
that hang on it and becomes an entry of a far smaller sorted list, to which
the same step is applied, ``FAN`` neighbouring partitions at a time, until one
forest is left.  A node is written in the round in which it is complete.

The ids of conversations that end at a node are hashed in order as they stream
by; where they cross a boundary they are sent on in pieces of bounded size and
hashed in order of their first ids.

Defined results: null role and null text are empty; turns are ordered by turn
(null first), role, and digest, and repeated rows are turns of their own; rows
without conv_id are left out; a conversation that rebuilding leaves without a
turn ends at the root; an empty table gives no rows; texts of any length count
whole; other columns are ignored.  A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt, parts_of, shared_folder, stored, tidy

#: Bytes of a turn's digest and of a turn in a path.
DIGEST, UNIT = 16, 20
#: Neighbouring partitions whose contracted forests are merged in one task.
FAN = 32
#: Bytes of ids that are held of a path before they are sent on.
PIECE_BYTES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()

NODE, ENTRY, PIECE = 0, 1, 2
#: edge: 1 marks the first path of a partition, 2 the last, 3 both.  In an entry, conv_id and the sums are those of what hangs on it.
ROWS = "kind int, part int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest binary, pend binary, path binary, ends long, ends_min long, edge int, ids binary"
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in ROWS.split(", "))])
_NONE = np.iinfo(np.int64).max


def paths(conversations: DataFrame, share: int = 20, longest: int = 4) -> DataFrame:
    """conv_id, path of each rebuilt conversation: the first h turns of conversation conv_id - conv_id % share, then its own after its first h; h is crc32(conv_id) % longest.  share 1 leaves conversations as they are."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    unit = F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST), F.lpad(F.hex(words), 8, "0"))
    turns = conversations.filter("conv_id is not null").select("conv_id", (F.col("conv_id") - F.col("conv_id") % share).alias("base"), "turn", role.alias("role"), unit.alias("unit"))
    if share == 1:
        whole = turns.groupBy("conv_id")
    else:  # a conversation lies where that is whose turns it begins with
        whole = turns.repartition("base").groupBy("base", "conv_id")
    own = whole.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "unit"))).alias("t")).withColumn("path", F.unhex(F.array_join(F.transform("t", lambda t: t["unit"]), ""))).drop("t")
    if share == 1:
        return own
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("path", 1, UNIT * (longest - 1)))).over(Window.partitionBy("base"))
    cut = (h * UNIT).cast("int")
    rebuilt = F.concat(F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.unhex(F.lit(""))), F.substring(F.col("path"), cut + 1, F.greatest(F.length("path") - cut, F.lit(0))))
    return own.withColumn("head", head).select("conv_id", rebuilt.alias("path"))


class Entries(NamedTuple):
    """Distinct sorted paths with what ends at each and what hangs on it."""

    path: list[bytes]
    ends: np.ndarray
    ends_min: np.ndarray
    ends_sha: list[str | None]
    convs: np.ndarray
    least: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray


def common_units(a: bytes, b: bytes) -> int:
    """Units that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // UNIT
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // UNIT


def _table(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def forest(e: Entries, first: int | None, last: int | None, part: int, later: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes that are complete, and entries of the others: those above the entries first and last, which other partitions may share; both are None where there are no others.

    later tells that earlier rounds may wait for these nodes.
    """
    k = len(e.path)
    size = np.array([len(p) // UNIT for p in e.path], np.int64)
    words = np.frombuffer(b"".join(e.path), np.dtype([("digest", f"V{DIGEST}"), ("words", ">u4")]))["words"].astype(np.int64)
    before, at = np.concatenate(([0], np.cumsum(words))), np.concatenate(([0], np.cumsum(size)))[:-1]
    open_at = {i for i in (first, last) if i is not None}

    # nodes: first those of the entries, then branchings as they are made
    depth, rep = size.tolist(), list(range(k))
    convs, least = (e.ends + e.convs).tolist(), np.minimum(e.ends_min, e.least).tolist()
    hung, children, leaves, saved = e.least.tolist(), e.children.tolist(), e.leaves.tolist(), e.saved.tolist()  # hung: the smallest member of what hangs on a node
    parent, shared = [-1] * k, [i in open_at for i in range(k)]
    prefix = lambda r, t: int(before[at[r] + t] - before[at[r]])

    def close(b: int) -> None:
        if not shared[b]:
            leaves[b] = leaves[b] if children[b] else 1
            saved[b] += (convs[b] - 1) * (prefix(rep[b], depth[b]) - prefix(rep[b], depth[b] - 1)) if depth[b] else 0

    def attach(b: int, p: int) -> None:
        parent[b] = p
        close(b)
        if shared[b]:
            shared[p] = True
            return
        convs[p] += convs[b]
        least[p], hung[p] = min(least[p], least[b]), min(hung[p], least[b])
        children[p] += 1
        leaves[p] += leaves[b]
        saved[p] += saved[b] + (convs[b] - 1) * (prefix(rep[b], depth[b] - 1) - prefix(rep[b], depth[p]))

    def branch(r: int, d: int) -> int:
        for column, value in ((depth, d), (rep, r), (convs, 0), (least, _NONE), (hung, _NONE), (children, 0), (leaves, 0), (saved, 0), (parent, -1), (shared, False)):
            column.append(value)
        return len(depth) - 1

    up, top = list(range(k)), list(range(k))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    lcp = np.array([common_units(a, b) for a, b in zip(e.path, e.path[1:])], np.int64)
    for j in np.argsort(-lcp, kind="stable").tolist():  # equal depths from left to right, so that the right one of two is always deeper
        a, b, d = find(j), find(j + 1), int(lcp[j])
        p = top[a]
        if depth[p] != d:
            p = branch(rep[p], d)
            attach(top[a], p)
        attach(top[b], p)
        up[b], top[a] = a, p
    root = top[find(0)]
    if depth[root]:
        old, root = root, branch(rep[root], 0)
        attach(old, root)
    close(root)

    open_, x, r = np.array(shared), np.array(depth), np.array(rep)
    above = np.array(parent)
    y = np.where(above >= 0, x[above], -1)
    convs, least, children, leaves, saved = (np.array(c, np.int64) for c in (convs, least, children, leaves, saved))
    done = np.flatnonzero(~open_)
    if len(done):
        n = (x - y)[done]
        v = np.repeat(done, n)
        below = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)  # steps above the node itself
        t, own = x[v] - below, below == 0
        sums = saved[v] + np.where(own, 0, (convs[v] - 1) * (before[at[r[v]] + np.maximum(x[v] - 1, 0)] - before[at[r[v]] + np.maximum(t - 1, 0)]))
        highest = t == y[v] + 1
        over = above[v]
        known = ~highest | ((over >= 0) & ~open_[over])
        over_id = np.where(highest, least[over], least[v])
        ending = own & (v < k) & np.where(v < k, e.ends[np.minimum(v, k - 1)] > 0, False)
        sha = [_EMPTY] * len(v)
        for i in np.flatnonzero(ending).tolist():
            sha[i] = e.ends_sha[v[i]]
        digest, pend = [None] * len(v), [None] * len(v)
        for i in np.flatnonzero(own).tolist():
            if later or sha[i] is None:
                digest[i] = hashlib.sha256(e.path[r[v[i]]][: UNIT * int(x[v[i]])]).digest()
        names: dict[int, bytes] = {}
        for i in np.flatnonzero(highest & (over >= 0) & ~known).tolist():
            p = int(over[i])
            if p not in names:
                names[p] = hashlib.sha256(e.path[r[p]][: UNIT * int(x[p])]).digest()
            pend[i] = names[p]
        rows = _table(kind=np.full(len(v), NODE), part=np.full(len(v), part), conv_id=least[v], depth=t, parent_conv_id=pa.array(over_id, pa.int64(), mask=~known), n_convs=convs[v], n_children=np.where(own, children[v], 1), n_leaves=leaves[v], saved_tokens=sums, ends_sha256=sha, digest=digest, pend=pend)
        for i in range(0, len(v), 10_000):
            yield rows.slice(i, 10_000)
    left = [int(p) for p in np.flatnonzero(open_ & (convs > 0))]
    if left:
        own = [p if p < k else None for p in left]
        ends = np.array([0 if i is None else e.ends[i] for i in own], np.int64)
        path = [e.path[r[p]][: UNIT * int(x[p])] for p in left]
        yield _table(
            kind=np.full(len(left), ENTRY), part=np.full(len(left), part), conv_id=[hung[p] for p in left], n_convs=convs[left] - ends, n_children=children[left], n_leaves=leaves[left], saved_tokens=saved[left],
            ends_sha256=[None if i is None else e.ends_sha[i] for i in own], digest=[hashlib.sha256(p).digest() for p in path], path=path, ends=ends, ends_min=[_NONE if i is None else int(e.ends_min[i]) for i in own], edge=[(p == first) + 2 * (p == last) for p in left],
        )


def _first_round(single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forests of a partition's sorted (path, conv_id)."""
        part = TaskContext.get().partitionId()
        path, ends, least, sha = [], [], [], []
        held: list[bytes] = []
        n_held, sent = 0, False

        def piece() -> pa.RecordBatch:
            nonlocal held, n_held, sent
            out = _table(kind=[PIECE], part=[part], conv_id=[int(held[0])], digest=[hashlib.sha256(path[-1]).digest()], ids=[b",".join(held)])
            held, n_held, sent = [], 0, True
            return out

        def ended(may_be_shared: bool) -> pa.RecordBatch | None:
            nonlocal held, n_held, sent
            out = None
            if sent or may_be_shared:
                sha.append(None)
                out = piece() if held else None
            else:
                sha.append(hashlib.sha256(b",".join(held)).hexdigest())
            held, n_held, sent = [], 0, False
            return out

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not path or p != path[-1]:
                    if path and (out := ended(len(path) == 1 and not single)) is not None:
                        yield out
                    path.append(p)
                    ends.append(0)
                    least.append(c)
                ends[-1] += 1
                held.append(b"%d" % c)
                n_held += len(held[-1]) + 1
                if n_held >= PIECE_BYTES:
                    yield piece()
        if not path:
            return
        if (out := ended(not single)) is not None:
            yield out
        zero = np.zeros(len(path), np.int64)
        entries = Entries(path, np.array(ends, np.int64), np.array(least, np.int64), sha, zero, np.full(len(path), _NONE), zero, zero, zero)
        yield from forest(entries, *((None, None) if single else (0, len(path) - 1)), part, False)

    return run


def _next_round(single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forests of the entries of neighbouring partitions, sorted by path and part."""
        part = TaskContext.get().partitionId()
        path, sums, sha = [], [], []
        left, right = (None, None), (None, None)  # part and place of the first and last paths
        for batch in batches:
            for p, own, n, m, n_convs, least, children, leaves, saved, s, edge in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "ends", "ends_min", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "edge"))):
                if not path or p != path[-1]:
                    path.append(p)
                    sums.append([0, _NONE, 0, _NONE, 0, 0, 0])
                    sha.append(None)
                a = sums[-1]
                sums[-1] = [a[0] + n, min(a[1], m), a[2] + n_convs, min(a[3], least), a[4] + children, a[5] + leaves, a[6] + saved]
                sha[-1] = s if s is not None else sha[-1]
                if edge & 1 and (left[0] is None or own < left[0]):
                    left = (own, len(path) - 1)
                if edge & 2 and (right[0] is None or own > right[0]):
                    right = (own, len(path) - 1)
        if path:
            c = np.array(sums, np.int64)
            yield from forest(Entries(path, c[:, 0], c[:, 1], sha, c[:, 2], c[:, 3], c[:, 4], c[:, 5], c[:, 6]), *((None, None) if single else (left[1], right[1])), part, True)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and hash of the ids of each node, from its pieces in order."""
    now, seen, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now:
                if now is not None:
                    out.append((now, seen.hexdigest()))
                now, seen = digest, hashlib.sha256(ids)
            else:
                seen.update(b",")
                seen.update(ids)
    if now is not None:
        out.append((now, seen.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["digest", "__ends"])


def trie_of(rows: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of (conv_id, path), each id once: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "trie")
    ordered = rows.select("path", "conv_id").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [stored(ordered.mapInArrow(_first_round(parts == 1), ROWS), folder, "round0")]
    while parts > 1:
        parts = -(-parts // fan)
        entries = rounds[-1].filter(F.col("kind") == ENTRY).withColumn("group", F.expr(f"part div {fan}").cast("int"))
        merged = dealt(entries.withColumnsRenamed({"part": "own", "group": "part"}), parts).withColumnsRenamed({"part": "group", "own": "part"}).sortWithinPartitions("path", "part")
        rounds.append(stored(merged.mapInArrow(_next_round(parts == 1), ROWS), folder, f"round{len(rounds)}"))
    every = None
    for number, table in enumerate(rounds):
        table = table.withColumn("round", F.lit(number))
        every = table if every is None else every.unionByName(table)
    nodes = every.filter(F.col("kind") == NODE)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # what waits for a later round: parents by the partition that they were contracted in, so that no key has more rows than a partition
    found = nodes.filter("round > 0 and digest is not null").select("digest", F.col("conv_id").alias("__parent"))
    parents = every.filter(F.col("kind") == ENTRY).select("round", "part", "digest").join(found, "digest").withColumnRenamed("digest", "pend")
    with tidy(spark):
        ends = stored(every.filter(F.col("kind") == PIECE).select("digest", "conv_id", "ids").repartition("digest").sortWithinPartitions("digest", "conv_id").select("digest", "ids").mapInArrow(_hashed, "digest binary, __ends string"), folder, "ends")
        parents = stored(parents, folder, "parents")
    waits = F.col("pend").isNotNull() | F.col("ends_sha256").isNull()
    whole = nodes.filter(~waits).select(*columns)
    rest = nodes.filter(waits).join(parents, ["round", "part", "pend"], "left").join(ends, "digest", "left")
    rest = rest.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "__parent"), "ends_sha256": F.coalesce("ends_sha256", "__ends")})
    return whole.unionByName(rest.select(*columns)).withColumn("depth", F.col("depth").cast("long"))


def prefix_trie(conversations: DataFrame, share: int = 20, longest: int = 4, parts: int | None = None) -> DataFrame:
    """One row a node of the trie of rebuilt conversations."""
    return trie_of(paths(conversations, share, longest), parts or parts_of(conversations))
