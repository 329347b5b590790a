"""The trie against sets of prefixes, over any number of partitions."""

import hashlib
import random
import re
import zlib

import pytest

from veiltrack.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, share=20, longest=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            unit = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + "%08X" % len(re.findall(r"[^\x20\x09-\x0D]+", text))
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, unit, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    if share == 1:
        return own
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % longest, c - (abs(c) % share) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def expected(rows, share=20, longest=4):
    members = {}
    for c, turns in rebuilt(rows, share, longest).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[x] for x in own) or 1
        saved[p] = sum(saved[x] for x in own) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c, e in sorted(m) if e)
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def talk(rng, n, vocabulary=3, longest=7):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 2 else "user", rng.choice(["a b", "c", "d e f"][:vocabulary])))
    return rows


@pytest.mark.parametrize("parts, fan", [(1, 32), (2, 2), (7, 2), (40, 3), (300, 32)])
def test_against_sets(spark, parts, fan):
    rng = random.Random(parts)
    rows = talk(rng, 400)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.trie_of(pt.paths(df), parts, fan)) == expected(rows)
    assert got(pt.trie_of(pt.paths(df, 1), parts, fan)) == expected(rows, 1)


def test_hot_and_long(spark, monkeypatch):
    """One conversation of which most are copies, many that share one first turn, one of many turns, one turn that is a prefix of all."""
    monkeypatch.setattr(pt, "PIECE_BYTES", 64)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)] + [(1000 + c, t, "user", "same 0" if t == 0 else f"{c} {t}") for c in range(100) for t in range(3)]
    rows += [(5000, t, "user", f"same {t}") for t in range(700)] + [(5020, 0, "user", "same 0"), (5040, 0, "user", "other")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for parts in (1, 5, 37):
        assert got(pt.trie_of(pt.paths(df, 1), parts, 4)) == expected(rows, 1)
    assert got(pt.prefix_trie(df, parts=11)) == expected(rows)


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, negative ids, conversations that lose all turns, clashing columns."""
    rows = [(0, 0, "user", "x"), (0, None, None, None), (0, 1, "user", "y"), (0, 1, "user", "y"), (0, 1, "bot", "y"), (None, 0, "user", "lost"), (7, 0, "user", "x"), (-3, 0, "user", "x"), (-3, 1, "bot", "y  \t z"), (-20, 0, "bot", "w"), (41, 0, "", "ua"), (43, 0, "u", "a")]
    rows += [(c, 0, "user", "") for c in range(100, 130)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA + ", path int, digest string")
    for parts in (1, 3):
        assert got(pt.prefix_trie(df, parts=parts)) == expected(rows)
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in expected(rows))  # some end at the root
    assert got(pt.prefix_trie(df.limit(0), parts=3)) == [] == got(pt.prefix_trie(df.limit(0), parts=1))


def test_query_on_the_tables(spark, sf_dir):
    from veiltrack.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, sf_dir)) == expected(rows)
