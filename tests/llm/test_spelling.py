"""Spelling variants against all edits of all words."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veiltrack.llm import spelling as sp

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def expected(rows):
    n = counts(rows)
    less = {}
    for w in n:
        for i in range(len(w)):
            less.setdefault(w[:i] + w[i + 1 :], set()).add((i, w))
    form, near = {}, {w: set() for w in n}
    for rest, own in less.items():
        for i, w in own:
            near[w] |= {x for j, x in own if j == i and x != w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def texts(rng, n):
    stems = ["".join(rng.choice(["er", "an", "the", "ing", "st", "é", "ß", "o", "ti", "on"]) for _ in range(rng.randrange(3, 6))) for _ in range(60)]
    for d in range(n):
        out = []
        for _ in range(rng.randrange(1, 120)):
            w = rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 3)])
            if rng.random() < 0.08:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeioé") + w[k:], w[:k] + rng.choice("xyz") + w[k + 1 :]])
            out.append(rng.choice([str, str.upper, str.title])(w))
        yield d, rng.choice([" ", ", ", "-", "Ā", "中", "1"]).join(out)


ODD = [(None, "Gleichung gleichung GLEICHUNG"), (5000, None), (5001, ""), (5002, "×÷abcdefg ×÷abcdefg Ünderung Ünderung ünderung ünderung"), (5003, "gleichung " * 300), (5003, "gleichung " * 300), (5004, "a" * 3000 + " " + "a" * 3000), (5005, ("a" * 3001 + " ") * 3), (5006, ("b" * 1500 + "c" + "b" * 1500 + " ") * 2 + ("b" * 1500 + "d" + "b" * 1500 + " ") * 40)]


@pytest.mark.parametrize("options", [{}, {"LEAST_PLACES": 1, "MOST_GRAMS": 1 << 20}, {"LEAST_PLACES": 10_000_000}, {"LEAST_PLACES": 2, "LONGEST": 3}, {"LIST_WORDS": 1, "LEAST_PLACES": 3}])
def test_against_all_edits(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(sp, name, value)
    rows = [*texts(random.Random(len(options)), 150), *ODD]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = expected(rows)
    assert got(sp.group_variants(df)) == want
    assert sum(r[1] is not None for r in want) > 20 and max(r[4] for r in want) > 3


def test_lists_hold_every_pair(monkeypatch):
    """Words one edit apart share the list, the place and the digest of one cut, whatever the dictionary."""
    rng = random.Random(7)
    for grams in (sp.Grams(np.empty(0, np.uint64), np.empty(0, np.int64), 5), None):
        for _ in range(150):
            w = "".join(rng.choice("abé") for _ in range(rng.randrange(7, 14)))
            if grams is None or len(grams.codes):
                own = [sp.gram_codes(np.frombuffer(w.encode("latin-1"), np.uint8).reshape(1, -1), q).ravel() for q in range(2, 6)]
                codes = np.unique(np.concatenate(own))
                codes = codes[np.array([rng.random() < 0.6 for _ in codes])]
                grams = sp.Grams(codes, np.array([rng.randrange(5, 50) for _ in codes], np.int64), 5)
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            x = w[:k] + ("", "z", w[k] + rng.choice("abé"))[kind] + w[k + 1 :]
            seen = []
            for t in (w, x):
                m = np.frombuffer(t.encode("latin-1"), np.uint8).reshape(1, -1)
                key, digest = sp.index_keys(m, grams)
                n = len(t)
                seen.append({(c if c < n else c - n, n - 1 if c < n else n, int(key[0, c]), int(digest[0, c])) for c in range(2 * n + 1)})
            assert seen[0] & seen[1] or w == x, (w, x)


def test_equal_hashes_are_taken_apart(monkeypatch):
    """Grouping by hashes alone would call all of these near; the comparison of texts tells them apart."""
    monkeypatch.setattr(sp, "_left_hash", lambda matrix, cut: np.zeros(len(matrix), np.uint64))
    own = [b"abcdefgh", b"abcdefgx", b"zzzzzzzz", b"abcdefg", b"yyyyyyy"]
    word = np.repeat(np.arange(5), [len(w) * 2 + 1 for w in own])
    cut = np.concatenate([np.arange(len(w) * 2 + 1) for w in own])
    who, met, best = sp.merge_lists(own, np.array([5, 50, 7, 9, 9]), word, cut, np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint32))
    total = {}
    for w, m, b in zip(who.tolist(), met.tolist(), best.tolist()):
        a = total.setdefault(own[w], [0, set()])
        a[0] += m
        a[1].add(own[b])
    assert total == {b"abcdefgh": [2, {b"abcdefgx", b"abcdefg"}], b"abcdefgx": [2, {b"abcdefgh", b"abcdefg"}], b"abcdefg": [2, {b"abcdefgx"}]}


def test_crc_goes_on():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = np.sort(rng.integers(0, 4000, 200))
    end = start + rng.integers(0, 900, 200)
    state = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, state)]
    assert sp.crc_after(state, data, start, end).tolist() == want and len(sp.crc_after(state[:0], data, start[:0], end[:0])) == 0


def test_words_are_counted_whole():
    rows = [*texts(random.Random(9), 40), *ODD]
    found = {}
    sp.count_words(pa.array([None if d is None else str(d) for d, _ in rows]), pa.array([t for _, t in rows]), found)
    assert {w.decode(): k for w, k in found.items() if k >= 2} == counts(rows)


def test_chains_and_empty(spark):
    """Forms are followed to the last; an empty table gives no rows."""
    rows = [(i, t) for i, t in enumerate(["abcdefgh " * 2, "abcdefgi " * 30, "abcdefgij " * 500, "abcdefgijk " * 9000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert got(sp.group_variants(df)) == want and len({r[2] for r in want if r[0].startswith("abcdefg")}) <= 2
    assert got(sp.group_variants(df.limit(0))) == []
    assert got(sp.group_variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string"))) == []
