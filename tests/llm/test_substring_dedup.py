"""Recompression against all windows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veiltrack.llm.substring_dedup import recompress, remove_repeats
from veiltrack.llm.tokens import words

from .test_tokens import thue_morse


def expected(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus(seed, letters, docs, passage, runs):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 2)))
    shared = [[word() for _ in range(rng.randint(passage - 4, passage * 3))] for _ in range(4)]
    out = []
    for _ in range(docs):
        own = []
        for _ in range(rng.randint(1, 4)):
            own += [word() for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.5:
                piece = rng.choice(shared)
                a = rng.randrange(len(piece))
                own += piece[a : a + rng.randint(passage // 2, passage * 2)]
            if runs and rng.random() < 0.4:
                own += [word()] * rng.randint(passage - 2, passage * 2)
            if runs and rng.random() < 0.3:
                own += [word(), word()] * rng.randint(passage // 2 - 1, passage)
        out.append(" ".join(own))
    return list(enumerate(out))


@pytest.mark.parametrize("seed, letters, window, runs", [(1, "abcdefghij", 10, False), (2, "ab", 12, True), (3, "abcdefghij", 35, True), (4, "a", 8, True)])
def test_against_all_windows(spark, seed, letters, window, runs):
    rows = corpus(seed, letters, 40, window, runs)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, window)


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "a b c"), (5, "a  b\tc"), (5, "a  b\tc"), (6, long), (7, long + " end"), (None, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n_words"), F.lit(1).alias("part"))
    assert sorted((tuple(r) for r in remove_repeats(df, 3).collect()), key=str) == expected(rows, 3)
    assert remove_repeats(df.limit(0), 3).count() == 0


def test_symbols_depend_on_their_stretch_only():
    rng = np.random.default_rng(0)
    inner = [str(x) for x in rng.integers(0, 5, 60)]
    a, b = ([str(x) for x in rng.integers(0, 5, 40)] for _ in range(2))
    sets = []
    for outer in (a, b):
        sym, lo, hi = recompress(words(pa.array([" ".join(outer + inner + outer[::-1])])))
        own = (lo >= 40) & (hi <= 100)
        sets.append({(int(s), int(x), int(y)) for s, x, y in zip(sym[own], lo[own], hi[own])})
    assert sets[0] == sets[1] and sets[0]


def test_words_that_polynomials_confuse(spark):
    """Texts that differ in one such word share no window with it."""
    one, other = thue_morse(10)
    rest = [f"w{i}" for i in range(17)]
    rows = [(1, " ".join([*rest, one, *rest])), (2, " ".join([*rest, other, *rest])), (3, " ".join([*rest, other, *rest]))]
    got = remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    assert {r.n_removed for r in got.collect()} == {0}
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 35, 3: 35}
