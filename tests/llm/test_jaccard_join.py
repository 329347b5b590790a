"""The grouped prefix join against all pairs."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltrack.llm import jaccard_join
from veiltrack.llm.jaccard_join import drop_near_copies, link_documents

from .test_tokens import thue_morse


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def expected(rows):
    """By all pairs: (doc_id, set size, smallest linked doc_id) a row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, families, most):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(12)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own += passage
            out.append(" ".join(own))
            base = own if rng.random() < 0.5 else base  # chains of copies of copies
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, families, most", [(1, 12, 9), (2, 3, 60), (3, 40, 3)])
def test_against_all_pairs(spark, seed, families, most):
    rows = corpus(seed, families, most)
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, "one two three four five"), (7, "x"), (7, "x"), (8, "long " * 5000), (9, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("unit"), F.lit("q").alias("token"))
    assert sorted(tuple(r) for r in link_documents(df).collect()) == expected(rows)
    assert sorted({r.doc_id for r in drop_near_copies(df).collect()}) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert drop_near_copies(df).columns == df.columns


def test_empty_table_and_null_id(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "same words here all day"), (5, "same words here all day"), (None, "other words here all day")]
    got = {(r.doc_id, r.component_id) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def near_threshold(seed, pairs):
    """Pairs at the threshold: three in four of all shingles in common, the others dealt to both at random."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    out = []
    for _ in range(pairs):
        common = 3 * rng.randint(4, 16)
        core, own = [word() for _ in range(common + 4)], rng.randint(0, common // 3)
        out += [" ".join(core + [word() for _ in range(own)]), " ".join(core + [word() for _ in range(common // 3 - own)])]
    return list(enumerate(out))


def test_near_the_threshold_with_a_small_sketch(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCH", 1024)
    rows = near_threshold(2, 60)
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_rows_are_dropped_one_by_one(spark):
    """Rows without a doc_id, or of one doc_id with other texts, stay unless they are linked themselves."""
    rows = [(None, "same words here all day"), (5, "same words here all day"), (None, "other words here all day"), (None, None), (9, "same words here all day"), (9, "nothing like it at all"), (7, "")]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[1], rows[2], rows[3], rows[5], rows[6]], key=str)


def chained_by_a_third(seed, n):
    """A, B = A and twenty words more (80 of 100 shingles in common), and C, which has the end of A and three hundred words of its own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    out = []
    for _ in range(n):
        a = [word() for _ in range(84)]
        out += [a, a + [word() for _ in range(20)], a[-64:] + [word() for _ in range(300)]]
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def with_long_passages(seed, docs, passages):
    """Passages of 20 to 80 words that stand in texts which are mostly not alike; some are."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [[word() for _ in range(rng.randint(20, 80))] for _ in range(passages)]
    out = []
    for _ in range(docs):
        own = [word() for _ in range(rng.randint(0, 60))] + rng.choice(shared) + [word() for _ in range(rng.choice([0, 3, 10, 60, 200]))]
        out.append(own)
        if rng.random() < 0.3:
            out.append(own + [word() for _ in range(rng.randint(1, max(1, len(own) // 3)))])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("corpora", [[chained_by_a_third(1, 20), with_long_passages(2, 250, 12)], [with_long_passages(3, 250, 3), with_long_passages(4, 200, 40)]])
def test_passages_of_unlinked_documents(spark, corpora):
    rows = [(i * 2 + k, t) for k, rows in enumerate(corpora) for i, t in rows]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_words_that_polynomials_confuse(spark):
    one, other = thue_morse(10)
    rows = [(1, f"a b {one} c d"), (2, f"a b {other} c d"), (3, f"a b {other} c d")]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_postings_of_near_copies_and_tables_kept(spark, monkeypatch):
    """A pair of near copies has one posting each, however long its texts; passages of texts of other sizes have none; no table outlasts its use."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    rows, tail = [], [word() for _ in range(40)]
    for i in range(30):
        base = [word() for _ in range(200)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:100] + [word()] + base[101:]))]
    rows += [(100 + i, " ".join([word() for _ in range(100 * 2**i)] + tail)) for i in range(4)]
    seen, stored = {}, jaccard_join.stored

    def noted(df, folder, name):
        out = stored(df, folder, name)
        if name == "postings":
            seen["postings"] = out.count()
        if name == "final":
            seen["kept"] = {x.split(".")[0] for x in os.listdir(folder)}
        return out

    monkeypatch.setattr(jaccard_join, "stored", noted)
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)
    assert seen["postings"] == 60
    assert not {x for x in seen["kept"] if re.match("units|postings|tokens|posted|heads|labelled|asked", x)}


@pytest.mark.parametrize("percent", [1, 50, 75, 95, 100])
def test_partners_by_size_and_place(percent):
    """No two sets that may link by a first shingle in common are missed; sets of far sizes don't meet."""
    rng = np.random.default_rng(percent)
    for _ in range(200):
        k = int(rng.integers(1, 12))
        n = np.exp(rng.uniform(0, rng.choice([3, 8, 26]), k)).astype(np.int64) + 1 if rng.random() < 0.5 else rng.integers(1, 60, k)
        pos = (rng.random(k) * jaccard_join.prefix_size(n, percent)).astype(np.int64)
        token = rng.integers(0, 3, k).astype(np.uint64) << np.uint64(40)
        key = jaccard_join._keys(token, n, pos, percent)
        keys, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        met, first = (x[back] for x in jaccard_join._partners(keys, counts))
        for i in range(k):
            others = [j for j in range(k) if j != i and token[j] == token[i]]
            size = [j for j in others if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])]
            assert met[i] or not size
            assert first[i] or not [j for j in size if min(n[i] - pos[i], n[j] - pos[j]) * (100 + percent) >= (n[i] + n[j]) * percent]
            far = 2 * max(100 / percent, 1.05)
            assert not met[i] or n.max() > 1000 or [j for j in others if min(n[i], n[j]) * far >= max(n[i], n[j]) - 8]
            assert met[i] or not first[i]


def test_tables_of_few_rows_have_few_files(spark, monkeypatch, tmp_path):
    """However many partitions shuffles have, a small input's tables and exchanges are dealt to two tasks a core at most."""
    rows = corpus(8, 12, 4)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    most, files, stored, owned, exchanges = 2 * spark.sparkContext.defaultParallelism, {}, jaccard_join.stored, jaccard_join.owned, set()

    def noted(df, folder, name):
        out = stored(df, folder, name)
        files[name] = len(out.inputFiles())
        return out

    def dealt(blocks, parts, *more):
        exchanges.add(parts)
        return owned(blocks, parts, *more)

    monkeypatch.setattr(jaccard_join, "stored", noted)
    monkeypatch.setattr(jaccard_join, "owned", dealt)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(tuple(r) for r in link_documents(spark.read.parquet(f"{tmp_path}/docs")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected(rows)
    assert exchanges == {most} and max(files.values()) <= most
