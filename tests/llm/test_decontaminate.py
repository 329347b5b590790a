"""Benchmark windows against plain search; blocks; what is removed."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veiltrack.llm.decontaminate import cut_spans, drop_contaminated, find_contamination

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, n):
    windows = [(str(i), tuple(w[k : k + min(n, len(w))])) for i, t in items if i is not None and (w := split(t)) for k in range(len(w) - min(n, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, who = split(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    who.add(i)
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(found):
    rows = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256), "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Aa", "b", "cé", "d1", "E"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 7, 12])))) for k in range(9)] + [(3, "second row of three"), (None, "b b b")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            text += re.split(" ", rng.choice(items)[1])
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs, items


@pytest.mark.parametrize("seed, n", [(1, 4), (2, 6)])
def test_against_plain_search(spark, seed, n):
    docs, items = corpus(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(find_contamination(d, b, n)) == expected(docs, items, n)
    assert result(find_contamination(d, b, n, broadcast_bytes=40)) == expected(docs, items, n)  # in blocks on shared files


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (4, "One TWO three"), (4, "One TWO three"), (None, "one two"), (5, "zero " * 100 + "one two three " + "zero " * 20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("n_hit"), F.lit(2).alias("__other"))
    b = spark.createDataFrame([(7, "one two three"), (8, None)], "item_id long, text string")
    assert result(find_contamination(d, b)) == expected(docs, [(7, "one two three")], 13)
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "None"]
    assert result(find_contamination(d.limit(0), b)) == [] and result(find_contamination(d, b.limit(0))) == expected(docs, [], 13)


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "Été one TWO three, four"), (2, None), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [(r.doc_id, r.text) for r in cut_spans(d, b).orderBy("doc_id").collect()] == [(1, "Été , four"), (2, None), (3, "clean")]
