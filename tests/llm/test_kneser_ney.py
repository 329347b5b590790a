"""The model against one counted and smoothed in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from veiltrack.llm.kneser_ney import _slices, discounts, score_held_out
from veiltrack.llm.queries import op1_lm_scoring

from .test_tokens import thue_morse

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</s>"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def expected(rows):
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            words.update(tokens(t))
            pairs.update(zip(["<s>", *tokens(t)], tokens(t)))
    total, types = sum(words.values()), len(words)
    before = Counter(w for _, w in pairs)
    d2 = (0, *discounts([Counter(pairs.values())[i] for i in (1, 2, 3, 4)]))
    d1 = (0, *discounts([Counter(before.values())[i] for i in (1, 2, 3, 4)]))
    after, kinds = Counter(), defaultdict(Counter)
    for (h, _), c in pairs.items():
        after[h] += c
        kinds[h][min(c, 3)] += 1
    mass = sum(d1[min(k, 3)] for k in before.values()) / len(pairs) if pairs else 1.0

    def low(w):
        k = before[w]
        return (max(k - d1[min(k, 3)], 0) / len(pairs) if pairs else 0) + mass / (types + 1)

    def both(h, w):
        if not after[h]:
            return low(w)
        c = pairs[h, w]
        return max(c - d2[min(c, 3)], 0) / after[h] + sum(d2[i] * kinds[h][i] for i in (1, 2, 3)) / after[h] * low(w)

    out = []
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        out.append((d, held(d), len(own), sum(words[w] > 0 for w in own), total, base, sum(math.log10(both(h, w)) for h, w in zip(["<s>", *own], own))))
    vocabulary = [*words, "never seen"]
    sums = [sum(both(h, w) for w in vocabulary) for h in ("<s>", *list(words)[:5])]
    return out, sums


def close(got, want):
    got = {r.doc_id: r for r in got}
    for d, h, n, known, total, base, score in want:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_on_the_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, sums = expected(rows)
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums)  # the model is a distribution
    got = score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=2).collect()
    close(got, want)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    third_order, sums = third(rows)
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums)
    close(op1_lm_scoring(spark, sf_dir).collect(), [(*w[:6], third_order[w[0]]) for w in want])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b a B"), (4, "x " * 3000), (5, "a b"), (6, "new words"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit("s").alias("part"))
    close(score_held_out(df, order=2).collect(), expected(rows)[0])


def test_without_training_rows(spark):
    ids = [d for d in range(200) if held(d)][:3]
    rows = [(d, "some words") for d in ids]
    got = score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0 for r in got)
    assert score_held_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def third(rows):
    """Scores at order three, and sums of p over the vocabulary after some histories."""
    words, pairs, triples = Counter(), Counter(), Counter()
    for d, t in rows:
        if not held(d):
            own = ["<s>", *tokens(t)]
            words.update(own[1:])
            pairs.update(zip(own, own[1:]))
            triples.update(zip(own, own[1:], own[2:]))
    types = len(words)
    middle = Counter((v, w) for _, v, w in triples)
    middle.update({q: c for q, c in pairs.items() if q[0] == "<s>"})
    assert middle.keys() == pairs.keys()
    before = Counter(w for _, w in pairs)
    d1, d2, d3 = ((0, *discounts([Counter(c.values())[i] for i in (1, 2, 3, 4)])) for c in (before, middle, triples))
    after, kinds = Counter(), defaultdict(Counter)
    for c in (middle, triples):
        for g, n in c.items():
            after[g[:-1]] += n
            kinds[g[:-1]][min(n, 3)] += 1
    mass = sum(d1[min(k, 3)] for k in before.values())

    def p(h, w):
        if not h:
            return (max(before[w] - d1[min(before[w], 3)], 0) + mass / (types + 1)) / len(pairs)
        if not after[h]:
            return p(h[1:], w)
        c, d = (triples, d3) if len(h) == 2 else (middle, d2)
        n = c[(*h, w)]
        return (max(n - d[min(n, 3)], 0) + sum(d[i] * kinds[h][i] for i in (1, 2, 3)) * p(h[1:], w)) / after[h]

    out = {}
    for d, t in rows:
        own = ["<s>", *tokens(t)]
        out[d] = sum(math.log10(p(tuple(own[max(0, i - 2) : i]), own[i])) for i in range(1, len(own)))
    return out, [sum(p(h, w) for w in [*words, "never seen"]) for h in [("<s>",), *list(pairs)[:5]]]


def test_order_three(spark, sf_dir):
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for rows in (some, [(1, None), (2, ""), (3, "a b a B"), (4, "x " * 3000), (5, "a b"), (6, "new words"), (None, "no id")]):
        want, sums = third(rows)
        assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums)
        got = score_held_out(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()
        assert {r.doc_id for r in got} == want.keys()
        assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    ids = [d for d in range(200) if held(d)][:3]
    alone = score_held_out(spark.createDataFrame([(d, "some words") for d in ids], "doc_id long, text string"), order=3).collect()
    assert all(r.score == 0.0 for r in alone)


def test_histories_with_many_triples(spark):
    """More than HEAVY triples after one history, and counts that need more than a byte."""
    rows = [(i, f"a b w{i % 400} a b w{i % 7}") for i in range(900)] + [(1000, "a b c " * 500), (1001, "b a b never")]
    want, _ = third(rows)
    got = score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_words_that_polynomials_confuse(spark):
    one, other = thue_morse(10)
    out = next(d for d in range(100) if held(d))
    rows = [(d, one) for d in range(20) if not held(d)] + [(out, other)]
    got = {r.doc_id: r.n_known for r in score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(out) == 1 and set(got.values()) == {2}


def test_some_megabytes_are_looked_up_together():
    """Fewer lookups a token than slice by slice of one megabyte; longer texts are still bounded slices."""
    assert list(_slices(pa.array(["a b " * 250_000] * 9))) == [(0, 4), (4, 8), (8, 9)]
