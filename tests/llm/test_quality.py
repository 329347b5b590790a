"""The quality classifier: features and updates by hand, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veiltrack.llm import quality as q


def test_features_of_a_text_stand_alone():
    texts = ["The cat, the cat!!", "", None, "x " * 50, "é" * 5000 + " | " + "b" * 300_000, "!!", "The cat, the cat!!"]
    at, x, first = q.features(pa.array(texts))
    assert len(first) == len(texts) + 1 and first[1] - first[0] > 0 and first[2] == first[1] == first[3]
    for i, t in enumerate(texts):
        own_at, own_x, own_first = q.features(pa.array([t], pa.string()))
        assert np.array_equal(at[first[i] : first[i + 1]], own_at) and np.allclose(x[first[i] : first[i + 1]], own_x) and own_first[-1] == len(own_at)
        assert len(np.unique(own_at)) == len(own_at) and (not len(own_at) or abs(float((own_x.astype(float) ** 2).sum()) - 1) < 1e-4)


def test_counts_are_those_of_runs():
    """One-token features of a text of known tokens: a bucket a word and sign, with one plus the logarithm of its count."""
    at, x, _ = q.features(pa.array(["a b a ! a"]), order=1)
    own = lambda t: int(q.mix(q.words(pa.array([t]), q._WORD).hash + np.uint64(1))[0] >> np.uint64(64 - q.BITS))
    value = dict(zip(at.tolist(), x.tolist()))
    assert math.isclose(value[own("a")] / value[own("b")], 1 + math.log(3), rel_tol=1e-5)


def test_updates_against_plain_python():
    rng = random.Random(3)
    leader, z, n = q.Leader(12), [0.0] * 12, [0.0] * 12
    for _ in range(300):
        at = sorted(rng.sample(range(12), 5))
        x, label = [rng.uniform(0.1, 1) for _ in at], rng.randrange(2)
        w = []
        for i in at:
            w.append(0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2))
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, v, own in zip(at, x, w):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * own
            n[i] += g * g
        assert math.isclose(leader.learn(np.array(at), np.array(x), label), p, rel_tol=1e-9)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def texts_of(rng, n):
    words = [f"w{i}" for i in range(300)]
    for i in range(n):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        yield i, " ".join(body) + "." if good else " | ".join(body), int(good)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    made = list(texts_of(rng, 1500))
    docs = [(i, t, "de", 1.0) for i, t, _ in made] + [(2000, None, None, 1.0), (2001, "", "de", 1.0), (None, "no id | here", "de", 1.0), (5, "w1 w2. w3", "de", 1.0), (7, made[7][1], "fr", 1.0), (2002, "word " * 100_000, "de", 1.0)]
    labels = [(i, y, 0, "x") for i, _, y in made] + [(2000, 1, 0, "x"), (3, None, 0, "x"), (4, 7, 1, "x"), (None, 1, 0, "x"), (6, 1 - made[6][2], 0, "x"), (9999, 1, 0, "x")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").repartition(3)
    rows = q.score_held_out(d, y).collect()
    assert len(rows) == len(docs)
    truth = {i: y for i, _, y in made}
    own = [r for r in rows if r.doc_id in truth and r.held_out and r.doc_id not in (5, 6)]
    assert len(own) > 200 and sum(r.predicted == truth[r.doc_id] for r in own) / len(own) > 0.98
    for r in rows:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r.score for r in rows}
    assert by[2000] == by[2001]  # null and empty
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    again = {r.doc_id: r.score for r in q.score_held_out(d.repartition(2), y).collect() if r.doc_id != 5}
    assert all(again[k] == v for k, v in by.items() if k != 5)  # reruns agree, however rows are dealt


def test_labels_are_not_inputs_of_a_score(spark):
    """Equal texts have equal scores whatever else their rows say, and labels of held-out rows change nothing."""
    rng = random.Random(2)
    made = list(texts_of(rng, 300))
    d = spark.createDataFrame([(i, t) for i, t, _ in made] + [(1000 + i, t) for i, t, _ in made], "doc_id long, text string")
    labels = [(i, y) for i, _, y in made]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    schema = "doc_id long, quality int"
    one, two = ({r.doc_id: r.score for r in q.score_held_out(d, spark.createDataFrame(x, schema)).collect()} for x in (labels, turned))
    assert one == two and all(one[i] == one[1000 + i] for i, _, _ in made)


@pytest.mark.parametrize("n_docs, n_labels", [(0, 5), (5, 0), (0, 0)])
def test_empty_tables(spark, n_docs, n_labels):
    d = spark.createDataFrame([(i, "a b") for i in range(10)], "doc_id long, text string").limit(n_docs)
    y = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int").limit(n_labels)
    rows = q.score_held_out(d, y).collect()
    assert len(rows) == n_docs and all(r.score == 0.5 for r in rows)


def test_keep_and_sample(spark):
    d = spark.createDataFrame([("a", "x y", 0.0), ("b", "z", 1.0)], "doc_id string, text string, score double")
    out = q.score_quality(d, q.Model(np.zeros((1 << q.BITS) + 1, np.float32), 2), ("doc_id", "text", "score"))
    assert out.columns == ["doc_id", "text", "score"] and {r.score for r in out.collect()} == {0.5}
    many = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    n = q.sample(many, many.selectExpr("doc_id", "1 as quality"), sample_docs=500).count()
    assert 350 < n < 650


def test_query_learns_the_tables(spark, sf_dir):
    from veiltrack.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_quality_classifier"](spark, sf_dir).collect()}
    truth = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None]
    held = [(got[i].predicted, y) for i, y in truth if got[i].held_out]
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and sum(p == y for p, y in held) / len(held) >= 0.85
