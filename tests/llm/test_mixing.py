"""Targets against plain water filling; the rounding's sums, bounds and reruns."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veiltrack.llm import mixing
from veiltrack.llm.mixing import mix_sources, source_targets, take_mix


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """By resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**fixed, **{s: left * weight[s] / w for s in free}}
        fixed |= {s: most * sizes[s] for s in over}


def corpus(seed, docs=3000):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", None, "zz"]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 20, 100]))) or None, rng.choices(names, [60, 20, 3, 1, 10, 5])[0]) for i in range(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_bounds_and_reruns(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(3).alias("size"), F.lit("k").alias("chunk"))
    got = mix_sources(df.repartition(7), chunk_rows=50, fan_in=4).collect()
    again = mix_sources(df.repartition(3, "text"), chunk_rows=50, fan_in=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source, size = {d: s for d, _, s in rows}, {d: len((t or "").split()) for d, t, _ in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for d, n in size.items():
        total[source[d]] += n
    want = targets(total)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        rate = r.target / r.source_size if r.size else 0
        assert r.size == 0 or int(rate) <= r.copies <= int(rate) + 1
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size.values())


def test_expected_copies(spark):
    rows = [(i, "w w", "a") for i in range(40)] + [(100 + i, "w w", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [sum(r.copies for r in mix_sources(df, (1.0, 3.0), seed=s, chunk_rows=8).collect() if r.doc_id < 20) for s in range(12)]
    assert sum(first) / len(first) == pytest.approx(10, abs=3)


def test_take_mix(spark):
    rows = corpus(3, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = {r.doc_id: r for r in mix_sources(df).collect()}
    taken = defaultdict(list)
    for r in take_mix(df).collect():
        taken[r.doc_id].append((r.copy, r.taken))
    assert {d: len(c) for d, c in taken.items()} == {d: r.copies for d, r in mixed.items() if r.copies}
    assert all(sorted(c) == [(i + 1, mixed[d].size) for i in range(len(c))] for d, c in taken.items())


def test_take_mix_of_rows_that_agree(spark):
    """Rows without a doc_id, or of one doc_id in two sources, are taken as often as the mix decided."""
    rows = [(None, f"w x{i}", "a") for i in range(100)] + [(None, "same words", "a")] * 50 + [(i, "w v", "b") for i in range(200)] + [(i, "w u", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mix_sources(df, (1.0, 3.0, 2.0)).collect():
        want[r.target] += r.taken
    taken = take_mix(df, weights=(1.0, 3.0, 2.0))
    for r in taken.collect():
        got[r.target] += r.taken
    assert got == {t: n for t, n in want.items() if n} and all(abs(t - n) <= 2 for t, n in got.items())
    again = take_mix(df.repartition(7), weights=(1.0, 3.0, 2.0))
    assert sorted(map(str, taken.collect())) == sorted(map(str, again.collect()))


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a"), (2, "", None), (None, "w", "a"), (3, "w " * 20_000, "a"), (3, "w " * 20_000, "a"), (4, "x y", "b")]
    got = mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 40_003
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert source_targets(spark.createDataFrame([(None, 0)], "source string, size long")).first().target == 0.0


def test_ids_of_text_and_clashing_columns(spark):
    rows = [(f"id{i}", "w " * (i % 9), "ab"[i % 2], i, 1.0, 7) for i in range(200)] + [(None, "w w", None, 0, 2.0, 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, target double, copies int").withColumn("__x", F.lit(1))
    mixed = {r.doc_id: r for r in mix_sources(df, chunk_rows=16).collect()}
    assert len(mixed) == 201 and mixed["id8"].size == 8
    got = take_mix(df, chunk_rows=16)
    assert got.columns == ["doc_id", "text", "source", "copies", "__x", "size", "source_size", "target", "copy", "taken"]
    taken = defaultdict(int)
    for r in got.collect():
        taken[r.doc_id] += r.taken
        assert r.copies == 7 and r.size == mixed[r.doc_id].size
    assert taken == {d: r.taken for d, r in mixed.items() if r.taken}


def test_ids_that_doubles_cannot_hold(spark):
    rows = [(2**60 + i, "w w w", "a") for i in range(20)] + [(None, "w", "a")] + [(i, "w w", "b") for i in range(30)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in got.collect()} == {d for d, _, _ in rows}


def test_many_sources(spark, monkeypatch):
    """Ranks over several ranges of names, with and without broadcast."""
    names = [f"s{i:03}" for i in range(90)] + ["é", "Z", "", None]
    rows = [(i, "w " * (1 + i % 7), names[i % len(names)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = df.select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len(t.split())
    want = targets(total)
    ranked = {r.source: (r.source_rank, r.target) for r in source_targets(sizes).collect()}
    assert [s for s, _ in sorted(ranked.items(), key=lambda x: x[1][0])] == sorted(names, key=lambda s: (s is None, s or ""))
    assert sorted(r for r, _ in ranked.values()) == list(range(len(names))) and all(ranked[s][1] == pytest.approx(want[s]) for s in names)
    one = sorted(map(str, mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    assert sorted(map(str, mix_sources(df).collect())) == one


def test_rows_without_ids_are_many_chunks(spark, monkeypatch):
    """Null ids: chunks by text; empty texts are in none; sums still hold."""
    rows = [(None, "w " * (1 + i % 18) + str(i), "a" if i % 3 else "b") for i in range(3000)] + [(None, None, "a")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, level = [], mixing._level

    def spied(chunks, at, seed):
        if at == 0:
            sizes.extend(r["count"] for r in chunks.groupBy("source_rank", "chunk").count().collect())
        return level(chunks, at, seed)

    monkeypatch.setattr(mixing, "_level", spied)
    got = mix_sources(df, chunk_rows=100, fan_in=4).collect()
    assert len(got) == 3500 and len(sizes) > 30 and max(sizes) < 300
    assert sum(r.size == 0 and r.taken == 0 for r in got) == 500
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 19
