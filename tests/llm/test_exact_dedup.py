"""The extendible-hash index, with keys that collide as well."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veiltrack.llm import exact_dedup
from veiltrack.llm.exact_dedup import build_index, drop_copies, look_up, mark_copies


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 37}") for i in range(300)] + [(1000 + i, f"only {i}") for i in range(100)] + [(2000, None), (2001, ""), (2002, "A"), (2003, "a"), (2004, "é" * 30_000), (2005, "é" * 30_000), (7, "text 7"), (None, "text 7"), (None, "none")]


@pytest.mark.parametrize("options", [{}, {"key_bits": 3}, {"key_bits": 1, "bucket_rows": 4, "directory_bits": 6}, {"bucket_rows": 8, "directory_bits": 10}])
def test_against_groups(spark, options):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit(2).alias("keep_id")).repartition(5)
    got = mark_copies(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_buckets_split_and_chains_are_numbered(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = build_index(df, bucket_rows=8, directory_bits=10)
    assert index.directory.agg(F.max("depth")).first()[0] >= 4
    assert index.pages.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 8
    chained = build_index(df, key_bits=2).pages
    assert chained.groupBy("key").agg(F.max("chain").alias("c"), F.count("*").alias("n"), F.max("chain_size").alias("s")).filter("c <> n or s <> n").count() == 0


def test_drop_keeps_one_row_of_each_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = drop_copies(df)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(rows) == len({t for _, t in rows}) == len({t or "" for _, t in ROWS})
    assert set(rows) == {(k, t or "") for (d, t), (_, k) in ((r, (r[0], max((x for x, y in ROWS if (y or "") == (r[1] or "") and x is not None), default=None))) for r in ROWS) if d == k}


def test_normalised_and_empty(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in mark_copies(df, normalise=F.lower).collect()) == [(1, 2), (2, 2), (3, 3)]
    assert mark_copies(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0


def test_lookups_go_through_the_directory(spark):
    """Whatever the directory doesn't lead to isn't found."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = build_index(df, bucket_rows=8, directory_bits=10)
    rows = exact_dedup._texts(df, "doc_id", "text", None, index.key)
    want = sorted((r[:3] for r in map(tuple, mark_copies(df).collect())), key=str)
    assert sorted((tuple(r)[:3] for r in look_up(rows, index, 1).collect()), key=str) == want
    assert sorted((tuple(r)[:3] for r in look_up(rows, index, 10_000).collect()), key=str) == want  # all slots are hot
    wrong = index._replace(directory=index.directory.withColumn("depth", F.col("depth") - 1))
    lost = look_up(rows, wrong, 1).filter("text_sha256 is null").count()
    assert lost > len(ROWS) // 4
    short = index._replace(directory=index.directory.filter("prefix % 2 = 0"))
    assert 0 < look_up(rows, short, 1).filter("text_sha256 is null").count() < len(ROWS)
    other = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    assert look_up(exact_dedup._texts(other, "doc_id", "text", None, index.key), index).first().keep_id is None


def test_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = mark_copies(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
