"""The corpus pipeline against each stage's rule in plain Python; the guard of the entry points."""

import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from veiltrack.llm.decontaminate import find_contamination

from .test_jaccard_join import expected as components
from .test_mixing import targets

ROOT = Path(__file__).resolve().parents[2]


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert all(tuple(kept[d]) == tuple(r) for d, r in rows.items())
        if number == 0:
            want = {d for d, r in kept.items() if any(c.isalpha() for c in r.text or "")}
        elif number == 1:
            last = {}
            for d, r in kept.items():
                last[r.text] = max(d, last.get(r.text, d))
            want = set(last.values())
        elif number == 2:
            want = {d for d, _, c in components([(d, r.text) for d, r in kept.items()]) if d == c}
        else:
            before = spark.read.parquet(str(tmp_path / "2"))
            want = {r.doc_id for r in find_contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if not r.contaminated}
        assert set(rows) == want
        kept = rows
    size = {d: len((r.text or "").split()) for d, r in kept.items()}
    total, taken, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in kept.items():
        total[r.source] += size[d]
    want = targets(total)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert r.text == kept[r.doc_id].text and r.taken == size[r.doc_id]
        taken[r.source] += r.taken
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= max(size.values()) for s in total)


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


WORDS = "the quick brown fox jumps over a lazy dog and runs far away from here today".split()


def odd_documents():
    """Null and empty texts, very long ones, ties, repeated rows, null ids and sources, and columns by names that stages use."""
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !!", None, None), (4, " ".join(WORDS), "en", "b"), (4, " ".join(WORDS), "en", "b"), (5, " ".join(WORDS), "en", "a"), (None, "no id but words", None, "b"), (None, None, None, None)]
    rows += [(10, " ".join(f"{w}{i}" for i in range(4000) for w in WORDS[:5]), "en", "a"), (11, " ".join([*(f"{w}{i}" for i in range(4000) for w in WORDS[:5]), "one more"]), "en", "a"), (12, "x" * 300_000 + " y", "en", None)]
    rows += [(20 + i, " ".join(random.Random(i).choices(WORDS, k=30)), "en", "ab"[i % 2]) for i in range(20)]
    return [(*r, len(r[1] or ""), 7, "kept", 1.5, -3) for r in rows]


ODD = "doc_id long, text string, lang string, source string, n_chars int, size int, `key` string, target double, unit int"


def test_stages_on_odd_documents(spark, sf_dir, tmp_path):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, ODD)
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert number == 4 or out.columns == docs.columns
        kept[name] = sorted((tuple(r)[: 5 if number == 4 else 9] for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    some = lambda test: sorted((r for r in rows if test(r)), key=str)
    assert kept["language ID"] == some(lambda r: any(c.isalpha() for c in r[1] or ""))
    exact = kept["exact dedup"]
    assert len(exact) == len({r[1] or "" for r in rows}) and (5, *rows[5][1:]) in exact and rows[1] in exact and rows[7] not in exact
    near = kept["n-gram Jaccard join"]
    assert [r[0] for r in near if r[0] in (4, 5, 10, 11)] == [10, 4, 4] and all(r in near for r in (rows[0], rows[1], rows[2], rows[6], rows[7], rows[10]))
    assert kept["benchmark decontamination"] == some(lambda r: True)
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "unit", "size", "source_size", "target", "copy", "taken"]
    want = targets({s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    taken = defaultdict(int)
    for r in mixed.collect():
        assert r.size == r.taken == len(r.text.split()) > 0 and r.unit == -3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 20_002 for s, t in want.items())


def test_entry_without_the_subpackage(tmp_path):
    """What is left still imports and keeps its queries."""
    code = "import sys; sys.modules['veiltrack.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, own = map(int, out.stdout.split())
    assert n > 50 and own == 0
