"""Planted templates, whole and altered, against full alignment."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veiltrack.llm.license_scan import align, build_index, scan_licenses, winnow
from veiltrack.llm.license_templates import TEMPLATES
from veiltrack.llm.queries import op4_license_scan
from veiltrack.llm.tokens import ALNUM_WORDS, rolling, words


def hashed(text):
    return words(pa.array([text]), ALNUM_WORDS, lower=True).hash


def test_winnowing_keeps_one_of_each_window():
    h = rolling(hashed(TEMPLATES["MIT"]), 3)
    kept = winnow(h, 3)
    assert all(any(lo <= k < lo + 3 for k in kept) for lo in range(len(h) - 2)) and len(kept) < len(h)


def test_banded_alignment_against_whole_table():
    rng = random.Random(1)
    for _ in range(20):
        template = [rng.randrange(50) for _ in range(30)]
        text = [rng.randrange(50) for _ in range(5)] + [x for x in template for _ in range(1) if rng.random() > 0.1] + [rng.randrange(50) for _ in range(5)]
        a, b = pa.array([" ".join(f"w{x}" for x in t) for t in (template, text)]).to_pylist()
        t, d = hashed(a), hashed(b)
        wide = align(t, d, 0, band=len(d) + len(t))
        assert align(t, d, 5, band=12)[0] >= 0.9 * wide[0] > 15


@pytest.mark.parametrize("edits", [0, 1])
def test_planted(spark, edits):
    rng = random.Random(edits)
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        own = text.split()
        if edits and len(own) > 20:
            for _ in range(len(own) // 20):
                own[rng.randrange(len(own))] = "changed"
            own.insert(len(own) // 2, "inserted words here")
        rows.append((i, "Some text before it. " + " ".join(own).upper() + " and after."))
        want.add((i, name))
    rows += [(90, None), (91, ""), (92, "nothing of the kind under the sun"), (93, (TEMPLATES["MIT-notice"] + " text ") * 2), (94, "x " * 30_000 + TEMPLATES["ISC"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("template"))
    got = scan_licenses(df).collect()
    assert want | {(93, "MIT-notice"), (94, "ISC")} == {(r.doc_id, r.template) for r in got}
    assert sum(r.doc_id == 93 for r in got) == 2
    text = dict(rows)
    for r in got:
        assert 0.75 <= r.coverage <= 1 and (edits or r.coverage == 1) and r.end_word - r.first_word >= r.n_matched
        span = text[r.doc_id].encode()[r.first_byte : r.end_byte].decode()
        assert len(hashed(span)) == r.end_word - r.first_word
    assert scan_licenses(df.limit(0)).count() == 0


def test_on_the_documents(spark, sf_dir):
    """Every document that holds a notice word for word is found, and no clean one."""
    notices = {n: hashed(t).tolist() for n, t in TEMPLATES.items()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = hashed(r.text or "").tolist()
        want |= {(r.doc_id, n) for n, t in notices.items() if any(own[i : i + len(t)] == t for i in range(len(own) - len(t) + 1))}
    got = {(r.doc_id, r.template) for r in op4_license_scan(spark, sf_dir).collect() if r.coverage == 1}
    assert {d for d, _ in want} == {d for d, _ in got} and want


def test_licenses_are_told_apart(spark):
    """Texts that hold most words of another license's are reported as their own; short notices with a changed word are found."""
    names = ["BSD-2-Clause", "BSD-3-Clause", "AGPL-3.0-header", "LGPL-3.0-header", "CC-BY-NC-ND-4.0-notice", "GPL-2.0-notice", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense"]
    rows = [(n, f"Before it. {TEMPLATES[n]} After it.") for n in names] + [(f"MIT-notice {w}", " ".join(own)) for w in (0, 4) for own in ["Released under the MIT License".split()] if own.__setitem__(w, "changed") is None]
    got = {(r.doc_id, r.template) for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got >= {(n, n) for n in names} and {d for d, _ in got} == {d for d, _ in rows}
    assert all(t == d for d, t in got if d in names)


def test_bound_on_templates():
    with pytest.raises(ValueError):
        build_index({"big": "w " * 1_000_001})


def test_near_matches_against_whole_tables(spark):
    """Altered copies are reported as the best alignment of all words with all words says, and nothing else is."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    templates = {f"t{n}": " ".join(word() for _ in range(n)) for n in (12, 25, 60, 150, 400)}
    rows = []
    for i in range(120):
        name = rng.choice(sorted(templates))
        own = []
        for x in templates[name].split():
            own += [x] if (r := rng.random()) > 0.1 else [word()] if r > 0.03 else [x, word()] if r > 0.01 else []
        if rng.random() < 0.2:
            own = own[: len(own) // 2]
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 30))] + own + [word() for _ in range(rng.randint(0, 30))])))
    want = {}
    for i, text in rows:
        for name, template in templates.items():
            t, d = hashed(template), hashed(text)
            matched, first, end = align(t, d, 0, band=len(t) + len(d))
            if matched >= 0.75 * len(t):
                want[i, name] = (matched, first, end)
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, r.template): (r.n_matched, r.first_word, r.end_word) for r in got} == want and len(want) > 60


def test_phrases_repeated_many_times(spark):
    """A text that repeats a phrase of a long template is done at once, and has no match."""
    phrase = " ".join(TEMPLATES["Apache-2.0"].split()[40:44]) + " "
    rows = [(1, phrase * 5000), (2, (phrase + "x y ") * 3000 + TEMPLATES["ISC"])]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.template) for r in got] == [(2, "ISC")]
