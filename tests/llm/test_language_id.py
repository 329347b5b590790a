"""Code lengths against a dictionary model, held-out accuracy, edge cases."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veiltrack.llm import language_id
from veiltrack.llm.kneser_ney import remainder
from veiltrack.llm.language_id import code_lengths, count_grams, drop_unknown, fit, identify, learn, opened, predict_held_out, sample
from veiltrack.llm.queries import op2_language_id


def plain(texts, text, language, order, least):
    """Bits of a text by walking context counts."""
    seen, often = Counter(), Counter()
    used = {b for _, t in texts for b in t.encode()}
    for k, t in texts:
        b = t.encode()
        for i in range(len(b)):
            for n in range(min(order, i) + 1):
                if k == language:
                    often[b[i - n : i]] += 1
                    seen[b[i - n : i], b[i]] += 1
    in_tree = {b""}
    for n in range(1, order + 1):
        in_tree |= {c for c, m in often.items() if len(c) == n and m >= least}
    follow = {}
    for (c, s), m in seen.items():
        follow.setdefault(c, Counter())[s] += m

    def bits(context, s):
        own = follow.get(context) if context in in_tree else None
        shorter = (lambda: 8.0) if not context else (lambda: bits(context[1:], s))
        if not own:
            return shorter()
        n, q = sum(own.values()), len(own)
        return -math.log2(own[s] / (n + q)) if own[s] else -math.log2(q / (n + q)) + shorter()

    b, total = text.encode(), 0.0
    for i in range(len(b)):
        context = b[max(0, i - order) : i]
        while context and (context not in in_tree or not all(x in used for x in context)):
            context = context[1:]
        total += bits(context, b[i])
    return total


def test_code_lengths_are_exact():
    texts = [("aa", "abab abc abab"), ("aa", "abba é ab"), ("bb", "xyz zyx abx"), ("bb", "xx yy zz é")]
    trees = fit(texts, order=3, least_seen=2)
    asked = ["abab", "xyz é q", "", "zzzz", "ab é xyz\n"]
    got = code_lengths(pa.array(asked), trees)
    for i, t in enumerate(asked):
        for j, k in enumerate(trees.languages):
            assert got[i, j] == pytest.approx(plain(texts, t, k, 3, 2), rel=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in op2_language_id(spark, sf_dir).collect()]
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out and truth[r.doc_id][0] and any(c.isalpha() for c in truth[r.doc_id][1] or "")]
    assert len(out) > 20 and sum(r.lang_pred == truth[r.doc_id][0] for r in out) >= 0.95 * len(out)
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"), (4, "", "en", None), (5, "123 !?", None, "s"), (6, "the dog " * 4000, None, "s"), (None, "die katze", "de", "s"), (1, "the cat and the dog", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", F.lit(0).alias("score"))
    got = {(r.doc_id, r.lang_pred) for r in predict_held_out(df).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "en")} <= got
    kept = drop_unknown(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 6]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert learn(df).languages == []
    assert [r.lang_pred for r in predict_held_out(df).collect()] == ["und"]
    assert predict_held_out(df.limit(0)).count() == 0


def test_tables_change_no_prediction(spark):
    """Languages in one table or each in its own: equal code lengths, those of the plain model."""
    rows = [(100 * k + i, f"{chr(97 + k)}{chr(98 + k)} abc {chr(97 + k)} xyz {chr(99 + k)} {i} é", f"l{k:02}", k) for k in range(20) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int")
    one, many = learn(df, table_bytes=1 << 30), learn(df, table_bytes=1)
    assert [len(own) for _, own in one.files] == [16, 4] and len(many.files) == 20 and one.languages == many.languages
    got = [sorted(tuple(r) for r in identify(df, m, ["doc_id"]).collect()) for m in (one, many)]
    assert got[0] == got[1] and len(got[0]) == 120
    texts = [(r.lang, r.text) for r in sample(df.filter(remainder(F.col("doc_id"), 4) != 2)).collect()]
    for path, own in many.files[:3]:
        bits = code_lengths(pa.array(["abc xyz é"]), opened(path, *own))
        assert bits[0, 0] == pytest.approx(plain(texts, "abc xyz é", own[0], 3, 2), rel=1e-5)


def test_pieces_of_a_text_are_counted_whole(monkeypatch):
    texts = ["abracadabra é abracadabra".encode(), b"", b"a", b"abr" * 20]
    whole = count_grams(texts)
    monkeypatch.setattr(language_id, "PIECE", 7)
    for (keys, n), (own, m) in zip(whole, count_grams(texts)):
        assert keys.tolist() == own.tolist() and n.tolist() == m.tolist()
    with pytest.raises(ValueError, match="order"):
        count_grams(texts, order=7)


def test_languages_of_long_texts_and_too_many(spark, monkeypatch):
    rows = [(i, "the cat and the dog sat", "en") for i in range(8)] + [(20 + i, "der hund und die katze " * 2000, "de") for i in range(8)] + [(50, "und die katze", None), (51, "and the dog", None)]
    got = {r.doc_id: r.lang_pred for r in predict_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50] == "de" and got[51] == "en"
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
