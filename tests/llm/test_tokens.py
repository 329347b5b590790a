"""Vectorised tokens against regular expressions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veiltrack.llm.shared import Mapped, save, seal
from veiltrack.llm.tokens import ALNUM_WORDS, SPACE_WORDS, mix, rolling, slices, unmix, windows, words

LOWER = {i: i + 32 for i in range(65, 91)}
RULES = [(SPACE_WORDS, re.compile(r"[^\x20\x09-\x0D]+"), False), (SPACE_WORDS, re.compile(r"[^\x20\x09-\x0D]+"), True), (ALNUM_WORDS, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), True)]
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b\x1f\xa0漢🙂09{}", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for kind, rule, lower in RULES:
        w = words(pa.array(texts, pa.string()), kind, lower)
        found = [rule.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        assert np.diff(w.first).tolist() == [len(x) for x in found]
        flat = [x for f in found for x in f]
        seen = {}
        for text, h in zip(flat, w.hash.tolist()):
            assert seen.setdefault(text, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_words_and_texts():
    texts = pa.array(["ab " * 400_000, None, "x" * 2_000_000 + " y", "", "ab"])
    w = words(texts)
    assert np.diff(w.first).tolist() == [400_000, 0, 2, 0, 1]
    assert len(set(w.hash.tolist())) == 3 and w.hash[0] == w.hash[-1]
    assert [j - i for i, j in slices(texts)] == [1, 1, 1, 2] or sum(j - i for i, j in slices(texts)) == 5


def test_slice_of_an_array():
    texts = pa.array(["a b", "c", None, "d e f"])
    assert np.diff(words(texts.slice(1, 3)).first).tolist() == [1, 0, 3]
    assert words(texts.slice(3)).hash.tolist() == words(pa.array(["d e f"])).hash.tolist()


def test_rolling_and_windows():
    w = words(pa.array(["a b c d", "b c d e", "b c"]))
    h = rolling(w.hash, 3)
    ok = windows(w.first, 3, len(w.hash))
    assert ok.tolist() == [True, True, False, False, True, True, False, False]
    assert h[1] == h[4] and len(set(h[ok].tolist())) == 3
    assert len(rolling(w.hash, 99)) == 0


def test_mix_has_an_inverse():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    assert (unmix(mix(x)) == x).all()


def thue_morse(doublings):
    """Two words of 2 ** doublings letters whose polynomials agree modulo 2 ** 64, whatever the odd base."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("doublings", [10, 11, 13])
def test_words_that_polynomials_confuse(doublings):
    w = words(pa.array(list(thue_morse(doublings))), second=True)
    assert w.hash[0] != w.hash[1] and w.other[0] != w.other[1]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_second_hashes(texts):
    one, two = words(pa.array(texts, pa.string())), words(pa.array(texts, pa.string()), second=True)
    assert one.hash.tolist() == two.hash.tolist() and one.other is None
    assert len(set(zip(two.hash.tolist(), two.other.tolist()))) == len(set(two.other.tolist())) == len(set(two.hash.tolist()))


def test_a_missing_part_is_an_error(tmp_path):
    folder = str(tmp_path)
    table = Mapped(folder, "x", 4, np.uint64)
    with pytest.raises(FileNotFoundError):
        table[0]
    save(folder, "x", 1, np.arange(3, dtype=np.uint64))
    save(folder, "x", 2, np.empty(0, np.uint64))
    seal(folder, "x")
    assert [len(table[p]) for p in range(4)] == [0, 3, 0, 0]
    (tmp_path / "x.1").unlink()
    with pytest.raises(FileNotFoundError):
        Mapped(folder, "x", 4, np.uint64)[1]
