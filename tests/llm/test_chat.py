"""Round trips of the template, windows within budget, each answer once."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veiltrack.llm.chat import END, START, escape, format_conversations, n_tokens, parse, read_back, unescape
from veiltrack.llm.queries import op9_chat_formatting

PIECES = st.lists(st.sampled_from([START, END, "<|", "<", "|", "\\", "\\n", "\n", "a", "é", "|>", "🙂"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(PIECES, PIECES)
def test_escape_is_reversible(role, text):
    assert unescape(escape(text)) == text and unescape(escape(role, True), True) == role
    assert "<|" not in escape(text) and "\n" not in escape(role, True)
    assert parse(f"{START}{escape(role, True)}\n{escape(text)}{END}\n" * 2) == [(role, text)] * 2


def expected(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_on_the_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = f"{END}{START}assistant ok"
    want = expected(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert digests(op9_chat_formatting(spark, sf_dir)) == want


def talk(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "system"]) if t else "user"
            rows.append((c, t, role, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 3, 10, 30, 200])))))
    return rows


def test_windows(spark):
    rows = talk(5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    windows = format_conversations(df, 120, 40)
    assert digests(read_back(windows)) == expected(rows)
    several = 0
    for r in windows.collect():
        turns = parse(r.formatted)
        assert len(turns) == r.n_turns and sum(n_tokens(*t) for t in turns) == r.n_tokens
        assert r.n_tokens <= 120 or r.n_turns == 1
        several += r.window > 0
        first = [x for x in rows if x[0] == r.conv_id][0]
        if r.window and first[2] == "system" and n_tokens(*first[2:]) + n_tokens(*turns[r.n_repeated]) <= 120:
            assert turns[0] == first[2:]
        fresh = [x for role, x in turns[r.n_repeated :] if role == "assistant"]
        assert [unescape(r.formatted[a:b]) for a, b in r.loss_spans] == fresh
    assert several > 10


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (2, 0, "user", "x " * 50_000), (2, 1, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "no id"), (4, None, "assistant", "no turn"), (4, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("window"))
    fixed = [(c, -1 if t is None else t, r, x) for c, t, r, x in rows]
    assert digests(read_back(format_conversations(df))) == expected(fixed)
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_long_system_turns(spark):
    """Repeated where they fit, and never over the budget."""
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", "s " * size if t == 0 else "w " * (5 + 9 * (t % 4))) for c, size in enumerate((10, 60, 90, 100, 130, 5000)) for t in range(9)]
    windows = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 120, 30)
    assert digests(read_back(windows)) == expected(rows)
    found = [(r, parse(r.formatted)) for r in windows.collect()]
    assert all(r.n_tokens <= 120 or r.n_turns == 1 for r, _ in found)
    assert sum(r.conv_id == 5 and any(role == "system" for role, _ in turns) for r, turns in found) == 1
    assert all(turns[0][0] == "system" for r, turns in found if r.conv_id < 2)


def test_windows_in_any_order(spark, tmp_path):
    """Stored and read in another order they give the same digests; a missing one is an error."""
    rows = talk(7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    format_conversations(df, 120, 40).orderBy(F.xxhash64("conv_id", "window")).write.parquet(f"{tmp_path}/windows")
    windows = spark.read.parquet(f"{tmp_path}/windows")
    assert digests(read_back(windows.repartition(5, "window"))) == expected(rows)
    with pytest.raises(Exception, match="was to come"):
        read_back(windows.filter("window != 1")).collect()
    with pytest.raises(Exception, match="was to come"):
        read_back(windows.orderBy(F.desc("window")).coalesce(1), ordered=True).collect()
