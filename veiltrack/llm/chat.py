"""Chat formatting in budgeted, turn-aligned windows.

Turns are marked with ``<|im_start|>role\\n ... <|im_end|>\\n``.  Control
strings inside roles and texts are escaped reversibly: a backslash becomes
two, ``<|`` becomes ``<\\|`` (and a line feed in a role ``\\n``), so a marker
in the output is always the template's own.

A conversation is cut into windows of at most ``budget`` tokens by the running
sum of its turns' tokens.  Each window after the first repeats the leading
system turn and as many of the last turns before it as fit into
``history_tokens``; only assistant texts that are not repeats are under the
loss mask, so each is trained on once.  A window that the system turn and the
next turn do not fit into together goes without the system turn, so no window
is over the budget but one that holds a single longer turn, which stays whole.

Rows are dealt by conversation and sorted in their partition; a worker streams
through them and holds one window at a time, however long a conversation is.

Defined results: texts of any length are formatted whole; null text and null role are empty; null conv_id is one
conversation; rows of equal turn are ordered by role, then text, and repeated
rows stay; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TOKENS = 128

WINDOWS = "conv_id long, window long, formatted string, n_turns int, n_repeated int, loss_spans array<array<int>>, n_tokens long"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n((?:(?!<\|).)*)" + re.escape(END) + "\n", re.S)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)


def n_tokens(role: str, text: str) -> int:
    """Tokens of a turn: its words, and three for its markers and role."""
    return 3 + sum(1 for _ in _TOKEN.finditer(text))


class _Conversation:
    """Windows of one conversation, as its turns come in."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.turns, self.repeated, self.window, self.sum, self.any = None, [], 0, 0, 0, False

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = n_tokens(role, text)
        if len(self.turns) > self.repeated and self.sum + size > self.budget:
            yield self.row()
            lead = [self.system] if self.system and self.system[2] + size <= self.budget else []
            room, back = min(self.history, self.budget - size - sum(t[2] for t in lead)), []
            for turn in reversed(self.turns):
                if turn is self.system or turn[2] > room:
                    break
                room -= turn[2]
                back.insert(0, turn)
            self.turns = lead + back
            self.repeated, self.sum = len(self.turns), sum(t[2] for t in self.turns)
        turn = (role, text, size)
        if not self.any and role == "system":
            self.system = turn
        self.any = True
        self.turns.append(turn)
        self.sum += size

    def row(self) -> tuple:
        out, at, spans = [], 0, []
        for i, (role, text, _) in enumerate(self.turns):
            head, body = f"{START}{escape(role, True)}\n", escape(text)
            out += [head, body, END, "\n"]
            if role == "assistant" and i >= self.repeated:
                spans.append([at + len(head), at + len(head) + len(body)])
            at += len(head) + len(body) + len(END) + 1
        self.window += 1
        return (self.conv_id, self.window - 1, "".join(out), len(self.turns), self.repeated, spans, self.sum)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        ids = batch["conv_id"].astype("Int64")
        yield from zip((None if x is pd.NA else int(x) for x in ids), batch["role"].fillna(""), batch["text"].fillna(""))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """The windows, in order within a partition: conv_id, window, formatted, n_turns, n_repeated (turns at the front that an earlier window has), loss_spans (code points of formatted), n_tokens."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WINDOWS.split(", ")]
        rows, now = [], None
        for conv_id, role, text in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Conversation(conv_id, budget, history_tokens)
            rows += now.add(role, text)
            if len(rows) >= 500:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if now is not None:
            rows.append(now.row())
        yield pd.DataFrame(rows, columns=columns)

    return turns.mapInPandas(build, WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, as they were before the template."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 60]!r}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of each conversation from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Windows are sorted, unless they are ordered as format_conversations gives
    them.  A window that is missing, or not in order, is an error.
    """
    if not ordered:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        now, state, rows = (), None, []

        def close() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv_id, window, formatted, repeated, spans in zip(batch["conv_id"].astype("Int64"), batch["window"], batch["formatted"], batch["n_repeated"], batch["loss_spans"]):
                key = (None if conv_id is pd.NA else int(conv_id),)
                if key != now:
                    close()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if window != state[5]:
                    raise ValueError(f"conversation {key[0]}: window {window} where {state[5]} was to come")
                for role, text in parse(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for first, end in spans:
                    said = unescape(formatted[first:end])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(formatted)
                state[5] += 1
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        close()
        yield pd.DataFrame(rows, columns=columns)

    return windows.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
