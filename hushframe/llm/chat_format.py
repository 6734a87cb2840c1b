"""Operator 10: chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans: a window takes turns while the system turn, the repeated history and the span stay
within the budget. Each later window starts with the conversation's system turn and with as much of the latest history as its own budget
allows; repeated assistant turns are outside the loss mask, so each assistant text is under it once. A turn longer than the budget
stands whole in a window of its own with the system turn.

Template: <s>role, line break, text</s> for each turn. Control strings inside a text or role get a backslash after
their first character (one more, where some stand there already), so both directions are exact.

Null texts and roles count as empty; rows of one (conv_id, turn) all count, ordered by role and text; null conv_id is a conversation, null turns come
first. Turns are escaped and counted where they are read, by any task; a conversation's are then read as a sorted stream, one window in memory at a time, however many
it has. Windows depend on those before them and a digest on all turns before it, so the stream itself can't be split. An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm import token_counts
from hushframe.llm.common import arrow_map

BEGIN, END = "<s>", "</s>"
CONTROL = r"/?(?:s>|INST\])"
_escape = re.compile(rf"([<\[])(\\*{CONTROL})")
_unescape = re.compile(rf"([<\[])\\(\\*{CONTROL})")
_turn = re.compile(rf"{BEGIN}(.*?)\n(.*?){END}", re.S)

WINDOWS = "conv_id long, window int, formatted string, loss_spans array<struct<start:int,end:int>>, n_repeated int, n_tokens int"


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2", text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def head(role: str) -> str:
    return f"{BEGIN}{role_out(role)}\n"


def role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Formatter:
    """Takes one conversation's turns in order; gives its windows as they close."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system = None  # the first turn, if its role is system
        self.recent: deque = deque()  # latest turns, their tokens at most the history budget
        self.held = 0  # tokens of these
        self.turns: list = []
        self.sums = [0]  # prefix sums of the open window's tokens
        self.repeated = self.windows = 0
        self.first = True

    def add(self, turn: tuple[str, str, str, int]) -> Iterator[tuple]:
        """Takes a turn: its head, its escaped text, its role and its tokens."""
        if len(self.turns) > self.repeated and self.sums[-1] + turn[3] > self.budget:
            yield self.close()
            carried = [self.system] if self.system else []
            room = self.budget - turn[3] - sum(t[3] for t in carried)
            back: deque = deque()
            for old in reversed(self.recent):
                if old[3] > room:
                    break
                room -= old[3]
                back.appendleft(old)
            self.turns = [*carried, *back]
            self.repeated = len(self.turns)
            self.sums = [0]
            for old in self.turns:
                self.sums.append(self.sums[-1] + old[3])
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[3])
        if self.first and turn[2] == "system":
            self.system = turn
        else:
            self.recent.append(turn)
            self.held += turn[3]
            while self.held > self.history:
                self.held -= self.recent.popleft()[3]
        self.first = False

    def close(self) -> tuple:
        parts, at, spans = [], 0, []
        for k, (head, body, role, _) in enumerate(self.turns):
            if role == "assistant" and k >= self.repeated and body:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(head + body + END)
            at += len(parts[-1])
        self.windows += 1
        return self.conv_id, self.windows - 1, "".join(parts), spans, self.repeated, self.sums[-1]


def sized(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role, text, and of each turn as it is written out: body (the escaped text) and tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = token_counts.counter(path).count
        bodies = [escape(text) for text in batch.column(3).to_pylist()]
        tokens = [count(head(role) + body + END) for role, body in zip(batch.column(2).to_pylist(), bodies)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(tokens, pa.int64())], [*batch.schema.names, "body", "tokens"])

    return arrow_map(rows, run, ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", body string, tokens long")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, path: str | None = None) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted, loss_spans (code points), n_repeated (turns carried over), n_tokens."""
    path = path or public_tokenizers.path(token_counts.MODEL)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = sized(rows, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "body", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "window", "formatted", "loss_spans", "n_repeated", "n_tokens"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32()]
        open_, out = None, []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), types)], names)

        for rows in batches:
            for conv_id, role, body, tokens in zip(*(c.to_pylist() for c in rows.columns)):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        out.append(open_.close())
                    open_ = Formatter(conv_id, budget, history)
                out.extend(open_.add((head(role), body, role, tokens)))
                size += len(body)
                if size > 4 << 20 and out:
                    yield batch()
                    out, size = [], 0
        if open_ is not None:
            out.append(open_.close())
        if out:
            yield batch()

    return rows.mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("conv_id", "window", "formatted", "loss_spans", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, out = None, []

        def end() -> tuple:
            conv_id, n, turns, chars, loss, total = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for rows in batches:
            for row in rows.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        out.append(end())
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                state[5] += len(text)
                for k, m in enumerate(_turn.finditer(text)):
                    if k >= row["n_repeated"]:
                        state[1] += 1
                        state[2].update(f"{role_in(m[1])}\n{unescape(m[2])}\n".encode())
                for span in row["loss_spans"] or ():
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
        if state is not None:
            out.append(end())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
