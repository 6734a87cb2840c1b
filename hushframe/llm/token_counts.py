"""Operator 3: token counts by heap-and-linked-list byte-pair merging, without identifiers.

The count of a text is its initial symbols minus the merges made, where a symbol that is in no vocabulary counts as its UTF-8 bytes.
A piece holds the space mark only at its start (or is all space marks), so no merge crosses the border before a space:
the text is cut there, and the counts of cut pieces are kept in a bounded table.

Nulls and empty texts count 0. Texts of any length are read whole; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from hushframe.llm.common import Kept, arrow_map, id_and_text, worker_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, in order."""
    at, out = 0, []
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


class SpaceRun(Exception):
    """Spaces beside spaces are pieces of their own."""


class PieceCounter:
    """Counts the pieces of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = _fields(file.read())
        norm = dict(_fields(next(v for k, v in model if k == 3)))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1):
            raise ValueError("only models with the identity normaliser and a leading space are counted")
        self.rank: dict[str, tuple[float, int]] = {}
        for index, (_, piece) in enumerate((k, v) for k, v in model if k == 1):
            fields = dict(_fields(piece))
            if fields.get(3, 1) == 1:
                score = memoryview(fields[2]).cast("f")[0] if 2 in fields else 0.0
                self.rank[fields[1].decode()] = (-score, index)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space inside, so texts can't be cut at spaces")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words = Kept(self.word)

    def merged(self, text: str) -> int:
        """Pop the adjacent pair of the best rank, leftmost first, until none is left."""
        symbols: list[str | None] = list(text)
        n, merges, rank = len(symbols), 0, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if (found := rank.get(pair)) is not None:
                heapq.heappush(heap, (found[0], i, j, len(pair)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = left + right, None
            merges += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)

    def word(self, text: str) -> int:
        """Count of what stands between two spaces, with the space before it. A line break is in no piece, so nothing merges with it."""
        if not text:
            raise SpaceRun
        return 1 + self.merged(text[1:]) if text[0] == "\n" else self.merged(SPACE + text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE not in text and "\n" not in self.rank:
            try:
                return sum(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
            except SpaceRun:
                pass
        return sum(map(self.merged, self.cut(SPACE + text.replace(" ", SPACE))))


@worker_cache(2)
def counter(path: str) -> PieceCounter:
    """One counter for each worker process."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""
    path = path or public_tokenizers.path(MODEL)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, texts = counter(path), batch.column(1).to_pylist()
        n = [of.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(id_and_text(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
