"""Operator 8: packing by non-negative least squares over length combinations.

Documents are tokenised and cut at every full window; what is left is shorter than a window. The histogram of lengths has at
most as many bins as the window has tokens, so it goes to the driver. There, combinations of one to three lengths that fill a
window exactly are enumerated, their repeat counts are solved by non-negative least squares against the histogram and rounded, and the
residual lengths are packed greedily into the tightest gap. The plan is a list of (length, ranks, sequence, offset): its size depends on the window alone.
Each piece finds its place by its rank among pieces of its length, which is counted by shards.

Null and empty texts are one closing token. Repeated rows are packed once each. Texts of any length are cut into whole windows.
An empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushframe.llm.common import Kept, arrow_map, id_and_text, worker_cache, written

MODEL = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Third lengths that are tried for each first length.
RATIOS = (1 / 2, 4 / 9, 3 / 8, 1 / 3, 1 / 4, 1 / 6, 1 / 9, 1 / 16)
#: What WordIds relies on: the normaliser, and how some texts are split before any merge.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {"ab cd": ["ab", "cd"], "ab.,;:!?": ["ab", ".,;:!?"], "ab's 12": ["ab", "'s", "1", "2"], "  ": []}
SPACE = re.compile(r"\s")
#: Letters that are composed, lower-cased and split alike by the tokenizer and by Python; marks that may follow them.
LETTERS, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+"), string.punctuation
EVERY = "".join(filter(LETTERS.fullmatch, map(chr, range(0x180))))
#: Bytes that the tokenizer writes as other characters than Latin-1's.
BYTES = {byte: chr(256 + k) for k, byte in enumerate([*range(33), *range(127, 161), 173])}
#: Pieces of a rank shard, and the least number of shards.
SHARD, SHARDS = 1 << 16, 64
RANK_BITS = 44


class WordIds:
    """Ids of a text, white-space-free word by word: the tokenizer drops white space and no merge, match or normalisation crosses it."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        if json.loads(tokenizer.to_str())["normalizer"] != NORMALIZER:
            raise ValueError("word by word is right only for a tokenizer that composes, joins white space and lower-cases")
        if any(SPACE.search(t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("word by word is right only where no added token holds or takes white space")
        for text, want in SPLITS.items():
            if [part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] != want:
                raise ValueError(f"word by word is right only for a tokenizer that splits {text!r} at white space, marks and apostrophes")
        if any(LETTERS.fullmatch(t.content.rstrip(MARKS)) for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("word by word is right only where no added token is letters, or letters and marks after them")
        for mark in ["", *MARKS, MARKS]:
            if [part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(EVERY + mark)] != [EVERY.encode().decode("latin-1").translate(BYTES)] + [mark] * bool(mark):
                raise ValueError(f"word by word is right only for a tokenizer that writes letters as bytes and splits them from {mark!r}")
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.words = Kept(self.word)

    def word(self, word: str) -> bytes:
        """A word of letters and the marks after it are split before any merge, and case doesn't matter, so each form is tokenised once."""
        bare = word.rstrip(MARKS)
        if bare and (bare.isalpha() if (plain := bare.isascii()) else LETTERS.fullmatch(bare)):
            if len(bare) < len(word):
                return self.words[bare.lower()] + self.words[word[len(bare) :]]
            if (lower := bare.lower()) != bare:
                return self.words[lower]
            # What the tokenizer hands to its model: the letters unchanged, or their bytes as characters.
            return array("I", [token.id for token in self.model.tokenize(bare if plain else bare.encode().decode("latin-1").translate(BYTES))]).tobytes()
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@worker_cache(2)
def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, window: int = 2048, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """Whole windows of each document and its rest: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    path = path or public_tokenizers.path(MODEL)
    end = int(closing).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, out, ids = word_ids(path), [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = of.ids(text) + end
            n = len(data) // 4
            for start in range(0, n, window):
                part = data[4 * start : 4 * (start + window)]
                out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype("int32"))
        arrays = [pa.array(c, pa.int64()) for c in zip(*out)] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return arrow_map(id_and_text(docs), run, PIECES + (", ids array<int>" if with_ids else ""))


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window, all of them present."""
    a = np.arange(1, window)
    rows = [np.stack([a, window - a, 0 * a], 1)]
    for ratio in RATIOS:
        b = np.maximum(1, ((window - a) * ratio).astype(int))
        rows.append(np.stack([a, b, window - a - b], 1))
    found = np.unique(np.sort(np.concatenate(rows), 1), axis=0)
    found = found[(found[:, 2] < window) & (found >= 0).all(1)]
    return found[(present[found] | (found == 0)).all(1)]


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient."""
    n = len(histogram)
    x = y = np.zeros(len(combos))
    uses = np.bincount(combos[combos > 0], minlength=n)
    rate, t = 1 / max(1.0, 3.0 * uses.max()), 1.0
    for _ in range(steps):
        left = sum(np.bincount(combos[:, k], y, n) for k in range(3)) - histogram
        left[0] = 0
        new = np.maximum(0, y - rate * (left[combos[:, 0]] + left[combos[:, 1]] + left[combos[:, 2]]))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def greedy(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the tightest gap, many equal pieces at once: (lengths, repeats)."""
    gaps: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = next((g for g in range(length, window) if gaps.get(g)), None)
            if gap is None:
                gaps.setdefault(window - length, []).append([(length,), left])
                break
            lengths, repeats = group = gaps[gap][-1]
            used = min(left, repeats)
            group[1] -= used
            if not group[1]:
                gaps[gap].pop()
            gaps.setdefault(gap - length, []).append([(*lengths, length), used])
            left -= used
    return [(lengths, repeats) for groups in gaps.values() for lengths, repeats in groups]


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), together exactly the histogram."""
    left = histogram.astype(np.int64).copy()
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = left[0] = 0
    combos = combinations(window, left > 0)
    if len(combos):
        x = solve(left.astype(float), combos)
        for k in np.argsort(-x, kind="stable"):
            if (repeats := int(x[k] + 0.5)) < 1:
                break
            lengths = combos[k][combos[k] > 0]
            values, times = np.unique(lengths, return_counts=True)
            repeats = min(repeats, int((left[values] // times).min()))
            if repeats > 0:
                left[values] -= repeats * times
                out.append((tuple(int(v) for v in lengths[::-1]), repeats))
    return out + greedy({int(n): int(left[n]) for n in np.flatnonzero(left)}, window)


def pack(cut: DataFrame, window: int = 2048) -> DataFrame:
    """sequence_id and offset beside the columns of pieces(). cut has to be stable, so pass a written table."""
    counts = cut.groupBy("length").count().collect()  # at most one row for each length up to the window
    histogram = np.zeros(window + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    keys, bases, offsets, sequence = [], [], [], 0
    taken = np.zeros(window + 1, np.int64)
    for lengths, repeats in plan(histogram, window):
        offset = 0
        for length in lengths:
            keys.append((length << RANK_BITS) + int(taken[length]))
            bases.append(sequence)
            offsets.append(offset)
            taken[length] += repeats
            offset += length
        sequence += repeats
    order = np.argsort(keys) if keys else []
    slots = cut.sparkSession.sparkContext.broadcast(tuple(np.array(a, np.int64)[order] if keys else np.zeros(0, np.int64) for a in (keys, bases, offsets)))

    shards = max(SHARDS, int(histogram.sum()) // SHARD)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32"))
    ranked = dealt.withColumn("nth", nth).join(base, ["length", "shard"]).withColumn("key", F.col("length") * (1 << RANK_BITS) + F.col("base") + F.col("nth") - 1)
    columns = list(cut.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, base_of, offset_of = slots.value
        key = batch.column(len(columns)).to_numpy()
        at = np.searchsorted(starts, key, "right") - 1
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(base_of[at] + key - starts[at]), pa.array(offset_of[at])], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return arrow_map(ranked.select(*columns, "key"), run, schema)


def packed(docs: DataFrame, path: str | None = None, window: int = 2048, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(written(pieces(docs, path, window, closing, with_ids), "pieces"), window)
