"""Operator 2: removal of repeated strings (400 bytes, or a number of words) by bucket refinement over sampled suffixes.

Bucket-pointer refinement starts with buckets of suffixes that share a q-gram and splits a bucket only by the bucket identifiers of later
offsets, reusing identifiers already made; a suffix alone in its bucket is settled and drops out. Here it runs on a sample of
suffixes that loses nothing: each string is charged to the least q-gram inside it, so equal strings are charged to equal
q-grams at equal distances. Every string of one q-gram occurrence forms a range, and ranges are refined in three rounds:

1. bucket = the q-gram. A q-gram that occurs once settles all its strings.
2. bucket = (q-gram, identifier of the whole range). Equal ranges settle all their strings as repeated at once.
3. One range of each settled identifier is left in a bucket with others. It is split at fixed distances from the q-gram into blocks of 16 strings: a block whose
   common part is alone is settled; one equal as a whole to another is settled; what remains is split into single strings.

An identifier is a 64-bit polynomial over scrambled symbols (the eight bytes from a place on, or the word at it), within the bucket of its 64-bit q-gram, so two
independent values would have to coincide to confuse two strings; bytes themselves are not compared. A global rank of all suffixes, as the method has
on one machine, would move every position of the corpus; identifiers by value need no global sort.

Null and empty texts have no strings. Of bytes, a string is repeated wherever else it starts, in the same document too, and a repeated row repeats all its
strings. With across=True only strings of different documents count (rows alike in doc_id and text are one document). Matches never cross documents; texts of
any length go through in chunks. Null doc_ids are rows like others; other columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Kept, arrow_map, discard, worker_cache, written
from hushframe.llm.minhash_dedup import mix

LENGTH = 400
#: Words of a passage.
PASSAGE = 50
#: Strings of a block, symbols of a chunk.
BLOCK, CHUNK = 16, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_WORD = re.compile(r"\S+")


class Bytes:
    """A text's bytes as symbols; the one at a place is scrambled from the REACH + 1 bytes that begin there."""

    REACH = 7

    def __init__(self, text: str):
        self.data = text.encode()
        self.n = len(self.data)

    def symbols(self, start: int, stop: int) -> np.ndarray:
        some = self.data[start:stop] + bytes(7)
        return mix(np.ndarray(len(some) - 7, "<u8", some, strides=(1,)) + np.uint64(_BASE))

    def cut(self, runs: list[tuple[int, int]]) -> bytes:
        """What is left of the data without the runs."""
        borders = [0, *chain.from_iterable(runs), self.n]
        return b"".join(self.data[a:b] for a, b in zip(borders[::2], borders[1::2]))


@worker_cache()
def _words() -> Kept:
    return Kept(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), most=200_000)


class Words:
    """A text's words, which white space separates, as symbols."""

    REACH = 0

    def __init__(self, text: str):
        self.text, words = text, text.split()
        self.n = len(words)
        self.values = np.fromiter(map(_words().__getitem__, words), np.uint64, self.n)

    def symbols(self, start: int, stop: int) -> np.ndarray:
        return mix(self.values[start:stop])

    def cut(self, runs: list[tuple[int, int]]) -> bytes:
        """The text without the runs of words and the white space after each."""
        if not runs:
            return self.text.encode()
        starts = [m.start() for m in _WORD.finditer(self.text)] + [len(self.text)]
        borders = [0, *(starts[k] for k in chain.from_iterable(runs)), len(self.text)]
        return "".join(self.text[a:b] for a, b in zip(borders[::2], borders[1::2])).encode()


Unit = type[Bytes] | type[Words]


@worker_cache()
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    n = CHUNK + 4096
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(symbols: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _powers()[0][: len(symbols)], dtype=np.uint64)])


def _value(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    return mix((sums[stop - reach] - sums[start]) * _powers()[1][start])


def split_length(length: int) -> tuple[int, int]:
    """(q, w): q-gram bytes and how many q-grams a string of the length holds."""
    q = max(1, length // 4)
    return q, length - q + 1


def least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours."""
    n = len(keys) - w + 1
    rows = -(-len(keys) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def ranges(text: Bytes | Words, length: int) -> tuple[np.ndarray, ...]:
    """For each q-gram that strings are charged to: its place, the nearest and farthest string start before it, its bucket, the range's identifier."""
    q, w = split_length(length)
    out = []
    for base in range(0, max(0, text.n - length + 1), CHUNK):
        some = text.symbols(base, base + CHUNK + length - 1)
        sums = _sums(some)
        at = np.arange(len(some) - q + 1)
        grams = _value(sums, at, at + q, text.REACH)
        keys = (grams & np.uint64(_ALL ^ 0x3FFFFF)) | at.astype(np.uint64)
        place = (least(keys, w) & np.uint64(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        m = place[first]
        name = mix(_value(sums, first, last + length, text.REACH) + (m - first).astype(np.uint64) * np.uint64(4099) + (m - last).astype(np.uint64))
        out.append((m + base, m - last, m - first, grams[m].view(np.int64), name.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def blocks(text: Bytes | Words, m: int, near: int, far: int, length: int) -> Iterator[tuple]:
    """A range's blocks: (block, nearest, farthest, identifier of the common part, of the whole block or None, of each string)."""
    base = m - far
    sums = _sums(text.symbols(base, m - near + length))
    for k in range(near // BLOCK, far // BLOCK + 1):
        low, high = k * BLOCK, k * BLOCK + BLOCK - 1
        a, b = max(low, near), min(high, far)
        starts = far - np.arange(a, b + 1)  # from the nearest string on
        inner = _value(sums, np.array([far - low]), np.array([far - high + length]), text.REACH)
        whole = _value(sums, np.array([far - high]), np.array([far - low + length]), text.REACH) if (a, b) == (low, high) else None
        yield k, a, b, int(inner.view(np.int64)[0]), None if whole is None else int(whole.view(np.int64)[0]), _value(sums, starts, starts + length, text.REACH).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, print (64-bit of the text) and text: rows alike in doc_id and text are alike in all that follows."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("print"), text.alias("text"))


def repeats(docs: DataFrame, length: int = LENGTH, unit: Unit = Bytes, across: bool = False) -> DataFrame:
    """(doc_id, print, spans): each row's repeated strings, as starts first to last, or those starts before first that mask's bits name."""
    if split_length(length)[0] <= unit.REACH or length < 2 * BLOCK + unit.REACH:
        raise ValueError(f"strings of {length} are too short")
    rows = keyed(docs)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, prints, found = batch.column(0), batch.column(1), [ranges(unit(t), length) for t in batch.column(2).to_pylist()]
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        m, near, far, gram, name = (np.concatenate(c) for c in zip(*found))
        for k in range(0, len(of), 1 << 17):
            s = slice(k, k + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of[s])), prints.take(pa.array(of[s])), *(pa.array(c[s].astype(np.int32)) for c in (m, near, far)), pa.array(gram[s]), pa.array(name[s])],
                ["doc_id", "print", "m", "near", "far", "gram", "name"],
            )

    nodes = arrow_map(rows.filter(F.octet_length("text") >= length), find, "doc_id long, print long, m int, near int, far int, gram long, name long")
    # What has to differ for two places to count, and whether several rows are enough.
    place = F.xxhash64("doc_id", "print") if across else F.xxhash64("doc_id", "print", "m")
    several = (F.min(place) != F.max(place)) if across else F.count("*") > 1
    # Both sides of a join are plain tables wherever a key can be hot, so that a large partition can be split.
    twice = written(nodes.groupBy("gram").agg(several.alias("several")).filter("several").select("gram"), "repeated-grams")
    nodes = written(nodes.join(twice, "gram"), "ranges")

    # Round 2: ranges equal as a whole. One of each that is repeated stays for round 3 where its q-gram has others, and all others.
    node = F.struct("doc_id", "print", "m", "near", "far")
    classes = nodes.groupBy("gram", "name").agg(F.count("*").alias("n"), several.alias("settled"), F.min(place).alias("low"), F.max(place).alias("high"), F.min(node).alias("one"))
    classes = written(classes, "range-classes")
    equal = nodes.join(classes.filter("n > 1").select("gram", "name", "settled", "low", "high"), ["gram", "name"])
    first, last = (F.col("m") - F.col("far")).alias("first"), (F.col("m") - F.col("near")).alias("last")
    none = F.lit(None).cast("int").alias("mask")
    spans = equal.filter("settled").select("doc_id", "print", first, last, none)
    open_ = written(classes.groupBy("gram").agg((F.count("*") > 1).alias("several")).filter("several").select("gram"), "open-grams")
    columns = ["doc_id", "print", "m", "near", "far", "gram", "settled", "low", "high"]
    left = classes.filter("settled or n = 1").select("gram", "settled", "low", "high", "one.*").select(*columns).unionByName(equal.filter("not settled").select(*columns))
    left = left.join(open_, "gram")

    # Round 3: blocks, then single strings.
    lists = left.groupBy("doc_id", "print").agg(F.collect_list(F.struct("m", "near", "far", "gram", "settled", "low", "high")).alias("nodes"))
    lists = lists.select(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"), "nodes")
    texts = rows.join(lists, rows["doc_id"].eqNullSafe(lists["of_id"]) & (rows["print"] == lists["of_print"])).select("doc_id", "print", "text", "nodes")

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "print", "m", "gram", "settled", "low", "high", "block", "near", "far", "inner", "whole", "strings"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        out = []
        flat = batch.column(3).flatten()
        ends = np.cumsum([len(x) for x in batch.column(3)])
        fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]
        for i, (doc_id, print_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = unit(batch.column(2)[i].as_py())
            for j in range(ends[i - 1] if i else 0, ends[i]):
                m, near, far, *same = (f[j] for f in fields)
                for rest in blocks(text, m, near, far, length):
                    out.append((doc_id, print_, m, *same, *rest))
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "doc_id long, print long, m int, gram long, settled boolean, low long, high long, block int, near int, far int, inner long, whole long, strings array<long>"
    every = written(arrow_map(texts, split, schema), "blocks")
    # A repeated row brings its blocks again, so places are told apart rather than rows counted. A settled range only matters to others.
    apart = F.min("low") != F.max("high")
    shared = every.groupBy("gram", "block", "inner").agg((apart & F.bool_or(~F.col("settled"))).alias("more")).filter("more").select("gram", "block", "inner")
    shared = written(shared, "shared-parts")
    parts = written(every.join(shared, ["gram", "block", "inner"]), "shared-blocks")
    discard(every, shared, open_)
    key = F.struct("doc_id", "print", "m")
    wholes = parts.filter("whole is not null").groupBy("gram", "block", "whole").agg(apart.alias("more"), F.min("low").alias("least"), F.max("high").alias("most"), F.min(key).alias("one"))
    wholes = written(wholes, "whole-blocks")
    whole_rows = parts.join(wholes, ["gram", "block", "whole"])
    spans = spans.unionByName(whole_rows.filter("more and not settled").select("doc_id", "print", first, last, none))

    # Of equal blocks that are repeated one is enough for the others' sake.
    one = whole_rows.filter(~F.col("more") | (key == F.col("one"))).select(*parts.columns, (F.col("settled") | F.col("more")).alias("done"), "least", "most")
    clipped = parts.filter("whole is null").select(*parts.columns, F.col("settled").alias("done"), F.col("low").alias("least"), F.col("high").alias("most"))
    single = clipped.unionByName(one).select("doc_id", "print", "m", "gram", "block", "near", "done", "least", "most", F.posexplode("strings").alias("at", "string"))
    single = single.withColumn("k", F.col("near") + F.col("at"))
    again = single.groupBy("gram", "k", "string").agg(((F.min("least") != F.max("most")) & F.bool_or(~F.col("done"))).alias("more")).filter("more").select("gram", "k", "string")
    found = single.filter("not done").join(again, ["gram", "k", "string"])
    found = found.groupBy("doc_id", "print", "m", "block").agg(F.bit_or(F.expr(f"shiftleft(1, k - block * {BLOCK})")).alias("mask"))
    at = (F.col("m") - F.col("block") * BLOCK).alias("first")
    spans = spans.unionByName(found.select("doc_id", "print", at, at.alias("last"), "mask"))
    out = written(spans.groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "last", "mask")).alias("spans")), "repeats")
    discard(nodes, twice, classes, parts, wholes)
    return out


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, stop) of symbols that the strings cover."""
    starts = []
    for s in spans:
        if s["mask"] is None:
            starts.append((s["first"], s["last"]))
        else:
            starts += [(s["first"] - k, s["first"] - k) for k in range(BLOCK) if s["mask"] >> k & 1]
    out: list[list[int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, columns: list[str], length: int, unit: Unit, across: bool) -> DataFrame:
    """text, spans and the columns as c0, c1, … of every row."""
    found = repeats(docs, length, unit, across)
    found = found.select(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"), "spans")
    text = F.coalesce(docs["text"], F.lit("")).alias("text")
    rows = docs.select(docs["doc_id"].alias("own_id"), text, *(docs[c].alias(f"c{k}") for k, c in enumerate(columns)))
    return rows.join(found, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("text") == F.col("of_print")), "left").drop("own_id", "of_id", "of_print").select("text", "spans", *(f"c{k}" for k in range(len(columns))))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, runs = Bytes(text), covered(spans or [], length)
            kept = data.cut(runs)
            out.append((data.n, data.n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.string()])]
        return pa.RecordBatch.from_arrays([batch.column(2), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(_with_spans(docs, ["doc_id"], length, Bytes, False), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep_unrepeated(docs: DataFrame, length: int = LENGTH, unit: Unit = Bytes, across: bool = False) -> DataFrame:
    """All rows of docs, their texts without the repeated strings; part of a code point left at a cut goes too, n_chars follows the text, and a null text
    becomes empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [unit(t).cut(covered(s, length)).decode("utf-8", "ignore") if s else t for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *names])

    others = [c for c in docs.columns if c != "text"]
    names = [f"c{k}" for k in range(len(others))]
    kinds = dict(docs.dtypes)
    out = arrow_map(_with_spans(docs, others, length, unit, across), run, ", ".join(["text string", *(f"{n} {kinds[c]}" for n, c in zip(names, others))]))
    at = dict(zip(others, names))
    values = {c: F.length("text").cast(kinds[c]) if c == "n_chars" else F.col(at.get(c, "text")) for c in docs.columns}
    return out.select(*(v.alias(c) for c, v in values.items()))
