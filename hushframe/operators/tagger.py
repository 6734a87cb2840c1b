"""Around a byte tagger: windows, overlap combination, runs, decoding of tags to spans, byte and character offsets. The scorer is pluggable."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.patterns import TAG_CLASSES
from hushframe.operators.evaluate import lookup, pieces

WIDTH, STRIDE, LEAST_WINDOW, LEAST_TEXT, LEAST_SPAN, CONFIDENCE = 384, 320, 8, 8, 3, 0.90
#: What may stand between two spans of one kind that are bridged.
BRIDGE = re.compile(rb"[ \t,;:]{1,2}\Z")


def window_starts(n: Column, width: int = WIDTH, stride: int = STRIDE, tail: int = LEAST_WINDOW) -> Column:
    """Starts of sliding windows over n positions: ends when the end is reached or fewer than tail positions are left."""
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda s: (n - s >= tail) & ((s == 0) | (s - stride + width < n)))


def combine(tags: DataFrame) -> DataFrame:
    """(id, pos, tag) from (id, pos, window, tag): a later window wins unless it says 0."""
    said = F.max_by(F.when(F.col("tag") != 0, F.col("tag")), F.when(F.col("tag") != 0, F.col("window")))
    return tags.groupBy("id", "pos").agg(F.coalesce(said, F.lit(0)).alias("tag"))


def confident(logits: Column, least: float = CONFIDENCE) -> Column:
    """Arg-max class (the first of equals), or 0 where its softmax is below the least."""
    top = F.array_max(logits)
    best = F.array_position(logits, top) - 1
    share = 1 / F.aggregate(logits, F.lit(0.0), lambda t, x: t + F.exp(x - top))
    return F.when((best != 0) & (share >= least), best).otherwise(F.lit(0))


def run_lengths(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, first, last, n) of maximal runs of equal neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(key, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def merge_intervals(rows: DataFrame, key: str, start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """Islands of intervals that overlap (or touch) per key."""
    w = Window.partitionBy(key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(w)
    joins = (F.col(start) <= reach) if touching else (F.col(start) < reach)
    marked = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    island = F.sum("_new").over(Window.partitionBy(key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def decode_tags(data: bytes, kinds: list[str | None]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes: runs of a kind, grown to ASCII word borders, snapped to code points, merged or bridged, three bytes or more."""
    n = len(data)
    word = lambda b: b < 128 and (chr(b).isalnum() or b == 95)
    spans, at = [], 0
    while at < n:
        kind, start = kinds[at], at
        while at < n and kinds[at] == kind:
            at += 1
        if kind is None:
            continue
        end = at
        while start > 0 and word(data[start]) and word(data[start - 1]):
            start -= 1
        while end < n and word(data[end - 1]) and word(data[end]):
            end += 1
        while start > 0 and 0x80 <= data[start] < 0xC0:
            start -= 1
        while end < n and 0x80 <= data[end] < 0xC0:
            end += 1
        spans.append([kind, start, end])
    spans.sort(key=lambda s: (s[1], -s[2]))
    out: list[list] = []
    for kind, start, end in spans:
        if out and out[-1][0] == kind and (start <= out[-1][2] or BRIDGE.match(data[out[-1][2] : start])):
            out[-1][2] = max(out[-1][2], end)
        elif out and start < out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end])
    return [tuple(s) for s in out if s[2] - s[1] >= LEAST_SPAN]


def scored(data: bytes, scorer: Callable[[bytes], list[str | None]]) -> list[str | None]:
    """Each byte's kind, window by window over the whole text: a later window wins unless it says None."""
    kinds: list[str | None] = [None] * len(data)
    for start in range(0, len(data), STRIDE):
        window = data[start : start + WIDTH]
        if len(window) < LEAST_WINDOW:
            break
        for k, kind in zip(range(start, start + len(window)), scorer(window), strict=True):
            if kind is not None:
                kinds[k] = kind
        if start + WIDTH >= len(data):
            break
    return kinds


def tag_spans(docs: DataFrame, scorer: Callable[[bytes], list[str | None]]) -> DataFrame:
    """(doc_id, kind, start, end) in characters, from a scorer that gives each byte's kind or None, over whole texts. A scorer that fails marks its whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                data = (text or "").encode()
                if len(data) < LEAST_TEXT:
                    continue
                try:
                    spans = decode_tags(data, scored(data, scorer))
                except Exception:  # noqa: BLE001  an unknown answer means more redaction, never less
                    spans = [("unscanned", 0, len(data))]
                at = chars = 0  # spans are in order and apart, so each byte is decoded once
                for kind, a, b in spans:
                    start = chars + len(data[at:a].decode("utf-8", "ignore"))
                    at, chars = b, start + len(data[a:b].decode("utf-8", "ignore"))
                    out.append((doc_id, kind, start, chars))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, kind string, start int, end int")


def confident_scorer(logits: Callable[[bytes], np.ndarray], classes: list[str | None], least: float = CONFIDENCE) -> Callable[[bytes], list[str | None]]:
    """A scorer for tag_spans from a model that gives a row of logits for each byte: the class of the greatest (the first of equals), None for class 0 and where
    its softmax is below the least. `classes` names the kind of each class; tags that begin and go on a kind share its name."""

    def run(window: bytes) -> list[str | None]:
        rows = np.asarray(logits(window), np.float64)
        best = rows.argmax(axis=1)
        share = 1 / np.exp(rows - rows.max(axis=1, keepdims=True)).sum(axis=1)
        return [classes[k] if k and s >= least else None for k, s in zip(best.tolist(), share.tolist())]

    return run


def bio_runs(spans: DataFrame, **sides: Column) -> DataFrame:
    """(doc_id, pos, n, a column for each side): runs of n bytes, with the tag that bio_tags gives them from the spans for which the side is true."""
    at = lambda c: F.octet_length(F.substring(F.col("text"), F.lit(1), F.col(c)))
    rows = spans.select("doc_id", "ord", lookup(F.col("label"), TAG_CLASSES).alias("class"), at("start").alias("a"), at("end").alias("b"), F.octet_length("text").alias("n"), F.struct(*(c.alias(k) for k, c in sides.items())).alias("on"))
    rows = rows.filter("class is not null and a < n").select("doc_id", "a", F.greatest(F.col("b"), F.col("a") + 1).alias("b"), F.struct("ord", "class", "a", "on").alias("s"))
    last = lambda k: F.array_max(F.filter("over", lambda s: s["on"][k])).alias(k)
    won = pieces(rows).select("doc_id", "lo", "hi", *map(last, sides))

    def run(at: Column, n: Column) -> Column:
        tag = lambda s: F.when(s["ord"].isNotNull(), F.concat(F.when(at == s["a"], "B-").otherwise("I-"), s["class"]))
        return F.struct(at.alias("pos"), n.cast("long").alias("n"), *(tag(F.col(k)).alias(k) for k in sides))

    return won.select("doc_id", F.inline(F.array(run(F.col("lo"), F.lit(1)), run(F.col("lo") + 1, F.col("hi") - F.col("lo") - 1)))).filter("n > 0")


def bio_tags(spans: DataFrame) -> DataFrame:
    """(doc_id, pos, tag): B and I tags of bytes from labelled spans (doc_id, text, ord, label, start, end) in characters; of spans over one byte the last by ord
    counts. Labels without a class, spans that start beyond the text and null texts give none. Bytes are told apart last, so that none is shuffled or sorted."""
    return bio_runs(spans, tag=F.lit(True)).select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"), "tag")


def training_windows(n: Column, width: int = WIDTH, stride: int = STRIDE, least: int = 32) -> Column:
    """(start, length) of the windows a text of n bytes is trained on: one if it fits, else all of the least length or more, the end's own window too."""
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(stride)), lambda s: n - s >= least))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(n - s, F.lit(width)).alias("length")))


def digit_scorer(data: bytes) -> list[str | None]:
    """A deterministic stand-in for a model: runs of digits are numbers."""
    return ["number" if 48 <= b <= 57 else None for b in data]


def byte_start(text: Column, at: Column) -> Column:
    """Byte offset of a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), at))


def char_start(text: Column, at: Column) -> Column:
    """Character offset of a byte offset on a code point's border."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at), "UTF-8"))


def spans_to_blocks(spans: DataFrame, blocks: DataFrame, bucket: int = 4096) -> DataFrame:
    """(id, block, kind, start, stop) within blocks, from spans (id, kind, start, stop) and blocks (id, block, start, stop) over one joined text.

    A span belongs to the block its start is in and ends with it at the latest; one that starts between blocks is dropped. Blocks are spread over
    buckets of offsets, so the join is on (id, bucket) and a long text doesn't pair all its spans with all its blocks.
    """
    b = blocks.select("id", "block", F.col("start").alias("b_start"), F.col("stop").alias("b_stop")).filter("b_stop > b_start")
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b_start") / bucket), F.floor((F.col("b_stop") - 1) / bucket))))
    s = spans.withColumn("bucket", F.floor(F.col("start") / bucket))
    joined = s.join(b, ["id", "bucket"]).filter((F.col("start") >= F.col("b_start")) & (F.col("start") < F.col("b_stop")))
    return joined.select("id", "block", "kind", (F.col("start") - F.col("b_start")).alias("start"), (F.least("stop", "b_stop") - F.col("b_start")).alias("stop"))
