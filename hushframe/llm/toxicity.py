"""Operator 4: a counterfactual-regularised toxicity classifier.

Features are the words of a text and their first three to six letters, hashed. Counts of every feature over all training rows choose the most
telling ones (a bounded number); a logistic model is fitted on a bounded sample of the training rows. For each sampled text that names a
group, a counterfactual is made by swapping each identity term for another, and the squared change of the score, a probability, is penalised, so
naming a group moves a score as little as the labels allow. Scoring reads every text whole.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach; labels, lang, source and doc_id are never inputs of a score.
Null and empty texts get the score of a text with no feature. Null labels and repeated label rows that disagree teach nothing; with no
usable labels of both kinds every score is the share of label 1 (0 with no labels). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Kept, slices

BITS = 20
#: Features kept at most, the chi-square each must reach, rows of the fitting sample, weight of the swaps (sixteen, as a score moves by at most a quarter of its log-odds), ridge.
FEATURES, TELLING, SAMPLE, SWAPS, RIDGE = 8192, 20.0, 20_000, 16.0, 1e-4
EDGE = ".,;:!?\"'()[]{}<>|*$%&#-_/\\…«»“”‘’¿¡"

#: Identity terms by kind; a term is swapped for the next of its kind. Fixed values.
IDENTITY = {
    "gender": "women men girls boys woman man girl boy female male".split(),
    "faith": "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist".split(),
    "origin": "africans asians europeans americans mexicans arabs african asian european american mexican arab".split(),
    "colour": "black white brown latino latina hispanic".split(),
    "orientation": "gay straight lesbian bisexual transgender queer heterosexual homosexual".split(),
    "age and body": "old young elderly disabled blind deaf".split(),
    "de": "frauen männer muslime christen juden ausländer schwule lesben".split(),
    "fr": "femmes hommes musulmans chrétiens juifs étrangers homosexuels lesbiennes".split(),
    "es": "mujeres hombres musulmanes cristianos judíos extranjeros homosexuales lesbianas".split(),
}
SWAP = {term: terms[(k + 1) % len(terms)] for terms in IDENTITY.values() for k, term in enumerate(terms)}


def features_of(token: str) -> tuple[int, ...]:
    """Hashed features of a lower-case token: the word and its beginnings."""
    word = token.strip(EDGE)
    parts = {"w:" + word} | {f"{n}:{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n} if word else ()
    return tuple(zlib.crc32(p.encode()) >> (32 - BITS) for p in parts)


def held_out(doc_id) -> F.Column:
    """Rows that never teach."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and y of the rows that may teach."""
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("most")).filter("y = most and y in (0, 1)")
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(one.select("doc_id", "y").filter(~held_out(F.col("doc_id"))).hint("shuffle_hash"), "doc_id")


def telling(rows: DataFrame, n: int = FEATURES) -> dict[int, int]:
    """The n features whose presence tells the labels apart most, by chi-square over all training rows, numbered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of = np.zeros((2, 1 << BITS), np.int32), Kept(features_of)
        for part in chain.from_iterable(map(slices, batches)):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[y][list(set(chain.from_iterable(map(of.__getitem__, text.lower().split()))))] += 1
        at = np.flatnonzero(seen.any(0))
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0][some].astype(np.int64)), pa.array(seen[1][some].astype(np.int64))], ["feature", "n0", "n1"])

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return {}
    counts = rows.select("text", "y").mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    off = (F.col("n1") * (t0 - F.col("n0")) - F.col("n0") * (t1 - F.col("n1"))).cast("double")
    chi = off * off / ((F.col("n0") + F.col("n1")) * (F.lit(float(t0 + t1)) - F.col("n0") - F.col("n1")) + 1e-9)
    best = counts.withColumn("chi", chi * float(t0 + t1) / (float(t0) * t1)).filter(F.col("chi") >= TELLING).orderBy(F.desc("chi"), "feature").limit(n).select("feature").collect()
    return {r["feature"]: k for k, r in enumerate(best)}


def _chosen(number: dict[int, int]) -> Kept:
    return Kept(lambda token: tuple(number[f] for f in features_of(token) if f in number))


def sample(rows: DataFrame, number: dict[int, int], most: int = SAMPLE) -> list[tuple[int, list[int], list[int] | None]]:
    """(label, features, features after the swap or None) of at most about `most` rows, taken by a hash of doc_id."""
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _chosen(number)
        for part in chain.from_iterable(map(slices, batches)):
            plain, swapped = [], []
            for text in part.column(0).to_pylist():
                tokens = text.lower().split()
                words = [t.strip(EDGE) for t in tokens]
                plain.append(sorted(set(chain.from_iterable(map(of.__getitem__, tokens)))))
                swapped.append(sorted(set(chain.from_iterable(of[SWAP.get(w, w)] for w in words))) if not SWAP.keys().isdisjoint(words) else None)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(plain, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["y", "plain", "swapped"])

    return [tuple(r) for r in rows.select("text", "y").mapInArrow(run, "y int, plain array<int>, swapped array<int>").collect()]


class Sparse:
    """Binary rows: products with a vector from either side."""

    def __init__(self, rows: list[list[int]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.fromiter(chain.from_iterable(rows), np.int64, len(self.row))
        self.shape = (len(rows), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.shape[1])


def fit(rows: list[tuple[int, list[int], list[int] | None]], width: int, swaps: float = SWAPS, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log-loss + ridge |w|² + swaps · mean squared change of the score under swaps (Adam, full batches)."""
    y = np.array([r[0] for r in rows], float)
    x = Sparse([r[1] for r in rows], width)
    pairs = [(r[1], r[2]) for r in rows if r[2] is not None]
    before, after = Sparse([p[0] for p in pairs], width), Sparse([p[1] for p in pairs], width)
    share = y.mean()
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    scores = lambda some: 1 / (1 + np.exp(-np.clip(some.times(w) + bias, -40, 40)))
    for step in range(1, steps + 1):
        p = scores(x)
        g = weight * (p - y)
        grad = np.append(x.back(g) + 2 * ridge * w, g.sum())
        if pairs:
            p, q = scores(before), scores(after)
            change = 2 * swaps * (p - q) / len(pairs)
            up, down = change * p * (1 - p), change * q * (1 - q)
            grad += np.append(before.back(up) - after.back(down), (up - down).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def trained(docs: DataFrame, labels: DataFrame, swaps: float = SWAPS) -> tuple[dict[int, int], np.ndarray, float]:
    """The model: numbers of the chosen features, their weights, and the bias."""
    rows = training(docs, labels)
    number = telling(rows)
    if number:
        return number, *fit(sample(rows, number), len(number), swaps)
    share = rows.agg(F.avg("y")).first()[0]
    return number, np.zeros(0), (-40.0 if not share else 40.0 if share == 1 else float(np.log(share / (1 - share))))


def score(docs: DataFrame, labels: DataFrame, swaps: float = SWAPS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, swaps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, w, b = model.value
        of, w = _chosen(numbers), w.tolist()
        for part in chain.from_iterable(map(slices, batches)):
            z = [b + sum(map(w.__getitem__, set(chain.from_iterable(map(of.__getitem__, t.lower().split()))))) for t in part.column(1).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
