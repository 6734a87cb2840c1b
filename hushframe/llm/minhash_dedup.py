"""Operator 7: near-dedup of texts by BagMinHash over multisets of five-word shingles.

A shingle's weight is how often it occurs, discretised in steps of one. The weight axis is cut in octaves (0,1], (1,2], (2,4], …; each octave of each
shingle has a Poisson process of points (time, register, place on the axis), drawn from a hash, so equal shingles share their points in all texts. A text sees
the points below its weight; the earliest point of each register is its signature, and two registers agree with a probability that is exactly the weighted
Jaccard similarity. Points are drawn in the order of time and only while some register could still improve.

Signatures are banded (25 bands of 5 registers: a pair at 0.8 meets with probability 0.99995). Each member of a bucket is verified against the bucket's
first by exact multiset overlap. Buckets that still hold several components are compared in pairs of blocks, but only across
components, so every link that could join two groups is tried and no task holds a whole bucket.

Words are what white space separates. A text of one to four words is one shingle; texts without a word (null, empty, blank) link with nothing, not
even with each other. Equal texts are one node. Null doc_ids and repeated rows are rows like others. Extra columns pass through keep_first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import Kept, slices, worker_cache, written
from hushframe.llm.components import components
from hushframe.llm.embedding_dedup import runs

WORDS, THRESHOLD = 5, (4, 5)
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Members that a first one is compared with in one task; members of a block in the second round.
STAR, BLOCK = 256, 512
#: Bytes of a block's texts, about.
BLOCK_BYTES = 4 << 20
#: Shingles whose points are drawn together.
TOGETHER = 200_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@worker_cache()
def _words() -> Kept:
    return Kept(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), most=250_000)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit) and their counts."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, len(w) if len(w) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(w))):
        h = mix(h + w[k : k + n] * _ODD[k])
    return np.unique(h, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of each bag: the identity of the earliest point in each register, 0 for an empty bag."""
    sizes = [len(b[0]) for b in bags]
    of, shingle, weight = np.repeat(np.arange(len(bags)), sizes), np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    doc, seed, width, share = [of], [mix(shingle)], [np.ones(len(of))], [np.ones(len(of))]
    octave, low = 1, 1
    while (above := np.flatnonzero(weight > low)).size:
        doc.append(of[above])
        seed.append(mix(shingle[above] + np.uint64(octave * int(_ODD[1]) & (1 << 64) - 1)))
        width.append(np.full(above.size, float(low)))
        share.append(np.minimum(1.0, (weight[above] - low) / low))
        octave, low = octave + 1, low * 2
    doc, seed, rate, share = np.concatenate(doc), np.concatenate(seed), np.concatenate(width) * registers, np.concatenate(share)
    times = np.full((len(bags), registers), np.inf)
    flat, time, step = times.reshape(-1), np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        first = mix(seed + np.uint64(step * int(_MIX[2]) & (1 << 64) - 1))
        second = mix(first ^ _ODD[3])
        time = time - np.log1p((first >> np.uint64(11)) * -(2.0**-53)) / rate
        place = doc * registers + ((second >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        seen = (second & np.uint64(0xFFFFFFFF)) * 2.0**-32 < share
        np.minimum.at(flat, place[seen], time[seen])
        on = time < times.max(1)[doc]
        doc, seed, rate, share, time = doc[on], seed[on], rate[on], share[on], time[on]
    return np.where(np.isinf(times), 0.0, times).view(np.int64)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> bool:
    """Whether the multisets' weighted Jaccard similarity reaches the threshold, in whole numbers."""
    over, under = threshold
    na, nb = int(a[1].sum()), int(b[1].sum())
    if min(na, nb) * under < over * max(na, nb):
        return False
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both * under >= over * (na + nb - both) and both > 0


def digest(text: Column) -> Column:
    """SHA-256 of a text, which stands for it."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands, size): the digest of the text, the band hashes of its signature and its bytes; no bands without a word."""

    def some(bags: list) -> list:
        table = signatures(bags).reshape(len(bags), BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), table.shape[:2])
        for k in range(ROWS):
            h = mix(h * _ODD[0] + table[:, :, k])
        return [row if len(b[0]) else None for row, b in zip(h.view(np.int64), bags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(slices, batches)):
            bands, bags, n = [], [], 0
            for text in part.column(2).to_pylist():
                bags.append(bag(text))
                n += len(bags[-1][0])
                if n > TOGETHER:
                    bands += some(bags)
                    bags, n = [], 0
            bands += some(bags) if bags else []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bands, pa.list_(pa.int64())), part.column(3)], ["doc_id", "key", "bands", "size"])

    texts = docs.select("doc_id", digest(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return texts.mapInArrow(run, "doc_id long, key binary, bands array<long>, size int")


def _star(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between the heads and members of tasks (head, node, n) that are alike; n is about how many members the head has."""
    members = tasks.select("head", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STAR)).cast("int").alias("part"), "node")
    heads = members.select("head", "part").distinct().withColumn("node", F.col("head"))
    rows = members.unionByName(heads).join(texts, "node").withColumn("second", F.col("node") != F.col("head"))
    rows = rows.repartition("head", "part").sortWithinPartitions("head", "part", "second").select("head", "part", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = first = None
        for part in chain.from_iterable(map(slices, batches)):
            u, v = [], []
            for head, k, node, text in zip(*(c.to_pylist() for c in part.columns)):
                if node == head:
                    of, first = (head, k), bag(text)
                elif (head, k) == of and alike(first, bag(text)):
                    u.append(node)
                    v.append(head)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def hits(bags: list[tuple[np.ndarray, np.ndarray]], threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i > j of bags that are alike. Overlaps come from products of 0/1 columns, one for each copy of a shingle that two bags share."""
    if len(bags) < 12:
        found = [(i, j) for i in range(len(bags)) for j in range(i) if alike(bags[i], bags[j], threshold)]
        return np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
    size = np.array([b[1].sum() for b in bags])
    row = np.repeat(np.arange(len(bags)), size)
    which = np.repeat(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]))
    first = np.cumsum(np.concatenate([b[1] for b in bags])) - np.concatenate([b[1] for b in bags])
    copy = np.arange(len(which)) - np.repeat(first, np.concatenate([b[1] for b in bags]))
    _, column, uses = np.unique(mix(which + copy.astype(np.uint64) * _ODD[2]), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    row, column = row[shared], (np.cumsum(uses > 1) - 1)[column[shared]]
    both = np.zeros((len(bags), len(bags)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        some = np.zeros((len(bags), 4096), np.float32)
        some[row[a:b], column[a:b] - low] = 1
        both += some @ some.T
    over, under = threshold
    both = np.rint(both).astype(np.int64)
    return np.nonzero(np.tril((both * under >= over * (size[:, None] + size - both)) & (both > 0), -1))


def _across(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join different components within tasks (task, a, b, own, node, component): pairs of blocks, one in memory at a time."""
    rows = tasks.join(texts, "node").repartition("task", "a", "b").sortWithinPartitions("task", "a", "b").select("task", "a", "b", "own", "node", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["task", "a", "b"]):
            own, node, group = (part.column(c).to_numpy() for c in ("own", "node", "component"))
            if len(node) < 2 or (group == group[0]).all():
                continue
            i, j = hits([bag(t) for t in part.column("text").to_pylist()])
            _, of = np.unique(group, return_inverse=True)
            joins = (of[i] != of[j]) & ((own[i] != own[j]) | (part.column("a")[0] == part.column("b")[0]))
            root = list(range(int(of.max()) + 1))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            u, v = [], []
            for x, y in zip(i[joins].tolist(), j[joins].tolist()):
                p, q = find(of[x]), find(of[y])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    u.append(node[x])
                    v.append(node[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def nodes_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node) of each row and (node, component) of each node that isn't its component's least."""
    rows = written(signed(docs), "signatures")
    nodes = written(rows.groupBy("key").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.filter("bands is not null").select("node", "size", F.posexplode("bands").alias("band", "h"))
    buckets = written(spread.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("node").alias("head"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.sum("size").alias("bytes")).filter("n > 1"), "buckets")
    members = written(spread.join(buckets, ["band", "h"]).select("node", "n", "head", "who", "bytes"), "members")
    wanted = nodes.select(F.col("key").alias("of"), "rep", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", "text").withColumn("key", digest(F.col("text")))
    texts = written(texts.join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text"), "candidate-texts")
    # Every node is tried against the least of its buckets' heads; then, if that didn't settle it, against the other heads outside its component.
    pairs = written(members.filter("node <> head").groupBy("head", "node").agg(F.max("n").alias("n")), "head-pairs")
    links = written(_star(pairs.groupBy("node").agg(F.min(F.struct("head", "n")).alias("first")).select("node", "first.*"), texts), "first-links")
    so_far = components(links)
    of = lambda name: so_far.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    apart = pairs.join(of("node"), "node", "left").join(of("head"), "head", "left")
    apart = apart.filter(F.coalesce("node_in", "node") != F.coalesce("head_in", "head"))
    least = pairs.groupBy("node").agg(F.min("head").alias("tried"))
    apart = apart.join(least, "node").filter("head <> tried").select("head", "node", "n")
    links = written(links.unionByName(_star(apart, texts)), "star-links")
    first = components(links)
    # Buckets of the same members are one task; those within one component, or of two members, are settled.
    named = members.filter("n > 2").select(F.col("who").alias("task"), "n", "bytes", "node").distinct().join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named-members")
    open_ = named.groupBy("task").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("task")
    open_ = written(open_, "open-tasks")
    tasks = named.join(open_, "task").withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = tasks.select("task", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select(F.xxhash64("task").alias("task"), "node", "component", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    more = written(_across(tasks, texts), "cross-links")
    groups = components(links.unionByName(more))
    return rows.join(nodes.select("key", "node"), "key").select("doc_id", "key", "node"), groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicates, itself included), class_size and kept (the first row of its class) of every document."""
    rows, groups = nodes_and_groups(docs)
    alone = F.col("key") == digest(F.lit(""))
    own = F.when(alone, F.monotonically_increasing_id()).otherwise(-1).alias("own")
    # Both sides of the last join are plain tables, so that the partition of a large class can be split.
    of = rows.join(groups, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("component"), own, F.monotonically_increasing_id().alias("row"))
    of = written(of, "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key", "row")).alias("best")
    sizes = written(of.groupBy("component", "own").agg(F.count("*").alias("class_size"), best), "class-sizes")
    named = of.join(sizes, ["component", "own"])
    return named.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), "key")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    kept = near_duplicates(docs).filter("kept").groupBy("doc_id", "key").agg(F.count("*").alias("stay"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "stay")
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(docs[c].alias(k) for c, k in at.items()))
    rows = rows.join(kept, F.col(at["doc_id"]).eqNullSafe(F.col("kept_id")) & (digest(F.col(at["text"])) == F.col("kept_key")))
    nth = F.row_number().over(Window.partitionBy("kept_id", "kept_key").orderBy(F.lit(0)))  # only rows alike in doc_id and text share a number's range
    return rows.withColumn("nth", nth).filter("nth <= stay").select(*(F.col(k).alias(c) for c, k in at.items()))
