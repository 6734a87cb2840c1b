"""Operator 5: near-dedup of embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; a table's key is the tuple of its quantised projections. Vectors
of one label that share a key in some table are compared by exact cosine in double precision. A bucket of any size is split into blocks, and
each pair of blocks is a task of its own, so no group has to fit in one task. A pair that meets in several tables
counts in the first of them alone. Blocks return counts and a spanning set of their links, never all pairs.

At a cosine of 0.98 (distance 0.2) one projection agrees with probability 0.92, a key of 10 with 0.43, and some key of 16 tables with 0.9999.

Vectors equal in every component are one class with a multiplicity. Null labels and vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of other dimensions don't link. Repeated vec_ids count as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import arrow_map, written
from hushframe.llm.components import components

TABLES, HASHES, WIDTH = 16, 10, 2.0
#: Vectors of a block; a pair of blocks is compared at a time.
BLOCK = 512


@lru_cache(maxsize=8)
def directions(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections, shifts, and odd multipliers that fold a key into 64 bits."""
    make = np.random.default_rng([seed, dim])
    return make.standard_normal((dim, tables * hashes)), make.random(tables * hashes), make.integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1


def keys_of(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = 7) -> np.ndarray:
    along, shift, odd = directions(unit.shape[1], tables, hashes, seed)
    cells = np.floor(unit @ along / width + shift).astype(np.int64).reshape(len(unit), tables, hashes)
    key = np.zeros((len(unit), tables), np.int64)
    for k in range(hashes):
        key = (key ^ cells[:, :, k]) * odd[k]
        key ^= key >> 29
    return key


def usable(vector) -> object:
    """A vector that can link: each component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors of each label: rep (least vec_id), label, embedding, weight."""
    rows = vectors.filter(F.col("label").isNotNull() & usable(F.col("embedding"))).select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))


def compare(a: dict, b: dict, same: bool, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of both blocks' rows that no earlier table gives, and spanning links of all hits as index pairs into a then b."""
    hit = a["unit"] @ b["unit"].T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    fresh = np.ones(len(i), bool)
    for t in range(table):
        fresh &= a["keys"][i, t] != b["keys"][j, t]
    counts_a = np.bincount(i[fresh], b["weight"][j[fresh]], len(a["rep"]))
    counts_b = np.zeros(0) if same else np.bincount(j[fresh], a["weight"][i[fresh]], len(b["rep"]))
    n = len(a["rep"])
    j = j if same else j + n
    label = np.arange(n + (0 if same else len(b["rep"])))
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            break
    return counts_a, counts_b, np.flatnonzero(label != np.arange(len(label))), label


def links(found: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rep, n) link counts and (u, v) spanning links between classes."""

    def key(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(2)
        dims = np.diff(column.offsets.to_numpy())
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            keys = keys_of(unit_rows(part.column(2)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(keys), pa.list_(pa.int64())), pa.array(np.full(len(keys), dim, np.int32))], ["rep", "label", "embedding", "weight", "keys", "dim"])

    keyed = written(arrow_map(found.select("rep", "label", "embedding", "weight"), key, "rep long, label int, embedding array<float>, weight long, keys array<long>, dim int"), "vector-keys")
    bucket = ["label", "dim", "t", "key"]
    spread = keyed.select("rep", "label", "dim", F.posexplode("keys").alias("t", "key"))
    shared = spread.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    members = spread.join(shared, bucket).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tasks = members.select("rep", *bucket, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("rep", *bucket, "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    rows = tasks.join(keyed.select("rep", "embedding", "weight", "keys"), "rep")
    order = [*bucket, "a", "b"]
    rows = rows.repartition(*order).sortWithinPartitions(*order).select("rep", "own", "t", "a", "b", "label", "dim", "key", "embedding", "weight", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_of(part: pa.Table) -> dict:
            part = part.combine_chunks()
            column = part.column("embedding").combine_chunks()
            keys = part.column("keys").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
            return {"rep": part.column("rep").to_numpy(), "unit": unit_rows(column), "weight": part.column("weight").to_numpy().astype(float), "keys": keys}

        def task(part: pa.Table) -> Iterator[pa.RecordBatch]:
            t, a, b = (part.column(c)[0].as_py() for c in ("t", "a", "b"))
            own = part.column("own").to_numpy()
            first = block_of(part.filter(pa.array(own == a)))
            second = first if a == b else block_of(part.filter(pa.array(own == b)))
            if not len(first["rep"]) or not len(second["rep"]) or (a == b and len(first["rep"]) < 2):
                return
            counts_a, counts_b, moved, label = compare(first, second, a == b, t, threshold)
            reps = first["rep"] if a == b else np.concatenate([first["rep"], second["rep"]])
            n = counts_a if a == b else np.concatenate([counts_a, counts_b])
            keep = np.flatnonzero((n > 0) | (label != np.arange(len(label))))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(reps[keep]), pa.array(n[keep].astype(np.int64)), pa.array(reps[label[keep]])], ["rep", "n", "to"])

        for part in runs(batches, ["t", "a", "b", "label", "dim", "key"]):
            yield from task(part)

    out = written(rows.mapInArrow(run, "rep long, n long, to long"), "vector-links")
    return out.groupBy("rep").agg(F.sum("n").alias("n")), out.filter("rep <> to").select(F.col("rep").alias("u"), F.col("to").alias("v"))


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Runs of rows alike in the columns, from sorted batches; one run is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        first = tuple(v[0] for v in values)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, stop in zip(cuts, cuts[1:-1]):
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cuts[-2]))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    found = written(classes(vectors), "vector-classes")
    counts, edges = links(found, threshold, block)
    groups = components(edges)
    of = found.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    of = of.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select("vec_id", "label", "embedding", usable(F.col("embedding")).alias("usable"))
    can = rows.filter("usable and label is not null").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))
    linked = can.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not (usable and label is not null)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
