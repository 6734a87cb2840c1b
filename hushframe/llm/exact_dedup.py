"""Operator 9: exact dedup by deterministic block naming, in DataFrame functions alone.

Texts are equal when identical after deleting white space [\\x20\\x09-\\x0D]. The normalised text is cut into fixed-size blocks; the distinct blocks are sorted
and named by integers in that order; then adjacent pairs of names are named the same way, level by level, until each document has one
name. Equal names are equal texts: no hash decides. Equal texts have equal lengths and fingerprints, so a text whose length and 64-bit fingerprint no other
row shares is exactly a class of one, and takes no part in the naming; among all others the names alone decide. Rows are told apart by a number of their own.

Null and empty texts are one class of empty texts. Ties: most code points, then the smallest doc_id; of rows repeated with the same doc_id and
text one stays. A null doc_id sorts last. Texts of any length are cut in linear time. An empty table gives an empty result; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import written

#: Code points of a block.
BLOCK = 4096
#: The characters deleted before texts are compared.
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """A written table of every row: a number of its own, doc_id, text, how long it is, the fingerprints of its normalised text, and the other columns as c0, c1, …"""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), normalised(docs["text"]).alias("norm"), *(docs[c].alias(f"c{k}") for k, c in enumerate(columns)))
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), F.char_length("norm").alias("n_norm"),
            F.xxhash64("norm").alias("print"), F.sha2("norm", 256).alias("text_sha256"), *(f"c{k}" for k in range(len(columns))),
        ),
        "exact-keys",
    )


def _names(things: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Sort the distinct things and name them by increasing integers; written, so that a name never changes. Ranges are sampled on a block's
    beginning and value alone, so what the driver sees of a block is a few bytes."""
    short = [F.left(F.col(c), F.lit(32)) if dict(things.dtypes)[c] == "string" else F.col(c) for c in columns]
    order = [*short, F.xxhash64(*columns)]
    sorted_ = things.select(*columns).distinct().repartitionByRange(*order).sortWithinPartitions(*order, *columns)
    return written(sorted_.select(*columns, F.monotonically_increasing_id().alias("name")), label)


def identities(keys: DataFrame, shared: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, level, name) of each row whose length and fingerprint another row shares; (level, name) is its text's identity."""
    texts = keys.select("row", "text", "n_norm", "print").join(shared.hint("shuffle_hash"), ["n_norm", "print"], "left_semi")
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = texts.select("row", "n_norm", normalised(F.col("text")).alias("norm")).select(
        "row", F.greatest(F.lit(1), F.ceil(F.col("n_norm") / block)).cast("int").alias("n"), F.posexplode(F.when(F.col("n_norm") == 0, F.array(F.lit(""))).otherwise(cut)).alias("i", "block")
    )
    blocks = written(blocks, "blocks")
    at = blocks.join(_names(blocks, ["block"], "block-names"), "block").select("row", "n", "i", "name")
    done, level = [], 0
    longest = keys.agg(F.max("n_norm")).first()[0] or 0
    while True:
        at = written(at, f"level-{level}")
        done.append(at.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= block << level:
            return reduce(DataFrame.unionByName, done)
        halves = at.filter("n > 1").groupBy("row", "n", F.expr("i div 2").cast("int").alias("j"))
        pairs = halves.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        named = _names(pairs, ["a", "b"], f"pair-names-{level}")
        at = pairs.join(named, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("j").alias("i"), "name")
        level += 1


def judged(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 and n_points of every row of a keyed table."""
    # Plain tables on both sides of a join, so that the partition of a hot key can be split.
    shared = written(keys.groupBy("n_norm", "print").count().filter("count > 1").select("n_norm", "print"), "shared-prints")
    rows = keys.select("row", "doc_id", "n_points", "n_norm", "print", "text_sha256")
    marked = rows.join(shared.withColumn("alike", F.lit(True)), ["n_norm", "print"], "left")
    columns = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_points"]
    alone = marked.filter("alike is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*columns)
    alike = written(marked.filter("alike").join(identities(keys, shared, block), "row").select("row", "doc_id", "n_points", "text_sha256", "level", "name"), "alike")
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("best")
    classes = written(alike.groupBy("level", "name").agg(F.count("*").alias("group_size"), best), "exact-classes")
    found = alike.join(classes, ["level", "name"]).withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("row") == F.col("best.row")})
    return alone.unionByName(found.select(*columns))


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    return judged(keyed(docs, []), block).drop("row")


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    at = {c: f"c{k}" for k, c in enumerate(others)}
    keys = keyed(docs, others)
    stays = judged(keys, block).filter("kept").select("row")
    return keys.join(stays.hint("shuffle_hash"), "row", "left_semi").select(*(F.col(at.get(c, c)).alias(c) for c in docs.columns))
