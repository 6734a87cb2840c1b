"""Scoring: multiset matching against gold, precision, recall and F1 by kind, baselines, hard cases, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.patterns import LABEL_KINDS

#: Kinds that the markup names, which detection in text isn't scored by.
STRUCTURAL = ("password",)
#: Positions of a text whose intervals are laid over one another together.
BLOCK = 128


def norm_value(value: Column) -> Column:
    """Letters and digits alone, upper case."""
    return F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def norm_external(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[^a-zA-Z0-9@.]", ""))


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def bag_match(gold: DataFrame, found: DataFrame, baseline: DataFrame | None = None, keys: tuple[str, ...] = ("page_id", "kind", "norm")) -> DataFrame:
    """Per key: gold, pool (found less the baseline, never below zero), tp, fp and fn. One aggregation, no pairs."""
    keys = list(keys)
    sides = [gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("b")), found.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("b"))]
    if baseline is not None:
        sides.append(baseline.select(*keys, F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("b")))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    rows = rows.groupBy(*keys).agg(F.sum("g").alias("gold"), F.greatest(F.lit(0), F.sum("p") - F.sum("b")).alias("pool"))
    tp = F.least("gold", "pool")
    return rows.withColumns({"tp": tp, "fp": F.col("pool") - tp, "fn": F.col("gold") - tp})


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null for others."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def without_structural(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("kind").isin(*STRUCTURAL))


def external_match(gold: DataFrame, found: DataFrame) -> DataFrame:
    """bag_match of (doc_id, label, value) with (doc_id, kind, value) within a document: labels without a kind and kinds that no label has are left out."""
    norm = norm_external(F.coalesce("value", F.lit(""))).alias("norm")
    gold = gold.select("doc_id", lookup(F.col("label"), LABEL_KINDS).alias("kind"), norm).filter("kind is not null")
    found = found.filter(F.col("kind").isin(*set(LABEL_KINDS.values()))).select("doc_id", "kind", norm)
    return bag_match(gold, found, keys=("doc_id", "kind", "norm"))


def pieces(rows: DataFrame, width: int = BLOCK) -> DataFrame:
    """(doc_id, lo, hi, over) from intervals (doc_id, a, b, s): what the ends of intervals cut a text into, with the s of all intervals over it. A text is dealt by blocks,
    so rows are grouped by interval, not by position, and a group holds those that meet in one block."""
    dealt = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    part = F.struct(F.greatest(F.col("a"), F.col("block") * width).alias("lo"), F.least(F.col("b"), (F.col("block") + 1) * width).alias("hi"), "s")
    blocks = dealt.groupBy("doc_id", "block").agg(F.collect_list(part).alias("all"))
    cut = blocks.withColumn("cuts", F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: F.array(x["lo"], x["hi"]))))))

    def piece(i: Column) -> Column:
        lo, hi = F.col("cuts")[i - 1], F.col("cuts")[i]
        over = F.transform(F.filter("all", lambda x: (x["lo"] <= lo) & (x["hi"] >= hi)), lambda x: x["s"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), over.alias("over"))

    return cut.select("doc_id", F.inline(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), piece))).filter(F.size("over") > 0)


def byte_prf(gold: DataFrame, said: DataFrame) -> DataFrame:
    """(tag, tp, fp, fn, precision, recall, f1) of (doc_id, pos, tag) rows, one for each tagged byte, and over all tags (null). One aggregation by byte, no pairs."""
    none = F.lit(None).cast("string")
    rows = gold.select("doc_id", "pos", F.col("tag").alias("g"), none.alias("p")).unionByName(said.select("doc_id", "pos", none.alias("g"), F.col("tag").alias("p")))
    return run_prf(rows.groupBy("doc_id", "pos").agg(F.max("g").alias("g"), F.max("p").alias("p")).withColumn("n", F.lit(1)))


def run_prf(runs: DataFrame) -> DataFrame:
    """byte_prf from runs (g, p, n) of n bytes that have the tag g and are said to have p."""
    n, zero = F.col("n"), F.lit(0)
    same = F.when(F.col("g") == F.col("p"), n).otherwise(zero)
    cell = lambda tag, tp, fp, fn: F.struct(tag.alias("tag"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    cells = runs.select(F.inline(F.array(cell(F.col("p"), same, n - same, zero), cell(F.col("g"), zero, zero, n - same)))).filter("tag is not null")
    return prf(cells, "tag")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def prf(matched: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 for each group and over all (null)."""
    rows = matched.rollup(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def hard_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(hard, found, total): the first gold rows of a key, in order, are the ones found."""
    keys = ["page_id", "kind", "norm"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    ranked = gold.withColumn("nth", nth).join(_counts(found, keys, "pool"), keys, "left")
    return ranked.groupBy("hard").agg(F.count_if(F.coalesce(F.col("nth") <= F.col("pool"), F.lit(False))).alias("found"), F.count("*").alias("total"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values. Equal values are counted first, so that a key's window holds its distinct values alone, one row each, sorted with spill."""
    distinct = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(key))
    ranked = distinct.withColumns({"upto": upto, "total": total})
    medians = ranked.groupBy(key).agg(F.min(F.when(F.expr("upto > total div 2"), F.col(value))).alias("median"))
    return rows.select(key).distinct().join(medians.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of")), "left").select(key, "median")


def threshold_sweep(cells: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion of (id, truth, p) cells and the mean share flagged by id, for each threshold."""
    spread = cells.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    flag = F.col("p") > F.col("threshold")
    per = spread.groupBy("threshold", "id").agg(
        F.count_if(flag & F.col("truth")).alias("tp"), F.count_if(flag & ~F.col("truth")).alias("fp"), F.count_if(~flag & F.col("truth")).alias("fn"), F.avg(flag.cast("int")).alias("share")
    )
    return per.groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("share"), 6).alias("flagged"))


def class_weights(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """sqrt(total / (n + 1)) of each tag, divided by the mean over tags."""
    rows = tags.groupBy(tag).agg(F.count("*").alias("n"))
    weighed = rows.withColumn("w", F.sqrt(rows.agg(F.sum("n")).scalar() / (F.col("n") + 1)))
    return weighed.select(tag, "n", (F.col("w") / weighed.agg(F.avg("w")).scalar()).alias("weight"))


def hash_split(rows: DataFrame, key: Column, percent: int) -> DataFrame:
    """`held_out` for about so many percent of keys, by their md5."""
    return rows.withColumn("held_out", F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent)
