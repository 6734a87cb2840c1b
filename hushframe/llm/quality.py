"""Operator 6: a quality classifier by an interpolated modified Kneser-Ney model of character n-grams, counted and joined by shards.

Symbols are the code points themselves, order 4, so every table grows with what the corpus holds. Documents are dealt into groups by a hash of doc_id; a
group's distinct n-grams, with their counts in its trusted texts, are gathered in its task before anything is shuffled. Counts are summed by
shards of the n-gram; lower orders count distinct continuations; discounts come from counts of counts. Each group's distinct n-grams are
joined to the shards' probabilities and come back to the group, where they give each document's perplexity over its whole text. No table is gathered on the
driver or broadcast by this module.

Groups are halved, and each half is scored by the model of the other half's trusted texts: a text never adds to the counts it is judged by (a copy of it with
another doc_id may). So the trusted texts that set the thresholds are held out too. A language's thresholds are quantiles of the perplexity of its trusted
texts, drawn towards the overall ones and widened by a weight that falls steadily with their number; short texts are steadied by a prior. A text outside them is rejected: too improbable, or too repetitive.

Trusted texts are those labelled quality 1 (the least label, where a doc_id has several). Where the other half has no trusted text, or none exist at all, there is no
perplexity and nothing but empty texts is rejected. Null and empty texts have no perplexity and are rejected. A null lang is a language of its own. Repeated rows
are judged alike; a null doc_id is never trusted. U+0000 counts as U+FFFD. Other columns pass through good_documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import discard, slices, written

ORDER = 4
#: Bytes of text in a group, about; characters handled together; rows of n-grams held before they are merged.
GROUP, PIECE, MERGE = 16 << 20, 1 << 19, 1 << 20
#: Share of trusted texts beyond each threshold; widening in log perplexity with many trusted texts, and with none; the number at which both weights are a half.
TAIL, MARGIN, FEW_MARGIN, HALFWAY = 0.0005, 0.02, 0.22, 50
#: Symbols at its language's median that a text is taken together with.
PRIOR = 200
#: Stands before a text's first character.
START = "\x02"


def pieces(texts: list[str], most: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """(which text, part) lists of about `most` characters together; each part begins with the ORDER - 1 symbols before it."""
    of, parts, n = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), most):
            part = text[max(0, at - ORDER + 1) : at + most]
            of.append(i)
            parts.append(part if at >= ORDER - 1 else START * (ORDER - 1 - at) + part)
            n += len(part)
            if n >= most:
                yield of, parts
                of, parts, n = [], [], 0
    if parts:
        yield of, parts


def distinct_grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the parts, the index of each position's n-gram among them, and the number of positions of each part."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == 0] = 0xFFFD
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) - (ORDER - 1)
    at = np.arange(sizes.sum()) + (ORDER - 1) * np.repeat(np.arange(len(parts)), sizes)
    seen = np.zeros(int(points.max()) + 1, np.int64)
    seen[points] = 1
    kinds = int(seen.sum())
    symbol = (np.cumsum(seen) - 1)[points]
    key, most = symbol[at], kinds
    for k in range(1, ORDER):
        if most * kinds >= 1 << 62:  # rename what is there so far
            key, found = pd.factorize(key)
            key, most = key.astype(np.int64), len(found)
        key = key * kinds + symbol[at + k]
        most *= kinds
    index, found = pd.factorize(key)
    first = np.empty(len(found), np.int64)
    first[index[::-1]] = at[::-1]
    grams = np.ascontiguousarray(points[first[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").reshape(-1)
    return grams, index, sizes


def merged(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("gram").aggregate([("n", "sum")]).rename_columns(["gram", "n"])


def squeezed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """key (doc_id), packed (the text, compressed; null without text) and the columns as c0, c1, … of every row: a third less is moved than by rows of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for part in chain.from_iterable(map(slices, batches)):
            packed = pa.array([squeeze(t.encode()) if t else None for t in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), packed, *part.columns[2:]], ["key", "packed", *(f"c{k}" for k in range(len(columns)))])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"key {kinds['doc_id']}, packed binary", *(f"c{k} {kinds[c]}" for k, c in enumerate(columns))])
    return docs.select(docs["doc_id"].alias("key"), docs["text"].alias("text"), *(docs[c].alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(run, schema)


def loosened(packed: list[bytes | None]) -> list[str]:
    loosen = zstandard.ZstdDecompressor().decompress
    return [loosen(p).decode() if p else "" for p in packed]


def gathered(rows: DataFrame) -> DataFrame:
    """(group, gram, n) from rows (group, trusted, packed): the distinct n-grams of each group and their counts in its trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for group in list(held):
                for b in merged(held.pop(group)).to_batches(max_chunksize=1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), group, np.int32)), b.column(0), b.column(1)], ["group", "gram", "n"])

        for part in chain.from_iterable(map(slices, batches)):
            group, trusted = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            texts = loosened(part.column(2).to_pylist())
            for g in np.unique(group):
                for t in (False, True):
                    for _, some in pieces([texts[i] for i in np.flatnonzero((group == g) & (trusted == t))]):
                        grams, index, _ = distinct_grams(some)
                        counts = np.bincount(index, minlength=len(grams)) if t else np.zeros(len(grams), np.int64)
                        table = pa.table({"gram": pa.array(grams), "n": pa.array(counts.astype(np.int64))})
                        held.setdefault(int(g), []).append(table)
                        n += len(table)
                        if n > MERGE:
                            held.update({k: [merged(v)] for k, v in held.items()})
                            n = sum(v[0].num_rows for v in held.values())
                            if n > MERGE // 2:
                                yield from out()
                                n = 0
        yield from out()

    return rows.mapInArrow(run, "group int, gram string, n long")


def levels(counts: DataFrame) -> DataFrame:
    """(k, model, gram, n) from counts (model, gram, n): of the highest order as they are; below it, how many distinct symbols came before each gram."""
    out = level = counts.select(F.lit(ORDER).alias("k"), "model", "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "model", "gram", "n")
        out = out.unionByName(level)
    return out


def discount(counts: DataFrame) -> Column:
    """The modified discount of a row's n, from the counts of counts of its model and order."""
    rows = counts.filter("n <= 4").groupBy("model", "k", "n").count().collect()  # at most 40 rows
    c = {(r["model"], r["k"], r["n"]): r["count"] for r in rows}
    keys, values = [], []
    for model, k in sorted({(r["model"], r["k"]) for r in rows}):
        n = [c.get((model, k, i), 0) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else i * 0.5
            keys.append(F.lit(f"{model} {k} {i}"))
            values.append(F.lit(float(min(max(d, 0.05), i - 0.05))))
    table = F.map_from_arrays(F.array(*keys).cast("array<string>"), F.array(*values).cast("array<double>"))
    key = F.concat_ws(" ", F.col("model").cast("string"), F.col("k").cast("string"), F.least(F.lit(3), F.col("n")).cast("string"))
    return F.coalesce(F.try_element_at(table, key), F.least(F.lit(3), F.col("n")) * F.lit(0.5))


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(model, gram, p) for the n-grams asked for, (model, gram), under the models of counts (model, gram, n); a model without texts is left out."""
    table = written(levels(counts), "gram-counts")
    d = discount(table)
    seen = table.withColumn("d", d).withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    contexts = written(seen.groupBy("k", "model", "context").agg(F.sum("n").alias("all"), F.sum("d").alias("held"), F.count("*").alias("kinds")), "gram-contexts")
    wanted = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("model", F.substring("gram", 2, k).alias("gram")).distinct()
    p = None
    for k in range(1, ORDER + 1):
        own = seen.filter(F.col("k") == k).select("model", "gram", (F.col("n") - F.col("d")).alias("share"))
        of = contexts.filter(F.col("k") == k).select("model", "context", "all", "held", "kinds")
        rows = wanted[k].withColumns({"context": F.substring("gram", 1, k - 1), "rest": F.substring("gram", 2, k - 1)})
        rows = rows.join(own, ["model", "gram"], "left").join(of, ["model", "context"], "inner" if k == 1 else "left")
        if p is None:  # the rest of the mass is spread evenly over the symbols seen and one for all others
            below = 1 / (F.col("kinds") + 1)
        else:
            rows = rows.join(p.select("model", F.col("gram").alias("rest"), F.col("p").alias("below")), ["model", "rest"])
            below = F.col("below")
        value = F.coalesce(F.col("share") / F.col("all"), F.lit(0.0)) + F.coalesce(F.col("held") / F.col("all"), F.lit(1.0)) * below
        p = rows.select("model", "gram", value.alias("p"))
    out = written(p, "gram-probabilities")
    discard(table, contexts)
    return out


def scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """A written table of every row's columns, as c0, c1, …, with the perplexity of its text and its symbols; null without text or model. A null text becomes empty."""
    group_of = lambda key: F.pmod(F.hash(key), F.lit(n))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, parts, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP))
    trusted = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id")).repartition(n, "trusted_id")
    # Dealt by the hash that makes groups, so a task holds whole groups.
    rows = squeezed(docs, []).filter("packed is not null").repartition(n, "key").join(trusted.hint("shuffle_hash"), F.col("key") == F.col("trusted_id"), "left")
    grams = written(gathered(rows.select(group_of("key").alias("group"), F.col("trusted_id").isNotNull().alias("trusted"), "packed")), "group-grams")
    model = F.pmod(F.col("group"), F.lit(2))
    counts = grams.filter("n > 0").groupBy(model.alias("model"), "gram").agg(F.sum("n").alias("n"))
    asked = written(grams.select((1 - model).alias("model"), "gram").distinct(), "asked-grams")
    p = probabilities(asked, counts)
    answers = grams.select("group", "gram", (1 - model).alias("model")).join(p, ["model", "gram"]).select("group", "gram", F.log("p").cast("float").alias("l"))
    answers = written(answers, "group-probabilities")
    discard(grams, asked, p)
    others = [c for c in columns if c != "text"]
    names = {c: f"c{k}" for k, c in enumerate(columns)}

    def score(some: pa.Table, table: pa.Table) -> pa.Table:
        texts = loosened(some.column("packed").to_pylist())
        totals, sizes = np.zeros(len(some)), np.fromiter(map(len, texts), np.int64, len(texts))
        known = len(table) > 0
        if known:
            grams, logs = table.column("gram").combine_chunks(), table.column("l").to_numpy()
            for of, some_parts in pieces(texts):
                found, index, lengths = distinct_grams(some_parts)
                own = logs[pc.index_in(pa.array(found), value_set=grams).to_numpy(zero_copy_only=False).astype(np.int64)].astype(np.float64)
                ends = np.cumsum(lengths)
                np.add.at(totals, of, np.add.reduceat(own[index], ends - lengths))
        values = pa.array(np.exp(-totals / np.maximum(sizes, 1)), mask=~((sizes > 0) & known))
        out = {names[c]: some.column(f"c{k}") for k, c in enumerate(others)} | ({names["text"]: pa.array(texts, pa.string())} if "text" in names else {})
        return pa.table([*(out[k] for k in names.values()), values, pa.array(sizes)], names=[*names.values(), "perplexity", "symbols"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{k} {kinds[c]}" for c, k in names.items()) + ", perplexity double, symbols long"
    texts = squeezed(docs, others).withColumn("group", group_of("key")).drop("key")
    out = written(texts.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(score, schema), "perplexities")
    discard(answers)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def _by_language(good: DataFrame, value: Column, shares: list[float], name: str) -> tuple[DataFrame, list[float | None]]:
    """(of_lang, n, quantiles) of a value of trusted texts, written, as its size is then known to a join; and the quantiles over all languages."""
    ends = F.percentile_approx(value, shares, 100_000)
    overall = good.agg(ends.alias("q")).first()["q"] or [None] * len(shares)  # one row
    return written(good.groupBy("of_lang").agg(F.count("*").alias(f"{name}_n"), ends.alias(name)), name), overall


def thresholds(rows: DataFrame, labels: DataFrame, doc_id: str, lang: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """(rows with their language's quantiles, steadied perplexity, lower, upper, kept) of scored rows."""
    ids = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"))
    rows = rows.withColumn("of_lang", F.coalesce(F.col(lang), F.lit("")))
    good = rows.filter("perplexity is not null").join(ids, F.col(doc_id) == F.col("trusted_id"), "left_semi").select("of_lang", "symbols", F.log("perplexity").alias("l"))
    weight = lambda n: F.coalesce(n, F.lit(0)) / (F.coalesce(n, F.lit(0)) + HALFWAY)
    # Short texts vary more: each is taken together with PRIOR symbols at its language's median.
    medians, middle = _by_language(good, F.col("l"), [0.5], "medians")
    typical = weight(F.col("medians_n")) * F.coalesce(F.col("medians")[0], F.lit(0.0)) + (1 - weight(F.col("medians_n"))) * F.lit(middle[0]).cast("double")
    steady = lambda l: (F.col("symbols") * l + PRIOR * typical) / (F.col("symbols") + PRIOR)
    quantiles, (low_all, high_all) = _by_language(good.join(medians, "of_lang").withColumn("s", steady(F.col("l"))), F.col("s"), [TAIL, 1 - TAIL], "quantiles")
    rows = rows.join(medians, "of_lang", "left").join(quantiles, "of_lang", "left")
    low_all, high_all = (F.lit(x).cast("double") for x in (low_all, high_all))
    w = weight(F.col("quantiles_n"))
    wide = MARGIN * w + FEW_MARGIN * (1 - w)
    low, high = F.coalesce(F.col("quantiles")[0], low_all), F.coalesce(F.col("quantiles")[1], high_all)
    lower = w * low + (1 - w) * F.least(low, low_all) - wide
    upper = w * high + (1 - w) * F.greatest(high, high_all) + wide
    value = steady(F.log("perplexity"))
    return rows, F.exp(value), F.exp(lower), F.exp(upper), F.coalesce((value >= lower) & (value <= upper), F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, steady (the value judged), lower, upper and kept of every document."""
    rows, steady, lower, upper, kept = thresholds(scored(docs, labels, ["doc_id", "lang"]), labels, "c0", "c1")
    return rows.select(
        F.col("c0").alias("doc_id"), F.col("c1").alias("lang"), "perplexity", steady.alias("steady"), lower.alias("lower"), upper.alias("upper"), (kept & (F.col("symbols") > 0)).alias("kept")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows, *_, kept = thresholds(scored(docs, labels, docs.columns), labels, at["doc_id"], at["lang"])
    return rows.filter(kept & (F.col("symbols") > 0)).select(*(F.col(k).alias(c) for c, k in at.items()))
