"""A page's sanitised record: structural classification, look-behind scanning, budgets, caps, statistics. Unknown means more redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.patterns import jvm
from hushframe.functions.redact import merge_spans, placeholder_for, redact_text
from hushframe.functions.scan import BEFORE, scan_text
from hushframe.operators.extract import clean_url, dom_blocks, dom_elements, one_space, trim_white, visual_candidates

TEXT_BUDGET, MAX_ELEMENTS, LABEL = 8000, 120, 120


def classify(tag: Column, type_: Column, autocomplete: Column, names: Column) -> Column:
    """The structural kind of an element, first hit wins; null for none."""
    auto = trim_white(F.lower(F.coalesce(autocomplete, F.lit(""))))
    tag = F.lower(tag)
    return (
        F.when((tag == "input") & (F.lower(F.coalesce(type_, F.lit("text"))) == "password"), F.lit("password"))
        .when((tag == "input") & auto.isin(P.SENSITIVE_AUTOCOMPLETE), F.concat(F.lit("autocomplete:"), auto))
        .when((tag == "input") & F.coalesce(names, F.lit("")).rlike(jvm(P.SENSITIVE_NAME)), F.lit("sensitive_field"))
        .when(tag.isin("img", "video", "canvas"), F.lit("visual_candidate"))
    )


def severity_of(kind: Column) -> Column:
    return F.when((kind == "password") | kind.startswith("autocomplete:"), 3).when(kind == "sensitive_field", 2).when(kind == "visual_candidate", 1)


def visible(w: Column, h: Column, x: Column, y: Column, view_w: Column, view_h: Column, hidden: Column) -> Column:
    """Large enough, not hidden, and not wholly outside a known viewport; an unknown viewport culls nothing."""
    off = (x + w < 0) | (y + h < 0) | (x > view_w) | (y > view_h)
    return F.coalesce((w >= 2) & (h >= 2), F.lit(True)) & ~F.coalesce(off, F.lit(False)) & ~F.coalesce(hidden, F.lit(False))


def safe_label(label: Column) -> Column:
    """Trimmed, cut to 120 characters, its own spans redacted."""
    cut = F.substring(trim_white(label), 1, LABEL)
    return redact_text(cut, scan_text(cut))


def label_source(aria: Column, placeholder: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(aria, F.lit("")), F.nullif(placeholder, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))


def field_state(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    return F.struct((F.length(v) > 0).alias("filled"), F.length(v).alias("length"))


def lookbehind(blocks: DataFrame, page: str = "page_id", order: str = "ord", text: str = "text") -> DataFrame:
    """Each block with the last characters of the one before it, blocks too short to scan included."""
    prev = F.lag(text).over(Window.partitionBy(page).orderBy(order))
    return blocks.withColumn("prefix", F.coalesce(F.concat(F.right(prev, F.lit(BEFORE)), F.lit(" ")), F.lit("")))


def block_spans(prefix: Column, text: Column) -> Column:
    """Spans of a block scanned behind its prefix; one that straddles the border is clamped to the block's start, never dropped."""
    n = F.length(prefix)
    moved = F.transform(
        scan_text(F.concat(prefix, text)), lambda s: s.withField("start", F.greatest(F.lit(0), s["start"] - n)).withField("end", s["end"] - n).withField("length", s["end"] - n - F.greatest(F.lit(0), s["start"] - n))
    )
    return F.when(F.length(text) >= 3, F.filter(moved, lambda s: s["end"] > 0)).otherwise(F.slice(moved, 1, 0))


def within_budget(blocks: DataFrame, length: Column, budget: int = TEXT_BUDGET, page: str = "page_id", order: str = "ord") -> DataFrame:
    """Blocks until the text emitted before one reaches the budget; the last may overshoot."""
    before = F.sum(length).over(Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("emitted", F.coalesce(before, F.lit(0))).filter(F.col("emitted") < budget)


def capped(elements: DataFrame, cap: int = MAX_ELEMENTS, page: str = "page_id", order: str = "i") -> DataFrame:
    """Elements with `kept`: sensitive ones always, others while fewer than cap rows came before."""
    nth = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return elements.withColumn("kept", F.col("sensitive").isNotNull() | (nth <= cap))


def element_records(pages: DataFrame, cap: int = MAX_ELEMENTS) -> DataFrame:
    """(page_id, elements, redacted_elements, truncated) of each page with interactive elements."""
    names = F.concat_ws(" ", "name", "id", "aria_label", "placeholder")
    rows = dom_elements(pages).withColumn("sensitive", classify(F.col("tag"), F.nullif(F.col("type"), F.lit("")), F.col("autocomplete"), names))
    rows = capped(rows, cap)
    element = F.struct(
        "i",
        "tag",
        "type",
        "role",
        safe_label(label_source(F.col("aria_label"), F.col("placeholder"), F.col("text"))).alias("label"),
        "sensitive",
        F.when(F.col("sensitive").isNotNull(), placeholder_for(F.col("sensitive"))).alias("placeholder"),
        F.when(F.col("tag").isin("input", "textarea", "select"), field_state(F.col("value"))).alias("state"),
    )
    return rows.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), element))).alias("elements"),
        F.count_if(F.col("sensitive").isNotNull()).alias("redacted_elements"),
        F.count_if(~F.col("kept")).alias("truncated"),
    )


def build_context(pages: DataFrame, cap: int = MAX_ELEMENTS, budget: int = TEXT_BUDGET) -> DataFrame:
    """One sanitised record for each page: url without query, redacted text within the budget, elements, and statistics by kind."""
    blocks = lookbehind(dom_blocks(pages).withColumn("text", one_space(F.col("text"))))
    scanned = blocks.withColumn("spans", block_spans(F.col("prefix"), F.col("text")))
    redacted = scanned.withColumn("redacted", redact_text(F.col("text"), F.col("spans"))).filter(F.length("text") >= 3)
    kept = within_budget(redacted, F.length("redacted"), budget)
    texts = kept.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "redacted"))).alias("parts"),
        F.sum(F.size(merge_spans(F.col("spans")))).alias("redacted_spans"),
        F.flatten(F.collect_list(F.transform("spans", lambda s: s["kind"]))).alias("kinds"),
    )
    kinds = F.array_sort(F.array_distinct("kinds"))
    by_kind = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("kinds", lambda x: x == k)))))
    texts = texts.select("page_id", F.substring(F.array_join(F.transform("parts", lambda p: p["redacted"]), " "), 1, budget).alias("text"), "redacted_spans", by_kind.alias("by_kind"))
    base = pages.select("page_id", F.lit("hush/1").alias("schema"), clean_url(F.col("url")).alias("url"), F.size(visual_candidates(F.col("html"))).alias("visual_candidates"))
    out = base.join(texts, "page_id", "left").join(element_records(pages, cap), "page_id", "left")
    return out.withColumns(
        {"text": F.coalesce("text", F.lit("")), "redacted_spans": F.coalesce("redacted_spans", F.lit(0)), "redacted_elements": F.coalesce("redacted_elements", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(0))}
    )
