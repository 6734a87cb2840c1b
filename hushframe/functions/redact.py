"""Placeholders, interval merging and span replacement as column expressions. What is unknown is redacted."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.checksum import once
from hushframe.functions.patterns import PLACEHOLDERS
from hushframe.functions.scan import crossing

_MERGED = "array<struct<start:int,end:int,kind:string>>"


def placeholder_for(kind: Column) -> Column:
    """The typed placeholder; autocomplete:x-y gives [[X_Y]]; unknown or null kinds give [[REDACTED]]."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PLACEHOLDERS.items()))
    auto = F.when(kind.startswith("autocomplete:"), F.concat(F.lit("[["), F.replace(F.upper(F.substring(kind, F.lit(14), F.length(kind))), F.lit("-"), F.lit("_")), F.lit("]]")))
    return F.coalesce(F.when(kind.isNotNull(), F.try_element_at(known, kind)), auto, F.lit("[[REDACTED]]"))


def merge_spans(spans: Column) -> Column:
    """Overlapping spans become one with the earlier kind; touching ones stay apart; spans without a positive extent are dropped."""
    good = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] > s["start"]))
    ordered = F.array_sort(F.transform(good, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("back"), s["kind"].alias("kind"))))
    none = F.array().cast(_MERGED)
    plain = lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"))

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(s)))

    # The fold copies what it has at each step; it is only for texts whose spans overlap.
    return once(F.transform(ordered, plain), lambda all_: F.when(crossing(all_), F.aggregate(all_, none, step)).otherwise(all_.cast(_MERGED)))


def redact_text(text: Column, spans: Column) -> Column:
    """Every merged span replaced by its placeholder; all other characters stay as they are."""

    def joined(b: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            end = F.when(i > 0, b["merged"][i - 1]["end"]).otherwise(F.lit(0))
            return F.concat(F.substring(b["text"], end + 1, s["start"] - end), placeholder_for(s["kind"]))

        done = F.coalesce(F.try_element_at(b["merged"], F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(b["merged"], piece), ""), F.substring(b["text"], done + 1, F.length(b["text"])))

    return F.when(F.size(spans) > 0, once(F.struct(merge_spans(spans).alias("merged"), text.alias("text")), joined)).otherwise(text)


def merge_channels(pattern: Column, other: Column) -> Column:
    """Spans of two channels merged; of spans with the same extent the pattern's kind stays. A null channel counts as empty."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    tagged = lambda spans, k: F.transform(F.coalesce(spans, none), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(k), F.coalesce(s["kind"], F.lit(""))).alias("kind")))
    merged = merge_spans(F.concat(tagged(pattern, "0"), tagged(other, "1")))
    return F.transform(merged, lambda s: s.withField("kind", F.substring(s["kind"], F.lit(2), F.length(s["kind"]))))


def gained(pattern: Column, merged: Column) -> Column:
    """Spans that the second channel added."""
    return F.greatest(F.lit(0), F.size(merged) - F.size(pattern))
