"""Typed span detection as column expressions: matches with offsets, verification in context, overlap resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.checksum import luhn_ok, once, verhoeff_ok
from hushframe.functions.patterns import AUDIT_RULES, RULES, Rule, jvm

SPAN = "array<struct<kind:string,severity:int,start:int,end:int,length:int,source:string,raw:string,rule:int>>"
_HIT = "array<struct<start:int,raw:string,before:string,after:string>>"
#: Characters before a match that a context is looked for in; the matches that hold so many at least.
BEFORE, LOOK = 48, 12
#: Matches whose lengths are summed in one go.
RUN = 64


def last_part(text: Column, n: int) -> Column:
    """The last n characters; F.right evaluates its text twice."""
    return F.substring(text, -n, 2**31 - 1)


def sums_before(lengths: Column, then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """then(before), where before(i) is the sum of the first i lengths: by runs, as a fold that appends to an array is slow."""
    total = lambda some: F.aggregate(some, F.lit(0), lambda t, x: t + x)

    def by_runs(n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / RUN).cast("int")), lambda k: total(F.slice(n, k * RUN + 1, F.lit(RUN))))
        return once(runs, lambda r: once(F.transform(r, lambda _, k: total(F.slice(r, F.lit(1), k))), lambda starts: then(lambda i: starts[F.floor(i / RUN).cast("int")] + total(F.slice(n, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)))))

    return once(lengths, by_runs)


def matches(text: Column, pattern: str, context: bool = True) -> Column:
    """All leftmost matches as structs of start (code points), raw, and, if asked for, the text just before and after, from the text's gaps and matches.
    Each is evaluated once, and no match goes back to the text or to all matches before it."""
    none = F.array().cast(_HIT)

    def of(b: Column) -> Column:
        def around(i: Column) -> tuple[Column, Column]:
            if not context:
                return F.lit(""), F.lit("")
            parts = F.transform(F.sequence(F.greatest(i - LOOK, F.lit(0)), i), lambda j: F.concat(b["gaps"][j], F.when(j < i, b["found"][j]).otherwise("")))
            after = F.concat(b["gaps"][i + 1], F.coalesce(F.get(b["found"], i + 1), F.lit("")))
            return last_part(F.array_join(parts, ""), BEFORE), F.substring(after, 1, 1)

        def hits_of(before: Callable[[Column], Column]) -> Column:
            def hit(raw: Column, i: Column) -> Column:
                near, after = around(i)
                return F.struct((before(i) + F.length(b["gaps"][i])).cast("int").alias("start"), raw.alias("raw"), near.alias("before"), after.alias("after"))

            return F.transform(b["found"], hit)

        return sums_before(F.transform(b["found"], lambda raw, i: F.length(b["gaps"][i]) + F.length(raw)), hits_of)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), once(both, of)).otherwise(none)


def _passes(rule: Rule, hit: Column) -> Column:
    raw, before = hit["raw"], hit["before"]
    digits = F.regexp_replace(raw, jvm(r"[\s-]"), "")
    if rule.verify == "verhoeff":
        return verhoeff_ok(digits)
    if rule.verify == "luhn":
        return luhn_ok(digits)
    if rule.verify == "aadhaar":
        return verhoeff_ok(digits) & (~raw.rlike(jvm(r"[\s-]")) | last_part(before, 40).rlike(jvm(P.AADHAAR_CONTEXT)))
    if rule.verify == "phone":
        return ~before.rlike(r"[0-9]\z") & ~hit["after"].rlike("[0-9]") & ~before.rlike(jvm(P.ID_CONTEXT))
    return before.rlike(jvm({"birth": P.DOB_CONTEXT, "labelled": P.ID_CONTEXT}[rule.verify]))


def hits(text: Column, rule: Rule, order: int, unicode: bool = False) -> Column:
    """Verified spans of one rule. A match that fails its test is used up all the same."""
    found = matches(text, jvm(rule.pattern, unicode), rule.verify in ("aadhaar", "phone", "birth", "labelled"))
    if rule.verify:
        found = F.filter(found, lambda hit: _passes(rule, hit))
    return F.transform(
        found,
        lambda h: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.severity).alias("severity"),
            h["start"].alias("start"),
            (h["start"] + F.length(h["raw"])).alias("end"),
            F.length(h["raw"]).alias("length"),
            F.lit("pattern").alias("source"),
            h["raw"].alias("raw"),
            F.lit(order).alias("rule"),
        ),
    )


def candidates(text: Column, rules: tuple[Rule, ...] = RULES, unicode: bool = False) -> Column:
    """Verified spans of all rules before overlaps are resolved. Every rule needs a digit or an @, so other texts are skipped; null gives none."""
    spans = reduce(F.concat, [hits(text, rule, k, unicode) for k, rule in enumerate(rules)])
    return F.when((F.length(text) >= 4) & text.rlike(r"[\p{Nd}@]"), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def resolve(spans: Column) -> Column:
    """Greedy: by start, then severity, then length, then rule; a span stays if it starts at or after the end of the last one kept."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["severity"]).alias("b"), (-s["length"]).alias("c"), s["rule"].alias("d"), s.alias("s"))))

    def choose(all_: Column) -> Column:
        # Where spans overlap, a fold marks those that stay.
        step = lambda acc, x: F.when(x["s"]["start"] >= acc["end"], F.struct(x["s"]["end"].alias("end"), F.concat(acc["stay"], F.lit("1")).alias("stay"))).otherwise(F.struct(acc["end"].alias("end"), F.concat(acc["stay"], F.lit("0")).alias("stay")))
        marks = F.aggregate(all_, F.struct(F.lit(0).alias("end"), F.lit("").alias("stay")), step, lambda acc: acc["stay"])
        chosen = once(marks, lambda m: F.filter(all_, lambda x, i: F.substring(m, i + 1, F.lit(1)) == "1"))
        return F.transform(F.when(crossing(F.transform(all_, lambda x: x["s"])), chosen).otherwise(all_), lambda x: x["s"])

    return once(ordered, choose)


def crossing(spans: Column) -> Column:
    """Whether any span, in order, starts before the end of the one before it."""
    return once(spans, lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(s, i)["start"] < F.get(s, i - 1)["end"], F.lit(False))))


def scan_text(text: Column) -> Column:
    """Disjoint typed spans of a text, in order."""
    return resolve(candidates(text))


def audit_kinds(text: Column) -> Column:
    """Sorted distinct kinds the audit finds: no contexts, no overlap resolution."""
    return F.array_sort(F.array_distinct(F.transform(candidates(text, AUDIT_RULES, unicode=True), lambda s: s["kind"])))
