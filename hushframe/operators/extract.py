"""Text blocks, text nodes, attribute values and form elements from HTML; URL cleaning; tokens.

Two block semantics are kept apart: `text_blocks` cuts the markup at block tags by expressions; `dom_blocks` groups text by its nearest
block element with a real parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.patterns import WHITE

_BREAK = "\x00"


def stripped(html: Column) -> Column:
    """The markup without scripts and styles and what they hold."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def one_space(text: Column) -> Column:
    return trim_white(F.regexp_replace(text, f"[{WHITE}]+", " "))


def text_blocks(html: Column) -> Column:
    """Texts between block tags, inline tags dropped, white space collapsed, of three characters or more."""
    cut = F.split(F.regexp_replace(stripped(html), rf"(?i)</?(?:{P.BLOCK_TAGS})\b[^>]*>", _BREAK), _BREAK, -1)
    return F.filter(F.transform(cut, lambda t: one_space(F.regexp_replace(t, "<[^>]*>", ""))), lambda t: F.length(t) >= 3)


def text_nodes(html: Column) -> Column:
    """Trimmed runs between tags, on markup whose angle brackets balance."""
    return F.filter(F.transform(F.split(stripped(html), "<[^>]*>", -1), trim_white), lambda t: t != "")


def text_runs(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text): trimmed text outside tags on any markup, balanced or not.

    Each < opens a level and each > closes one; what stands at level 0 or below is text, and a run of it ends at the next <. So a piece between two < starts at
    the level (pieces before it, less the > in them), and its text is what follows as many > as that. One window by page; empty and null pages have no rows.
    """
    order = Window.partitionBy("page_id").orderBy("pos")
    pieces = pages.select("page_id", F.posexplode(F.split(stripped(F.col("html")), "<", -1)).alias("pos", "piece")).withColumn("parts", F.split("piece", ">", -1))
    closed = F.sum(F.size("parts") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    level = F.greatest(F.col("pos") - F.coalesce(closed, F.lit(0)), F.lit(0)).cast("int")
    rows = pieces.withColumn("text", trim_white(F.array_join(F.slice("parts", level + 1, F.size("parts")), ""))).filter("text <> ''")
    return rows.select("page_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "text")


def hosts(nodes: DataFrame, index: Column, key: str = "page_id", order: str = "ord") -> DataFrame:
    """The text node of each page that index (modulo their number) picks among those that can hold an injected text: long, in a visible box, not in a script."""
    fit = (F.length(trim_white(F.col("text"))) >= 40) & (F.col("w") >= 80) & (F.col("h") >= 10) & ~F.lower("tag").isin("script", "style", "noscript")
    w = Window.partitionBy(key)
    rows = nodes.filter(fit).withColumns({"nth": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    return rows.filter(F.col("nth") == F.pmod(index, F.col("n"))).drop("nth", "n")


def attr_values(html: Column) -> Column:
    """Non-blank double-quoted values of value, alt, placeholder and aria-label."""
    found = F.regexp_extract_all(stripped(html), F.lit(r'(?i)(?:value|alt|placeholder|aria-label)="([^"]*)"'), F.lit(1))
    return F.filter(F.transform(found, trim_white), lambda t: t != "")


def joined_text(html: Column) -> Column:
    return F.array_join(F.concat(text_nodes(html), attr_values(html)), " ")


def prose(html: Column) -> Column:
    """Text with tags as spaces; null under 200 characters."""
    text = one_space(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), "<[^>]*>", " "))
    return F.when(F.length(text) >= 200, text)


def visual_candidates(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<(img|video|canvas)\b[^>]*>"), F.lit(1))


def clean_url(url: Column) -> Column:
    """Origin and path; query and fragment go."""
    return F.regexp_replace(url, r"[?#].*", "")


def goal_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2))




class _Dom(HTMLParser):
    """Text by its nearest element that isn't inline, and interactive elements by their place in the document."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.blocks: dict[int, list[str]] = {}
        self.elements: list[dict] = []
        self.made = 0
        self.open_labels: list[tuple[int, int]] = []

    def handle_starttag(self, tag, attrs):
        self.made += 1
        get = dict((k, v or "") for k, v in attrs)
        if tag in P.INTERACTIVE_TAGS or get.get("role") in P.INTERACTIVE_ROLES or get.get("contenteditable") == "true":
            self.elements.append({"i": len(self.elements), "tag": tag, "text": [], **{k: get.get(k, "") for k in ("type", "role", "name", "id", "aria-label", "placeholder", "autocomplete", "value")}})
            if tag not in self.VOID:
                self.open_labels.append((len(self.stack), len(self.elements) - 1))
        if tag not in self.VOID:
            self.stack.append((tag, self.made))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is not None:
            del self.stack[at:]
            self.open_labels = [x for x in self.open_labels if x[0] < at]

    def handle_data(self, data):
        if not data.strip(WHITE) or (self.stack and self.stack[-1][0] in P.SKIPPED_TAGS) or any(t == "head" for t, _ in self.stack):
            return
        block = next((n for t, n in reversed(self.stack) if t not in P.INLINE_TAGS), 0)
        self.blocks.setdefault(block, []).append(data)
        for _, e in self.open_labels:
            self.elements[e]["text"].append(data)


def parse_dom(html: str) -> _Dom:
    dom = _Dom()
    dom.feed(html)
    dom.close()
    return dom


ELEMENT = "i int, tag string, type string, role string, name string, id string, aria_label string, placeholder string, autocomplete string, value string, text string"


def dom_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text): fragments joined by their block element, blocks in the order first seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, k, "".join(parts)) for p, html in zip(*(c.to_pylist() for c in batch.columns)) for k, parts in enumerate(parse_dom(html or "").blocks.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int32(), pa.string()))], ["page_id", "ord", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, ord int, text string")


def dom_elements(pages: DataFrame) -> DataFrame:
    """Interactive elements with their index in the full list of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "i", "tag", "type", "role", "name", "id", "aria_label", "placeholder", "autocomplete", "value", "text"]
        types = [pa.int64(), pa.int32(), *[pa.string()] * 10]
        for batch in batches:
            out = []
            for p, html in zip(*(c.to_pylist() for c in batch.columns)):
                for e in parse_dom(html or "").elements:
                    out.append((p, e["i"], e["tag"], *(e[k] for k in ("type", "role", "name", "id", "aria-label", "placeholder", "autocomplete", "value")), "".join(e["text"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 12, types)], names)

    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, {ELEMENT}")
