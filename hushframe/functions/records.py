"""Small projections of records: prompts, histories, error texts, escapes, transforms between image and page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the user is told, by the pattern an error matches; fixed values.
ERRORS = (
    (r"(?i)Receiving end does not exist|Could not establish connection", "No content script on this page. Browser-internal pages cannot be scanned — try a normal website."),
    (r"(?i)timed out", "Timed out waiting for the page."),
    (r"(?i)Failed to fetch|NetworkError", "Cannot reach the server. Is it running on port 8000?"),
)


def friendly_error(message: Column) -> Column:
    out = message
    for pattern, text in reversed(ERRORS):
        out = F.when(message.rlike(pattern), text).otherwise(out)
    return out


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def prompt(goal: Column, text: Column, elements: Column, most: int = 60, label: int = 60, chars: int = 1500) -> Column:
    """What a planner model is shown: the goal, the first elements with short labels, the head of the text."""
    line = lambda e: F.concat_ws(" ", F.concat(F.lit("["), e["i"].cast("string"), F.lit("]")), e["tag"], F.substring(F.coalesce(e["label"], F.lit("")), 1, label), F.when(e["sensitive"].isNotNull(), F.lit("(sensitive)")))
    return F.concat_ws("\n", F.concat(F.lit("Goal: "), goal), F.array_join(F.transform(F.slice(elements, 1, most), line), "\n"), F.concat(F.lit("Text: "), F.substring(text, 1, chars)))


def history_host(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("page"))


def clamp_setting(value: Column, low: int = 1, high: int = 20, default: int = 8) -> Column:
    """An integer setting between its bounds; what doesn't parse, or is 0, is the default."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.nullif(value.try_cast("int"), F.lit(0)), F.lit(default))))


def letterbox(width: Column, height: Column, side: int) -> Column:
    """Scale and pads that fit a picture in a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    return F.struct(scale.alias("scale"), F.floor((side - F.floor(width * scale + 0.5)) / 2).cast("int").alias("pad_x"), F.floor((side - F.floor(height * scale + 0.5)) / 2).cast("int").alias("pad_y"))


def unletterbox(x: Column, y: Column, box: Column) -> Column:
    """A point of the square back in the picture."""
    return F.struct(((x - box["pad_x"]) / box["scale"]).alias("x"), ((y - box["pad_y"]) / box["scale"]).alias("y"))


def to_page(region: Column, frame: Column, natural_w: Column, natural_h: Column) -> Column:
    """A region of a picture in the page's coordinates."""
    sx, sy = frame["w"] / natural_w, frame["h"] / natural_h
    half_up = lambda v, k: F.floor(v + 0.5).cast("int").alias(k)
    return F.struct(half_up(frame["x"] + region["x"] * sx, "x"), half_up(frame["y"] + region["y"] * sy, "y"), half_up(region["w"] * sx, "w"), half_up(region["h"] * sy, "h"))


def transport_scale(width: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / width)
