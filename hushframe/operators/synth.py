"""Checksum-valid test identifiers, decoys, labelled pages and injection into real pages, all from hashes of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.checksum import luhn_digit, once, verhoeff_digit

KINDS = "aadhaar card pan ifsc phone_in upi email dob".split()


def pick(key: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n))


def digits(key: Column, salt: str, n: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")


def letters(key: Column, salt: str, n: int, of: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    return F.concat(*(F.substring(F.lit(of), (pick(key, f"{salt}{k}", len(of)) + 1).cast("int"), F.lit(1)) for k in range(n)))


def aadhaar(key: Column) -> Column:
    body = F.concat((pick(key, "a0", 8) + 2).cast("string"), digits(key, "a", 10))
    return F.concat(body, verhoeff_digit(body).cast("string"))


def card(key: Column) -> Column:
    body = F.concat((pick(key, "c0", 2) + 4).cast("string"), digits(key, "c", 14))
    return F.concat(body, luhn_digit(body).cast("string"))


def pan(key: Column) -> Column:
    return F.concat(letters(key, "p", 3), letters(key, "q", 1, "ABCFGHLJPTK"), letters(key, "r", 1), digits(key, "p", 4), letters(key, "s", 1))


def ifsc(key: Column) -> Column:
    return F.concat(letters(key, "i", 4), F.lit("0"), digits(key, "i", 6))


def phone(key: Column) -> Column:
    return F.concat((pick(key, "t0", 4) + 6).cast("string"), digits(key, "t", 9))


def email(key: Column) -> Column:
    return F.concat(F.lit("user"), digits(key, "e", 6), F.lit("@mail.example.org"))


def upi(key: Column) -> Column:
    return F.concat(F.lit("pay"), digits(key, "u", 6), F.lit("@"), F.element_at(F.array(*map(F.lit, ("oksbi", "okicici", "paytm", "ybl"))), (pick(key, "uh", 4) + 1).cast("int")))


def dob(key: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), pick(key, "d", 18_000).cast("int")), "dd/MM/yyyy")


def value_of(kind: Column, key: Column) -> Column:
    made = dict(zip(KINDS, (aadhaar, card, pan, ifsc, phone, upi, email, dob)))
    out = F.lit(None).cast("string")
    for name, make in made.items():
        out = F.when(kind == name, make(key)).otherwise(out)
    return out


def spoiled(number: Column, key: Column) -> Column:
    """The number with its last digit moved by one to nine."""
    moved = lambda n: F.concat(F.substring(n, F.lit(1), F.length(n) - 1), ((F.substring(n, -1, 1).cast("int") + pick(key, "bad", 9) + 1) % 10).cast("string"))
    return once(number, moved)


def decoys(keys: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, value) of strings that look like identifiers and aren't."""
    k = F.col(key)
    made = F.array(
        F.struct(F.lit("starts_with_1").alias("kind"), F.concat(F.lit("1"), digits(k, "x", 11)).alias("value")),
        F.struct(F.lit("bad_luhn").alias("kind"), spoiled(card(k), k).alias("value")),
        F.struct(F.lit("bad_verhoeff").alias("kind"), spoiled(aadhaar(k), k).alias("value")),
        F.struct(F.lit("order").alias("kind"), F.concat(F.lit("ORDER-"), digits(k, "o", 12)).alias("value")),
        F.struct(F.lit("grouped").alias("kind"), F.concat_ws(" ", digits(k, "g", 4), digits(k, "h", 4), digits(k, "j", 4)).alias("value")),
    )
    return keys.select(key, F.explode(made).alias("d")).select(key, "d.kind", "d.value")


def halves(value: Column, tag: str = "b") -> Column:
    """The value split across an inline tag in its middle."""
    half = F.floor(F.length(value) / 2).cast("int")
    return F.concat(F.substring(value, F.lit(1), half), F.lit(f"<{tag}>"), F.substring(value, half + 1, F.length(value)), F.lit(f"</{tag}>"))


LABELS = {"aadhaar": "Aadhaar: ", "dob": "Date of Birth: "}


def planted(pages: DataFrame, per_page: int = 4) -> DataFrame:
    """(page_id, ord, kind, value, hard): what inject plants into each page; every fourth by each strategy text, split, field, and canvas."""
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(per_page - 1))).alias("ord"))
    key = F.col("page_id") * 64 + F.col("ord")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col("page_id") + F.col("ord"), F.lit(len(KINDS))) + 1).cast("int"))
    hard = F.element_at(F.array(F.lit(None).cast("string"), F.lit("split"), F.lit("field"), F.lit("canvas")), (F.col("ord") % 4 + 1).cast("int"))
    return rows.select("page_id", "ord", kind.alias("kind"), value_of(kind, key).alias("value"), hard.alias("hard"))


def inject(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """Pages with the planted values before </body> (or at the end): as text, split over a tag, as a field's value, or on a canvas, where no text shows it."""
    label = F.coalesce(F.when(F.col("kind") == "aadhaar", LABELS["aadhaar"]).when(F.col("kind") == "dob", LABELS["dob"]), F.lit(""))
    piece = (
        F.when(F.col("hard") == "split", F.concat(F.lit("<p>"), label, halves(F.col("value")), F.lit("</p>")))
        .when(F.col("hard") == "field", F.concat(F.lit('<p>field <input type="text" value="'), label, F.col("value"), F.lit('"></p>')))
        .when(F.col("hard") == "canvas", F.lit('<canvas width="200" height="40"></canvas>'))
        .otherwise(F.concat(F.lit("<p>"), label, F.col("value"), F.lit("</p>")))
    )
    added = gold.select("page_id", "ord", piece.alias("piece")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), "").alias("added"))
    html = F.coalesce("html", F.lit(""))
    at = F.instr(F.lower(html), "</body>")
    put = F.when(at > 0, F.concat(F.substring(html, F.lit(1), at - 1), F.col("added"), F.substring(html, at, F.length(html)))).otherwise(F.concat(html, F.col("added")))
    return pages.join(added, "page_id", "left").withColumn("html", F.when(F.col("added").isNull(), F.col("html")).otherwise(put)).drop("added")


def generate_pages(spark: SparkSession, n: int) -> DataFrame:
    """n labelled pages made from their number alone: page_id, url, html."""
    base = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://example.org/p/"), F.col("id"), F.lit("?q=1")).alias("url"))
    noise = F.concat(F.lit("<html><head><title>Page</title></head><body><h1>Record "), F.col("page_id"), F.lit("</h1><p>ORDER-"), digits(F.col("page_id"), "o", 12), F.lit('</p><input type="password" name="secret" value="x"></body></html>'))
    pages = base.withColumn("html", noise)
    return inject(pages, planted(pages, 8))
