"""Detection and redaction of a text take time in proportion to its matches."""

import time

from pyspark.sql import functions as F

from hushframe.functions.redact import redact_text
from hushframe.functions.scan import matches, scan_text


def test_ten_thousand_matches_in_one_text(spark):
    def took(n):
        text = " ".join(f"u{k}@mail.example.com," for k in range(n))
        rows = spark.createDataFrame([(text,)], "text string").withColumn("spans", scan_text(F.col("text")))
        began = time.perf_counter()
        (out,) = rows.select(F.size("spans").alias("n"), redact_text(F.col("text"), F.col("spans")).alias("red")).collect()
        assert out.n == n and out.red == " ".join(["[[EMAIL]],"] * n)
        return time.perf_counter() - began

    took(10)
    few, many = took(100), took(10_000)
    assert many < 20 * max(few, 1.0)


def test_matches_know_what_is_around_them(spark):
    (row,) = spark.createDataFrame([("é12 34x56",), ], "text string").select(matches(F.col("text"), "[0-9]+").alias("m")).collect()
    assert [tuple(m) for m in row.m] == [(1, "12", "é", " "), (4, "34", "é12 ", "x"), (7, "56", "é12 34x", "")]
