"""Byte tags from runs: against a model byte by byte, and no row for each byte before the last step."""

import random

from pyspark.sql import functions as F

from hushframe import queries
from hushframe.functions.patterns import TAG_CLASSES
from hushframe.operators import evaluate, tagger

SPANS = "doc_id long, text string, ord int, label string, start int, end int"


def made():
    rng = random.Random(8)
    for doc in range(40):
        text = "".join(rng.choice("aé漢 ") for _ in range(rng.randint(0, 400)))
        for k in range(rng.randint(0, 12)):
            start = rng.randint(0, len(text) + 3)
            yield doc, text, k, rng.choice([*TAG_CLASSES, "EMAIL"]), start, start + rng.randint(0, rng.choice([5, 300]))


def model(rows):
    out = {}
    for doc, text, _, label, start, end in sorted(rows, key=lambda r: (r[0], r[2])):
        a, b = len(text[:start].encode()), len(text[:end].encode())
        if label in TAG_CLASSES and a < len(text.encode()):
            out |= {(doc, k): ("B-" if k == a else "I-") + TAG_CLASSES[label] for k in range(a, max(b, a + 1))}
    return out


def test_byte_tags_equal_a_model(spark):
    rows = list(made())
    assert {(r["doc_id"], r["pos"]): r["tag"] for r in tagger.bio_tags(spark.createDataFrame(rows, SPANS)).collect()} == model(rows)


def test_only_spans_are_grouped(spark):
    rows = spark.createDataFrame([(1, "x" * 100_000, k, "CITY", k * 1000, k * 1000 + 900) for k in range(100)], SPANS)
    assert tagger.bio_tags(rows).count() == 90_000
    plan = tagger.bio_tags(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(pos") < plan.index("collect_list") and "max_by" not in plan


def test_scores_of_runs_are_those_of_bytes(spark):
    rows = spark.createDataFrame(list(made()), SPANS)
    some = F.expr("(doc_id + ord) % 3 <> 1")
    runs = evaluate.run_prf(tagger.bio_runs(rows, g=F.lit(True), p=some))
    assert sorted(map(str, runs.collect())) == sorted(map(str, evaluate.byte_prf(tagger.bio_tags(rows), tagger.bio_tags(rows.filter(some))).collect()))


def test_the_query_shuffles_no_bytes(spark):
    plan = queries.queries()["byte_prf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list") and ", pos#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
