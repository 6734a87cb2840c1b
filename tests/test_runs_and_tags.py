"""Text of torn markup, confidence by byte, byte tags, faces and payloads against plain models."""

import random

import numpy as np
from pyspark.sql import functions as F

from hushframe.operators import evaluate, extract, geometry, tagger
from hushframe.plans import planner


def plain_runs(html: str) -> list[str]:
    level, runs, now = 0, [], ""
    for c in html + "<":
        if c == "<":
            runs.append(now.strip())
            level, now = level + 1, ""
        elif c == ">":
            level -= 1
        elif level <= 0:
            now += c
    return [r for r in runs if r]


def test_text_runs_of_any_markup(spark):
    rng = random.Random(5)
    pages = [(k, "".join(rng.choice(["<", ">", "a", "b ", "<p>", "</p>", " ", "é"]) for _ in range(rng.randint(0, 40)))) for k in range(200)] + [(900, None), (901, "")]
    got: dict[int, list] = {}
    for r in extract.text_runs(spark.createDataFrame(pages, "page_id long, html string")).collect():
        got.setdefault(r["page_id"], []).append((r["ord"], r["text"]))
    for k, html in pages:
        assert [t for _, t in sorted(got.get(k, []))] == plain_runs(html or "")
        assert [o for o, _ in sorted(got.get(k, []))] == list(range(len(got.get(k, []))))


def test_confident_scorer_through_windows(spark):
    def logits(window: bytes) -> np.ndarray:
        rows = np.zeros((len(window), 3))
        for k, b in enumerate(window):
            if 48 <= b <= 57:
                rows[k, 1] = 9
            elif b == 120:  # likelier than the others, but not sure enough
                rows[k, 2] = 1
        return rows

    text = "é" * 500 + " code 4711 xxx " + "y" * 900 + " 815"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12")], "doc_id long, text string")
    rows = tagger.tag_spans(docs, tagger.confident_scorer(logits, [None, "number", "name"])).collect()
    assert sorted((r["doc_id"], r["kind"], text[r["start"] : r["end"]]) for r in rows) == [(1, "number", "4711"), (1, "number", "815")]


def test_bio_tags_and_bytes(spark):
    rows = [(1, "né le 5", 0, "CITY", 0, 2), (1, "né le 5", 1, "IP", 1, 3), (1, "né le 5", 2, "EMAIL", 4, 6), (1, "né le 5", 3, "USERNAME", 7, 9), (2, None, 0, "CITY", 0, 2), (3, "ab", 0, "CITY", 1, 1)]
    tags = tagger.bio_tags(spark.createDataFrame(rows, "doc_id long, text string, ord int, label string, start int, end int"))
    assert sorted(map(tuple, tags.collect())) == [(1, 0, "B-ADDR"), (1, 1, "B-IP"), (1, 2, "I-IP"), (1, 3, "I-IP"), (3, 1, "B-ADDR")]
    scores = {r["tag"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.byte_prf(tags, tags.filter("doc_id <> 1 or pos <> 1").unionByName(spark.createDataFrame([(9, 9, "B-IP")], tags.schema))).collect()}
    assert scores == {"B-ADDR": (2, 0, 0), "B-IP": (0, 1, 1), "I-IP": (2, 0, 0), None: (4, 1, 1)}


def test_upper_median(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, 2.0, 2.0, 7.5, -3.0])) for k in (1, 2, 3, None) for _ in range(rng.randint(1, 30))] + [(4, None)]
    got = {r["k"]: r["median"] for r in evaluate.upper_median(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    for k in {k for k, _ in rows}:
        values = sorted(v for q, v in rows if q == k and v is not None)
        assert got[k] == (values[len(values) // 2] if values else None)


def test_faces_come_back_in_picture_pixels(spark):
    anchors = [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 4
    anchors[3] = (1.0, 0.81, 0.5, 0.5, 0.0, 0.0)  # centre (1.5, 1.5) cells, one stride wide
    anchors[2] = (1.0, 0.49, 1.5, 0.5, 0.0, 0.0)  # the same place, less sure
    kind = "struct<x:double,y:double,w:double,h:double,score:double,id:int>"
    row = spark.createDataFrame([(anchors,)], "a array<struct<cls:double,obj:double,dx:double,dy:double,dw:double,dh:double>>")
    faces = geometry.from_letterbox(geometry.nms(geometry.decode_anchors(F.col("a"), 2, 16).cast(f"array<{kind}>"), kind), F.lit(0.5), F.lit(4.0), F.lit(0.0))
    assert [tuple(b) for b in row.select(faces).first()[0]] == [(24.0, 32.0, 32.0, 32.0, 0.9)]


def test_payload_without_secrets_and_with_decoys(spark):
    rows = spark.createDataFrame([("a s1 d1 d2",), ("d1 d2",), ("d1",)], "p string")
    of = lambda *v: F.array(*map(F.lit, v))
    got = rows.select(planner.leaks(F.col("p"), of("s1", "s2")), planner.clean_payload(F.col("p"), of("s1", "s2"), of("d1", "d2"))).collect()
    assert [tuple(r) for r in got] == [(["s1"], False), ([], True), ([], False)]
