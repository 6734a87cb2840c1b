"""Extraction, context invariants, geometry, tagging, planning, streaming and files."""

import random

import numpy as np
from pyspark.sql import functions as F

from hushframe.operators import context, evaluate, extract, geometry, synth, tagger
from hushframe.plans import planner
from hushframe.sources import files
from hushframe.streaming.agent_loop import Loop, watch_loops

PAGE = """<html><head><title>T</title></head><body><h1>Account</h1><p>Mail <b>a.b@x</b>.com now</p><div>abc<p>x y z</p>def</div><script>var t="</p>4539578763621486"</script>
<p>Aadhaar 2341 2341 </p><p>2346 reference</p><input type="password" name="p" value="hunter2"><input type="text" placeholder="Your name" value="v"><input autocomplete="cc-number">
<a href="#">Orders of a.b@x.com</a><button>Go</button><p>ORDER-100000000000</p></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "https://h.example/p?token=SHOULD_NOT_LEAK#f", PAGE), (2, "https://h.example/", ""), (3, None, None)], "page_id long, url string, html string")


def test_two_block_semantics(spark):
    cut = spark.createDataFrame([("<div>abc<p>x y</p>def</div>a<br>bcd<b>e</b>f &amp; <style>p{}</style>",)], "h string").select(extract.text_blocks(F.col("h"))).first()[0]
    assert cut == ["abc", "x y", "def", "bcdef &amp;"]
    dom = spark.createDataFrame([(1, "<div>abc<p>x y</p>def</div>")], "page_id long, html string")
    assert [(r.ord, r.text) for r in extract.dom_blocks(dom).orderBy("ord").collect()] == [(0, "abcdef"), (1, "x y")]


def test_context_invariants(spark):
    got = {r.page_id: r for r in context.build_context(pages(spark)).collect()}
    one = got[1]
    payload = one.asDict(recursive=True)
    text = str(payload)
    assert "hunter2" not in text and "SHOULD_NOT_LEAK" not in text and "a.b@x.com" not in text and "2346" not in text
    assert "ORDER-100000000000" in one.text and one.by_kind["email"] == 2 and one.url == "https://h.example/p"
    assert [e.sensitive for e in one.elements][:3] == ["password", None, "autocomplete:cc-number"]
    assert one.elements[3].label == "Orders of [[EMAIL]]" and one.redacted_elements == 2
    assert got[2].text == "" and got[3].text == "" and len(got) == 3


def test_straddling_span_is_clamped(spark):
    rows = spark.createDataFrame([("Aadhaar 2341 2341 ", "2346 reference")], "p string, t string")
    span = rows.select(context.block_spans(F.col("p"), F.col("t"))).first()[0]
    assert [(s.kind, s.start, s.end) for s in span] == [("aadhaar", 0, 4)]


def test_cap_never_drops_sensitive_elements(spark):
    pick = random.Random(1)
    data = [(p, i, "password" if pick.random() < 0.3 else None) for p in range(20) for i in range(pick.randrange(1, 30))]
    got = {(r.page_id, r.i): r.kept for r in context.capped(spark.createDataFrame(data, "page_id long, i int, sensitive string"), 5).collect()}
    for p in range(20):
        kept = 0
        for _, i, s in (d for d in data if d[0] == p):
            want = s is not None or kept < 5
            kept += want
            assert got[p, i] == want


def test_unknown_viewport_hides_nothing(spark):
    row = spark.createDataFrame([(5, 5, 9000, 9000, None, None, None), (5, 5, 9000, 9000, 800, 600, False), (1, 5, 0, 0, 800, 600, False)], "w int, h int, x int, y int, vw int, vh int, hid boolean")
    assert [r[0] for r in row.select(context.visible(*(F.col(c) for c in ("w", "h", "x", "y", "vw", "vh", "hid")))).collect()] == [True, False, False]


def box(x, y, w, h, kind="screen"):
    return F.struct(*(F.lit(v).alias(k) for k, v in zip(("x", "y", "w", "h", "kind"), (x, y, w, h, kind))))


def test_fusion_suppresses_only_what_clean_boxes_explain(spark):
    regions = F.array(box(0, 0, 10, 10), box(100, 100, 10, 10), box(0, 0, 10, 10, "unscanned"), box(50, 50, 10, 10))
    clean, opaque = F.array(box(0, 0, 10, 8), box(50, 50, 10, 10)), F.array(box(50, 50, 5, 10))
    got = spark.range(1).select(geometry.fuse(regions, clean, opaque)).first()[0]
    assert [(r.x, r.kind) for r in got] == [(100, "screen"), (0, "unscanned"), (50, "screen")]


def test_nms_is_greedy(spark):
    kind = "struct<x:int,y:int,w:int,h:int,score:double,id:int>"
    rows = spark.createDataFrame([([(0, 0, 10, 10, 0.9, 1), (4, 0, 10, 10, 0.8, 2), (8, 0, 10, 10, 0.7, 3), (0, 0, 10, 10, 0.5, 4)],)], f"b array<{kind}>")
    assert [b.id for b in rows.select(geometry.nms(F.col("b"), kind)).first()[0]] == [1, 3]


def test_grid_components():
    grid = np.zeros((4, 5))
    grid[0, 0] = grid[0, 1] = grid[1, 1] = grid[3, 4] = 0.9
    grid[2, 2] = 0.95
    assert geometry.grid_components(grid.ravel(), 4, 5, 0.5) == [(0, 0, 2, 2, 3, 0.9), (2, 2, 3, 3, 1, 0.95), (4, 3, 5, 4, 1, 0.9)]


def test_unseen_grid_is_one_whole_box(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.1])], "id long, cells array<double>")
    assert {(r.id, r.x1, r.y1) for r in geometry.grid_boxes(rows, 2, 3, 0.5).collect()} == {(1, 3, 2), (2, 3, 2)}


def test_tags_to_spans(spark):
    text = "नाम राम, है 12 ab34"
    data = text.encode()
    kinds = [None] * len(data)
    at = len("नाम ".encode())
    for k in range(at + 1, at + 7):
        kinds[k] = "name"
    kinds[len(data) - 1] = "number"
    spans = tagger.decode_tags(data, kinds)
    assert [(k, data[a:b].decode()) for k, a, b in spans] == [("name", "राम"), ("number", "ab34")]
    docs = spark.createDataFrame([(1, "number 12345, then 678"), (2, None)], "doc_id long, text string")
    assert {(r.start, r.end) for r in tagger.tag_spans(docs, tagger.digit_scorer).collect()} == {(7, 12), (19, 22)}

    def broken(data):
        raise RuntimeError

    assert [tuple(r) for r in tagger.tag_spans(docs, broken).collect()] == [(1, "unscanned", 0, 22)]


def test_tagger_reads_texts_of_over_a_million_bytes_whole(spark):
    text = "é " * 400_000 + "call 12345 now " + "a" * 310 + " 678901 end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {text[r.start : r.end] for r in tagger.tag_spans(docs, tagger.digit_scorer).collect()} == {"12345", "678901"}
    seen = []
    tagger.scored(text.encode(), lambda window: seen.append(len(window)) or [None] * len(window))
    assert max(seen) == tagger.WIDTH and len(seen) == -(-(len(text.encode()) - tagger.WIDTH) // tagger.STRIDE) + 1

    def broken(data):
        raise RuntimeError

    assert [tuple(r) for r in tagger.tag_spans(docs, broken).collect()] == [(1, "unscanned", 0, len(text))]


def test_windows_cover_everything(spark):
    for n in (0, 5, 8, 384, 385, 700, 1000, 1345):
        starts = spark.range(1).select(tagger.window_starts(F.lit(n))).first()[0]
        assert starts == [s for k, s in enumerate(range(0, n, 320)) if n - s >= 8 and (k == 0 or s - 320 + 384 < n)]
        assert n < 8 or max(s + 384 for s in starts) >= n


def test_match_counts_add_up(spark):
    pick = random.Random(3)
    make = lambda n: [(pick.randrange(5), pick.choice("ab"), pick.choice("xyz"), k) for k in range(n)]
    gold, found, base = (spark.createDataFrame(make(n), "page_id long, kind string, norm string, ord int") for n in (80, 70, 20))
    rows = evaluate.bag_match(gold, found, base)
    total = rows.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("pool").alias("pool")).first()
    assert total.tp + total.fn == 80 and total.tp + total.fp == total.pool == found.select("page_id", "kind", "norm").exceptAll(base.select("page_id", "kind", "norm")).count()


def test_planted_values_are_found_as_planted(spark):
    made = synth.generate_pages(spark, 40)
    gold = synth.planted(made.select("page_id"), 8)
    texts = made.select("page_id", F.explode(F.concat(extract.text_blocks(F.col("html")), extract.attr_values(F.col("html")))).alias("t"))
    from hushframe.functions.scan import scan_text

    found = texts.select("page_id", F.explode(scan_text(F.col("t"))).alias("s")).select("page_id", F.col("s.kind").alias("kind"), evaluate.norm_value(F.col("s.raw")).alias("norm"))
    truth = gold.select("page_id", "kind", evaluate.norm_value(F.col("value")).alias("norm"), "hard", "ord")
    overall = evaluate.prf(evaluate.bag_match(truth.filter("hard is null or hard <> 'canvas'"), found), "kind").filter("kind is null").first()
    assert overall.recall == 1.0 and overall.precision > 0.98
    hard = {r.hard: (r.found, r.total) for r in evaluate.hard_recall(truth, found).collect()}
    assert hard["split"][0] == hard["split"][1] and hard["canvas"][0] == 0


ELEMENTS = [(0, "input", "text", None, "Name", None, False), (1, "input", "password", None, "Pass", "password", False), (2, "input", "text", None, "Card", "autocomplete:cc-number", True), (3, "button", None, None, "Submit request", None, None)]


def plan(spark, goal, history=(), elements=ELEMENTS, reply=None):
    row = spark.createDataFrame([(goal, "text", elements, list(history), reply)], f"g string, t string, e {planner.ELEMENTS}, h {planner.HISTORY}, r string")
    return row.select(planner.decide(F.col("g"), F.col("t"), F.col("e"), F.col("h"), F.col("r")).alias("p")).first().p


def test_planner(spark):
    assert (plan(spark, "fill in: Ann").action.type, plan(spark, "fill in: Ann").action.text) == ("type", "Ann")
    assert plan(spark, "fill my password").action is None
    assert plan(spark, "submit the request").action["index"] == 3
    assert plan(spark, "fill in: Ann", [("type", 0)]).action is None  # only sensitive fields are left
    assert plan(spark, "submit the request", [("click", 3)]).action.type == "noop"
    assert plan(spark, "dance", reply='so {"type":"click","index":3}').action.type == "click"
    assert plan(spark, "dance", reply='{"type":"type","index":1,"text":"x"}').action.type == "noop"
    assert plan(spark, "fill my password", reply='{"type":"click","index":3}').action is None


def test_request_bounds(spark):
    row = spark.createDataFrame([("g" * 2001, "t" * 32001, ELEMENTS, "s", []), ("g", "t", ELEMENTS, None, []), (None, "t", ELEMENTS, None, [])], f"g string, t string, e {planner.ELEMENTS}, s string, h {planner.HISTORY}")
    got = row.select(planner.request_problems(*(F.col(c) for c in "gtesh"))).collect()
    assert [r[0] for r in got] == [["goal", "text"], [], ["goal"]]


STEPS = {
    1: [("a", "noop", True)],
    2: [("a", None, True)],
    3: [("a", "click", False)],
    4: [("a", "click", True), ("a", "click", True), ("b", "click", True)],
    5: [("ab"[k % 2], "click", True) for k in range(12)],
    6: [("a", "click", True), ("b", "click", True)],
}
WANT = {1: (1, "done"), 2: (1, "done"), 3: (1, "action failed"), 4: (2, "stalled"), 5: (8, "limit"), 6: (2, "open")}
SCHEMA = "run_id long, n int, signature string, kind string, executed boolean"


def test_loop_replay_and_single_step(spark):
    data = [(r, n, *s) for r, steps in STEPS.items() for n, s in enumerate(steps, 1)]
    got = {r.run_id: (r.stopped_at, r.reason) for r in planner.replay(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == WANT
    assert Loop(most=1).step("a", "click", True) == "done"


def test_loop_stream(spark, tmp_path):
    source, data = tmp_path / "in", [(r, n, *s) for r, steps in STEPS.items() for n, s in enumerate(steps, 1)]
    data.sort(key=lambda d: d[1])
    for k in (0, 1):  # two batches, so that state is carried over
        spark.createDataFrame(data[: len(data) // 2] if k == 0 else data[len(data) // 2 :], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = watch_loops(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("loops").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.run_id: (r.stopped_at, r.reason) for r in spark.table("loops").collect()}
    assert got == {k: v for k, v in WANT.items() if v[1] != "open"}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", None, "<p>x</p>", None, (800, 600), [("a", "email", "a@x.com", None, None)]), (2, None, None, "", None, None, None)], files.MANIFEST)
    assert tuple(files.write_manifest(rows, str(tmp_path / "m")).first()) == (2, 1)
    assert sorted(r.id for r in files.read_manifest(spark, str(tmp_path / "m")).collect()) == [1, 2]
    (tmp_path / "urls.txt").write_text("http://a  http://b\nhttp://c\n")
    assert files.read_addresses(spark, str(tmp_path / "urls.txt")).count() == 3
    spark.createDataFrame([("mail a@x.com", "en", [(5, 12, "EMAIL")])], files.MASKED).write.parquet(str(tmp_path / "p"))
    assert files.read_masked(spark, str(tmp_path / "p")).first().spans[0].value == "a@x.com"
    assert spark.range(1).select(files.padded(F.array(F.lit(1), F.lit(2)), 4)).first()[0] == [1, 2, 0, 0]
    record = context.build_context(pages(spark))
    assert set(files.payload(record).columns) == {"payload"} and "visual_candidates" not in files.payload(record).first().payload
