import numpy as np
from pyspark.sql import functions as F

from hushframe.functions import records, redact
from hushframe.operators import pixels, tagger


def test_masking_blacks_out_or_averages():
    picture = np.arange(4 * 6 * 3, dtype=float).reshape(4, 6, 3)
    out = pixels.mask(picture, [{"x": 0, "y": 0, "w": 2, "h": 2, "mode": "blackout"}, {"x": 3, "y": 1, "w": 99, "h": 2, "mode": "blur"}, {"x": 9, "y": 9, "w": 1, "h": 1, "mode": "blur"}])
    assert (out[:2, :2] == 0).all() and np.ptp(out[1:3, 3:, 0]) == 0 and (out[3] == picture[3]).all()
    picture[0, 0] = np.nan
    assert (pixels.mask(picture, [{"x": 0, "y": 0, "w": 2, "h": 2, "mode": "blur"}])[:2, :2] == 0).all()
    assert pixels.frame_tensor(out, 8, 4).shape == (1, 3, 8, 4)


def test_channels_keep_the_patterns_kind(spark):
    rows = spark.createDataFrame([([(0, 4, "pan"), (10, 12, "dob")], [(0, 4, "name"), (3, 8, "name"), (20, 22, None)]), ([(1, 2, "pan")], None)], "a array<struct<start:int,end:int,kind:string>>, b array<struct<start:int,end:int,kind:string>>")
    got = [[tuple(s) for s in r.m] for r in rows.select(redact.merge_channels(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [[(0, 8, "pan"), (10, 12, "dob"), (20, 22, "")], [(1, 2, "pan")]]


def test_spans_go_to_the_block_they_start_in(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 5000), (1, 1, 5001, 5010), (1, 2, 5011, 5011)], "id long, block int, start int, stop int")
    spans = spark.createDataFrame([(1, "a", 4990, 5005), (1, "b", 5000, 5003), (1, "c", 5001, 5002), (1, "d", 0, 3)], "id long, kind string, start int, stop int")
    got = {tuple(r) for r in tagger.spans_to_blocks(spans, blocks, 64).collect()}
    assert got == {(1, 0, "a", 4990, 5000), (1, 1, "c", 0, 1), (1, 0, "d", 0, 3)}


def test_letterbox_round_trip(spark):
    box = records.letterbox(F.lit(300), F.lit(100), 640)
    point = records.unletterbox(F.lit(0.0) + box["pad_x"] + 10 * box["scale"], F.lit(0.0) + box["pad_y"] + 20 * box["scale"], box)
    got = spark.range(1).select(point.alias("p")).first().p
    assert abs(got.x - 10) < 1e-9 and abs(got.y - 20) < 1e-9
