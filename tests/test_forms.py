"""Joins on inequalities, image differences, vector reuse, coders and files against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import udfs
from rasterloom.operators import codec, diff, entropy, motion, predict
from rasterloom.operators.relational import band_join, interval_join, salted_aggregate
from rasterloom.sources import files
from rasterloom.sources import frames as fr
from rasterloom.sources.datasource import TestFrames
from rasterloom.sources.settings import settings
from rasterloom.streaming import keyframes


def test_band_join_matches_brute_force(spark):
    r = random.Random(1)
    left = [(k, r.choice("ab") if k % 9 else None, r.randint(-50, 50) if k % 7 else None) for k in range(120)]
    right = [(k, r.choice("ab"), r.randint(-60, 60) if k % 5 else None) for k in range(120)]
    a, b = spark.createDataFrame(left, "i long, g string, x long"), spark.createDataFrame(right, "j long, g string, y long")
    for low, high in ((-3, 4), (0, 0), (5, 17)):
        want = Counter((i, j) for i, g, x in left for j, h, y in right if g == h and g is not None and None not in (x, y) and x + low <= y <= x + high)
        assert Counter((q["i"], q["j"]) for q in band_join(a, b, ["g"], "x", "y", low, high).collect()) == want
    assert band_join(a.limit(0), b, ["g"], "x", "y", 0, 1).collect() == []


def test_interval_join_matches_brute_force(spark):
    r = random.Random(2)
    spans = lambda n: [(k, r.choice("ab"), s := r.randint(-40, 40), s + r.choice([0, 1, 3, 25])) for k in range(n)]
    left, right = spans(90), spans(90)
    a, b = spark.createDataFrame(left, "i long, g string, a1 long, a2 long"), spark.createDataFrame(right, "j long, g string, b1 long, b2 long")
    want = Counter((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    for width in (1, 7, 100):
        assert Counter((q["i"], q["j"]) for q in interval_join(a, b, ["g"], ("a1", "a2"), ("b1", "b2"), width).collect()) == want


def test_salted_aggregate_of_one_hot_key(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("g"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    got = {r["g"]: (r["n"], r["s"], r["low"], r["high"]) for r in salted_aggregate(d, ["g"], "id", {"n": ("count", "v"), "s": ("sum", "v"), "low": ("min", "id"), "high": ("max", "v")}).collect()}
    for g in ("rare", "hot"):
        ids = [k for k in range(1000) if (k % 100 == 0) == (g == "rare")]
        v = [k for k in ids if k % 3 == 0]
        assert got[g] == (len(v), sum(v), min(ids), max(v))


def images(spark):
    """Two streams of differing sizes with small and large changes, a repeat, and a gap of one frame."""
    r, rows = np.random.default_rng(3), []
    for stream, (h, w) in (("a", (38, 50)), ("b", (17, 5)), (None, (3, 3))):
        a = r.integers(0, 4, (h, w, 3)).astype(np.uint8)
        for k in (0, 1, 2, 3, 5, 6):
            rows.append((stream, k, h, w, bytearray(a.tobytes())))
            a = a.copy()
            if k != 1:
                y, x = r.integers(0, h), r.integers(0, w)
                a[y : y + 3, x : x + 20] = r.integers(0, 256, 3)
            if k == 2:
                a[:16, :16] = 255 - a[:16, :16]
    return rows, spark.createDataFrame(rows, "s string, frame_id long, height int, width int, pixels binary").repartition(3)


def test_image_blocks_match_the_pixel_form(spark):
    rows, df = images(spark)
    got = Counter(tuple(r) for r in diff.changed_blocks_of_images(df, "s").collect())
    want = Counter()
    for s in ("a", "b"):
        for part in ((0, 1, 2, 3), (5, 6)):  # frames after a gap have none before
            own = fr.from_images(df.where((F.col("s") == s) & F.col("frame_id").isin(*part)))
            want += Counter((s, *r) for r in diff.changed_blocks(diff.with_previous(own)).collect())
    assert got == want and {k[0] for k in got} == {"a", "b"} and {k[4] for k in got} == {1, 2}


def plain_reuse(prev, cur, rects):
    last, above, out = None, {}, []
    holds = lambda v, x1, y1, x2, y2: x1 + v[0] >= 0 and y1 + v[1] >= 0 and x2 + v[0] <= prev.shape[1] and y2 + v[1] <= prev.shape[0] and np.array_equal(prev[y1 + v[1] : y2 + v[1], x1 + v[0] : x2 + v[0]], cur[y1:y2, x1:x2])
    for i, j, rect in rects:
        tried = [v for v in (last, above.get((i - 1, j))) if v] + list(motion.priorities())
        v = next((v for v in tried if holds(v, *rect)), None)
        if v:
            last, above[i, j] = v, v
        out.append(v)
    return out


def test_vector_reuse_matches_a_plain_search():
    r, reused = np.random.default_rng(4), 0
    for _ in range(25):
        prev = r.integers(0, 2, (48, 64))
        cur = np.roll(prev, (int(r.integers(-6, 7)), int(r.integers(-6, 7))), (0, 1)) if r.random() < 0.7 else r.integers(0, 2, prev.shape)
        rects = [(i, j, (16 * j, 16 * i, 16 * j + int(r.integers(1, 17)), 16 * i + int(r.integers(1, 17)))) for i in range(3) for j in range(4)]
        got = motion.frame_vectors(prev, cur, rects, reuse=True)
        assert got == plain_reuse(prev, cur, rects)
        reused += got != motion.frame_vectors(prev, cur, rects)
    assert reused


@pytest.mark.parametrize("coder", ["rans", "range"])
def test_coders_give_back_intervals_and_raw_bytes(coder):
    r = random.Random(5)
    intervals = [(r.randrange(256), 0) if r.random() < 0.3 else (s := r.randrange(4095), r.randint(1, 4096 - s)) for _ in range(3000)]
    reader = entropy.CODERS[coder].reader(entropy.CODERS[coder].encode(intervals))
    for start, freq in intervals:
        if freq:
            assert start <= reader.peek() < start + freq
            reader.take(start, freq)
        else:
            assert reader.raw() == start


@pytest.mark.parametrize("coder", ["rans", "range"])
def test_codec_takes_either_coder(coder):
    r = np.random.default_rng(6)
    a = r.integers(0, 256, (20, 33, 3)).astype(np.uint8)
    b = a.copy()
    b[3:9, 4:30] = 7
    c = np.full_like(a, 9)
    enc, dec = codec.SegmentCodec(20, 33, coder=coder), codec.SegmentCodec(20, 33, coder=coder)
    assert codec.SegmentCodec(20, 33, coder=coder).decode(enc.encode(b, False)[:1].replace(bytes([codec.CODED]), bytes([codec.DELTA]))) is None
    enc = codec.SegmentCodec(20, 33, coder=coder)
    for image, key in ((a, True), (b, False), (b, False), (c, False), (c, False), (a, False)):
        assert np.array_equal(dec.decode(enc.encode(image, key)), image)


@pytest.mark.parametrize("kind", files.FORMATS)
def test_files_keep_odd_values(spark, tmp_path, kind):
    rows = [(1, 'quote " comma, and\nline', 1.5, True), (2, None, None, None), (3, "é😀 \\ back", -0.0, False), (None, " space ", float("inf"), True)]
    df = spark.createDataFrame(rows, "k long, s string, d double, b boolean")
    if kind == "csv":
        df = df.where("k IS NULL OR k <> 1")  # one record to a line
    files.write_table(df, str(tmp_path / "t"), kind)
    got = files.read_table(spark, str(tmp_path / "t"), kind, df.schema)
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in df.collect())


def test_functions_on_odd_values(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 8.0)], "g string, x double")
    got = {r["g"]: r["m"] for r in udfs.geometric_mean(d.where("g IS NOT NULL"), ["g"], "x", "m").collect()}
    assert set(got) == {"a"} and math.isclose(got["a"], 2.0)
    assert [r[0] for r in spark.createDataFrame([(None,), (1.5,), (-2.0,)], "x double").select(udfs.check_digits("x")).collect()] == [None, 53, -6]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        keyframes.shared_folder(Session())


def test_data_source_deals_frames_to_partitions(spark):
    spark.dataSource.register(TestFrames)
    df = spark.read.format("testframes").options(frames=5, width=7, height=3, partitions=4).load()
    assert df.rdd.getNumPartitions() == 4 and df.schema == fr.FRAME
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter((f, y, x, (7 * x + 3 * y + 5 * f) % 256, (x + 11 * y + f) % 256, (x * y + 2 * f) % 256) for f in range(5) for y in range(3) for x in range(7))
    assert spark.read.format("testframes").options(frames=0).load().count() == 0


def test_settings_take_options_first(spark):
    spark.conf.set("rasterloom.near", "4")
    try:
        assert settings(spark)["near"] == (4, "session") and settings(spark, near=2)["near"] == (2, "option") and settings(spark)["interval"] == (500, "default")
    finally:
        spark.conf.unset("rasterloom.near")
    with pytest.raises(ValueError):
        settings(spark, colour=1)


def test_streams_in_one_table_stay_apart(spark):
    """Every pixel form over two streams at once gives what each gives on its own."""
    _, df = images(spark)
    own = lambda s: fr.from_images(df.where((F.col("s") == s) & (F.col("frame_id") < 4)))
    both = own("a").withColumn("s", F.lit("a")).union(own("b").withColumn("s", F.lit("b")))
    by = ("s",)
    forms = [
        lambda d, by: diff.flat_frames(d, by), lambda d, by: diff.changed_frames(diff.with_previous(d, by), by), lambda d, by: diff.matched_pixels(diff.with_previous(d, by), by),
        lambda d, by: diff.changed_blocks(diff.with_previous(d, by), by=by), lambda d, by: diff.region_bounds(diff.with_previous(d, by), 50, by=by), lambda d, by: diff.block_types(diff.with_previous(d, by), by=by),
        lambda d, by: predict.colour_contexts(d, 50, by), lambda d, by: predict.choose_key(predict.neighbours(d, 50, by), 50).select(*by, "frame_id", "y", "x", "ptype"),
    ]
    for form in forms:
        got = Counter(tuple(r) for r in form(both, by).collect())
        assert got == Counter((s, *r) for s in "ab" for r in form(own(s), ()).collect())
