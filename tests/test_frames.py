"""Frame operators: round trips, agreement of forms, hand-made cases."""

import numpy as np
import pytest

from rasterloom.functions import pixel
from rasterloom.operators import codec, diff, entropy, model, motion, predict, runs, sequence
from rasterloom.plans import catalog
from rasterloom.sources import frames as fr


def scenes(name, n=6):
    r = np.random.default_rng(len(name))
    h, w = {"row": (1, 37), "column": (41, 1), "odd": (19, 23)}.get(name, (35, 50))
    base = (np.add.outer(np.arange(h) * 7, np.arange(w) // 5 * 40) % 256)[..., None] + np.array([0, 3, 9])
    out = []
    for k in range(n):
        a = base.copy()
        if name == "flat":
            a[:] = [k // 2 * 40, 1, 2]
        elif name == "same":
            pass
        elif name == "noise":
            a = r.integers(0, 256, (h, w, 3))
        elif name == "scroll":
            a = np.roll(base + r.integers(0, 2, 1) * 0, -3 * k, axis=0)
        elif name == "side":
            a = np.roll((np.add.outer(np.arange(h) * 11, np.arange(w) ** 2) % 251)[..., None] + np.array([0, 1, 2]), 2 * k, axis=1)
        else:
            a[min(3 + k, h - 1) : 9 + k, min(2 * k, w - 1) : 2 * k + 7] = [255 - k, k, 77]
        out.append((a % 256).astype(np.uint8))
    return out


@pytest.mark.parametrize("name", ["flat", "same", "noise", "scroll", "side", "box", "row", "column", "odd"])
def test_codec_round_trip(name):
    images = scenes(name)
    h, w, _ = images[0].shape
    enc, dec = codec.SegmentCodec(h, w), codec.SegmentCodec(h, w)
    for k, a in enumerate(images):
        packet = enc.encode(a.reshape(-1), k % 4 == 0)
        assert (dec.decode(packet) == a).all(), (name, k)
        if name == "same" and k % 4:
            assert packet == b"\0"
        if name == "flat":
            assert len(packet) == 4


def test_delta_before_any_key_is_left_out():
    a, b = scenes("box", 2)
    enc = codec.SegmentCodec(*a.shape[:2])
    enc.encode(a.reshape(-1), True)
    assert codec.SegmentCodec(*a.shape[:2]).decode(enc.encode(b.reshape(-1), False)) is None
    with pytest.raises(ValueError):
        codec.SegmentCodec(2, 2).decode(b"\x77")


def test_models_stay_valid_through_all_kinds():
    r = np.random.default_rng(1)
    kinds = set()
    for spread in (2, 4, 12, 30, 60, 256):
        for skew in (1, 4):
            m = model.Singles()
            for s in (r.random(3000) ** skew * spread).astype(int).tolist():
                t = m.table
                if t is not None:
                    assert (np.diff(t) >= 1).all() and t[0] == 0 and t[-1] <= model.SCALE
                m = m.tell(s)
                kinds.add(m.kind)
    m = model.Singles()
    for s in [*range(256), 5, 5, 7]:
        m = m.tell(s)
        kinds.add(m.kind)
    assert kinds == {1, 2, 3, 4, 5, 6, 7}


def test_model_rules_by_hand():
    m = model.Singles().tell(10).tell(20).tell(20)  # two symbols, the second twice
    assert m.kind == 4 and m.count == {10: 50, 20: 100}
    w = np.diff(m.table)
    total, shift = 150 + 254, 3
    assert model.doubling(total) == shift and w[0] == 1 << shift and w[10] == 50 << shift
    assert w[20] == (100 + ((4096 - (total << shift)) >> shift)) << shift
    assert model.Large.even(5).table.tolist() == [k * 819 for k in range(6)]


def test_rans_and_range_coder():
    r = np.random.default_rng(2)
    syms = (r.random(5000) ** 3 * 200).astype(int).tolist()
    enc, dec = model.Models({}), model.Models({})
    iv = [enc.interval("c0", s % 3, s) for s in syms]
    data = entropy.encode_blocks(iv, 700)
    reader = entropy.SymbolReader(data, dec, 700)
    assert [reader.symbol("c0", s % 3) for s in syms] == syms and len(data) < 4500
    assert entropy.range_decode(entropy.range_encode(syms, 256, 400), len(syms), 256, 400) == syms


def test_greedy_rule():
    # 1 and 3 fit both at first; 3 goes on alone: the run stays with 1 until it misses.
    fits = np.array([0b1010, 0b1010, 0b1000, 0b1000, 0, 0b1, 0b10])
    assert runs.greedy_fold(fits, True) == ([1, 3, 0, 1], [2, 2, 2, 1])
    assert runs.greedy_fold(np.full(600, 2), False) == ([1, 1, 1], [255, 255, 90])


def test_greedy_forms_agree(spark, sf):
    a = catalog.QUERIES["a72_greedy_runs_delta"](spark, sf).select("frame_id", "brow", "bx", "seq", "ptype", "n")
    b = catalog.QUERIES["a72_greedy_runs_native"](spark, sf)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_priorities():
    p = motion.priorities()
    assert len(p) == 1247 and (0, 0) not in p and p[:4] == ((0, -1), (0, 1), (0, -2), (0, 2))
    r = np.random.default_rng(3)
    prev = r.integers(0, 3, (40, 60))
    for _ in range(30):
        x, y = int(r.integers(0, 50)), int(r.integers(0, 30))
        cur = r.integers(0, 3, (40, 60))
        dx, dy = [(0, -4), (5, 0), (-3, 2), (0, 7), (2, -6)][int(r.integers(0, 5))]
        if not (0 <= x + dx <= 57 and 0 <= y + dy <= 37):
            continue
        cur[y : y + 3, x : x + 3] = prev[y + dy : y + dy + 3, x + dx : x + dx + 3]
        want = next(((a, b) for a, b in p if 0 <= x + a <= 57 and 0 <= y + b <= 37 and (prev[y + b : y + b + 3, x + a : x + a + 3] == cur[y : y + 3, x : x + 3]).all()), None)
        assert motion.find_vector(prev, cur, (x, y, x + 3, y + 3)) == want


def test_global_runs_cross_blocks(spark):
    values = [1] * 700 + [2] + [1] * 5 + [3] * 64 + [None] * 3 + [4] * 300
    df = spark.createDataFrame(list(enumerate(values)), "o long, v int")
    from pyspark.sql import functions as F

    for width in (8, 16, 64, 4096):
        got = sorted((r["start"], r["value"], r["n"]) for r in runs.global_runs(df, "o", F.col("v"), width=width).collect())
        want, at = [], 0
        while at < len(values):
            n = 1
            while at + n < len(values) and values[at + n] == values[at] and n < 255:
                n += 1
            want.append((at, values[at], n))
            at += n
        assert got == want, width


def test_keyframes_by_hand(spark):
    from pyspark.sql import functions as F

    flats = [1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(flats)), "o long, f int")
    for width in (2, 5, 4096):
        out = sequence.running(df, "o", F.col("f"), "sum", "s", width).orderBy("o")
        assert [r["s"] for r in out.collect()] == np.cumsum(flats).tolist()
    got = sequence.keyframes(df, "o", F.col("f") == 1, 3).orderBy("o").collect()
    assert [int(r["is_key"]) for r in got] == [1, 1, 1, 0, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1, 0]
    assert [r["segment"] for r in got] == np.cumsum([r["is_key"] for r in got]).tolist()


def test_raw_files_and_packets(spark, tmp_path):
    a = scenes("odd", 1)[0]
    h, w, _ = a.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), dtype=np.uint8)
    rows[:, : w * 3] = a.reshape(h, -1)
    (tmp_path / "frame_7.raw").write_bytes(rows.tobytes())
    img = fr.read_raw(spark, str(tmp_path), fr.FrameFormat(w, h))
    row = img.first()
    assert row["frame_id"] == 7 and bytes(row["pixels"]) == a.tobytes()
    assert fr.FrameFormat(w, h).can_decode(fr.FrameFormat(w, h)) and not fr.FrameFormat(w, h, 8).can_encode()
    segments = spark.createDataFrame([(7, 1, True)], "frame_id long, segment long, is_key boolean")
    fr.write_packets(codec.encode(img, segments), str(tmp_path / "packets"))
    back = codec.decode(fr.read_packets(spark, str(tmp_path / "packets")), h, w).first()
    assert bytes(back["pixels"]) == a.tobytes()


def test_scalars():
    assert pixel.mask_shift(0x7C00) == 10 and pixel.mask_shift(0x1F) == 0


def test_predictors_keep_to_the_frame(spark):
    f = spark.createDataFrame([(0, y, x, y * 3 + x, 0, 0) for y in range(3) for x in range(4)], "frame_id long, y int, x int, r int, g int, b int")
    got = {(r["y"], r["x"]): r["ptype"] for r in predict.choose_key(predict.neighbours(f, 4), 4).collect()}
    assert got[0, 3] is None and got[1, 0] is None and got[1, 1] == predict.GRADIENT and got[2, 0] == predict.LEFT  # left goes on across rows
    assert diff.flat_frames(f).first()["flat"] is False
