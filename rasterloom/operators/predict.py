"""Neighbour predictors: which one to choose for a pixel, which ones fit, and the colour contexts.

Predictor types (fixed values): 0 literal, 1 left, 2 up, 3 previous frame,
4 gradient (left + up - up-left, not wrapped), 5 up-left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.diff import CHANNELS

LITERAL, LEFT, UP, PREVIOUS, GRADIENT, UP_LEFT = range(6)
KEY_ORDER, DELTA_ORDER = (LEFT, UP_LEFT, UP, GRADIENT), (LEFT, PREVIOUS, UP_LEFT, UP, GRADIENT)


def neighbours(frames: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds structs l, u, ul: left in scan order, up, and up-left (null outside the frame or at x = 0 for up-left). ``by`` tells streams apart."""
    scan = Window.partitionBy(*by, "frame_id").orderBy("pos")
    rgb = F.struct(*CHANNELS)
    d = frames.withColumn("pos", (F.col("y") * width + F.col("x")).cast("long"))
    d = d.withColumn("l", F.lag(rgb, 1).over(scan)).withColumn("u", F.lag(rgb, width).over(scan)).withColumn("ul", F.lag(rgb, width + 1).over(scan))
    return d.withColumn("ul", F.when(F.col("x") > 0, F.col("ul")))


def _equal(name: str) -> Column:
    out = F.col(name).isNotNull()
    for c in CHANNELS:
        out = out & (F.col(c) == F.col(f"{name}.{c}"))
    return F.coalesce(out, F.lit(False))


def _gradient() -> Column:
    out = F.col("ul").isNotNull() & F.col("l").isNotNull() & F.col("u").isNotNull()
    for c in CHANNELS:
        out = out & (F.col(c) == F.col(f"l.{c}") + F.col(f"u.{c}") - F.col(f"ul.{c}"))
    return F.coalesce(out, F.lit(False))


def _fits(kind: int) -> Column:
    if kind == GRADIENT:
        return _gradient()
    if kind == PREVIOUS:
        return F.coalesce((F.col("r") == F.col("pr")) & (F.col("g") == F.col("pg")) & (F.col("b") == F.col("pb")), F.lit(False))
    return _equal({LEFT: "l", UP: "u", UP_LEFT: "ul"}[kind])


def choose_key(near: DataFrame, width: int) -> DataFrame:
    """Adds ptype for keyframes: the first predictor that fits; null for the first row and one pixel, which have none."""
    out = F.lit(LITERAL)
    for kind in reversed(KEY_ORDER):
        out = F.when(_fits(kind), kind).otherwise(out)
    return near.withColumn("ptype", F.when(F.col("pos") > width, out))


def choose_delta(near: DataFrame) -> DataFrame:
    """Adds ptype for delta frames (rows with pr, pg, pb); at x = 0 or y = 0 only previous or literal."""
    out = F.lit(LITERAL)
    for kind in reversed(DELTA_ORDER):
        out = F.when(_fits(kind), kind).otherwise(out)
    edge = F.when(_fits(PREVIOUS), PREVIOUS).otherwise(LITERAL)
    return near.withColumn("ptype", F.when((F.col("x") == 0) | (F.col("y") == 0), edge).otherwise(out))


def fit_mask(near: DataFrame, delta: bool) -> DataFrame:
    """Adds fits: bit k is set where predictor k fits. Bit 0: the pixel equals the one before in scan order."""
    kinds = DELTA_ORDER if delta else KEY_ORDER
    bit = lambda k: F.when(_fits(k), 1 << k).otherwise(0)
    inner = sum((bit(k) for k in kinds), F.lit(0)) + F.when(_equal("l"), 1).otherwise(0)
    if not delta:
        return near.withColumn("fits", inner)
    edge = bit(PREVIOUS) + F.when(_equal("l"), 1).otherwise(0)
    return near.withColumn("fits", F.when((F.col("x") == 0) | (F.col("y") == 0), edge).otherwise(inner))


def colour_contexts(frames: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, seq, channel, ctx, sym): each channel value with the context of the two values before it.

    A context is ``(older >> 2 << 6) + (newer >> 2)``, 0..4095 per channel; both
    start at 0 in every frame.
    """
    d = frames.select(*by, "frame_id", (F.col("y") * width + F.col("x")).cast("long").alias("pos"), F.posexplode(F.array(*CHANNELS)).alias("channel", "sym"))
    d = d.withColumn("seq", F.col("pos") * 3 + F.col("channel"))
    w = Window.partitionBy(*by, "frame_id").orderBy("seq")
    newer, older = F.coalesce(F.lag("sym", 1).over(w), F.lit(0)), F.coalesce(F.lag("sym", 2).over(w), F.lit(0))
    ctx = F.shiftleft(F.shiftright(older, 2), 6) + F.shiftright(newer, 2)
    return d.select(*by, "frame_id", "seq", "channel", ctx.alias("ctx"), "sym")


def fits_of_image(a: np.ndarray, prev: np.ndarray | None) -> dict[int, np.ndarray]:
    """Where each predictor fits, over a whole (h, w, 3) image; with ``prev``, as in delta frames."""
    h, w, _ = a.shape
    flat = a.reshape(-1, 3).astype(np.int32)
    n, none = h * w, np.full((h * w, 3), -9999)

    def back(k: int) -> np.ndarray:
        out = none.copy()
        if n > k:
            out[k:] = flat[:-k]
        return out

    x, y = np.arange(n) % w, np.arange(n) // w
    left, up, corner = back(1), back(w), back(w + 1)
    corner[x == 0] = -9999
    same = lambda b: (flat == b).all(axis=1)
    out = {LEFT: same(left), UP: same(up), UP_LEFT: same(corner), GRADIENT: same(left + up - corner) & (x > 0) & (y > 0)}
    if prev is not None:
        edge = (x == 0) | (y == 0)
        out = {k: v & ~edge for k, v in out.items()} | {PREVIOUS: same(prev.reshape(-1, 3).astype(np.int32))}
    return {k: v.reshape(h, w) for k, v in out.items()}


def choose_of_images(images: DataFrame, stream: str, delta: bool) -> DataFrame:
    """(``stream``, frame_id, y, x, ptype) from images (``stream``, frame_id, height, width, pixels), any number of streams.

    The same choice as :func:`choose_key` (null for the first row and one pixel)
    or, with ``delta``, :func:`choose_delta` of frames that have one before of
    their size. Images meet the one before by a join of whole images; pixels are
    compared as arrays and never shuffled or sorted.
    """
    kind = dict(images.dtypes)[stream]
    d = images.select(stream, "frame_id", "height", "width", "pixels")
    if delta:
        d = d.join(images.select(stream, (F.col("frame_id") + 1).alias("frame_id"), "height", "width", F.col("pixels").alias("before")), [stream, "frame_id", "height", "width"])
    order = DELTA_ORDER if delta else KEY_ORDER

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (h, w, p) in enumerate(zip(*(b.column(c).to_pylist() for c in ("height", "width", "pixels")), strict=True)):
                image = lambda q: np.frombuffer(q, dtype=np.uint8).reshape(h, w, 3)  # noqa: B023, E731
                fits = fits_of_image(image(p), image(b.column("before")[n].as_py()) if delta else None)
                out = np.select([fits[k].ravel() for k in order], order, LITERAL).astype(np.int32)
                at = np.arange(h * w, dtype=np.int32)
                t = b.select([stream, "frame_id"]).take(pa.array(np.full(h * w, n)))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(at // w), pa.array(at % w), pa.array(out, mask=None if delta else at <= w)], names=[stream, "frame_id", "y", "x", "ptype"])

    return d.mapInArrow(choose, f"{stream} {kind}, frame_id long, y int, x int, ptype int")
