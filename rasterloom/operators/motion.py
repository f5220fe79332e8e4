"""Motion matching: the first displacement, in a fixed order, at which the frame before equals a changed rectangle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def priorities(far: int = 256, near: int = 8) -> tuple[tuple[int, int], ...]:
    """All displacements (dx, dy) in their order, each once.

    Vertical by growing distance, up before down; then left, then right; then
    the near window, columns from 0 leftwards and then rightwards, each up from
    0 and then down. Upper ends of ranges are exclusive.
    """
    order: dict[tuple[int, int], None] = {}
    for k in range(1, far + 1):
        order[0, -k] = None
        if k < far:
            order[0, k] = None
    order |= {(-k, 0): None for k in range(1, far + 1)} | {(k, 0): None for k in range(1, far)}
    for dx in [*range(0, -near - 1, -1), *range(1, near)]:
        order |= {(dx, dy): None for dy in [*range(0, -near - 1, -1), *range(1, near)]}
    order.pop((0, 0), None)
    return tuple(order)


def find_vector(prev: np.ndarray, cur: np.ndarray, rect: tuple[int, int, int, int], far: int = 256, near: int = 8, hints: tuple = ()) -> tuple[int, int] | None:
    """First displacement at which ``prev`` holds the rectangle (x1, y1, x2, y2) of ``cur``: of ``hints``, then of :func:`priorities`.

    Frames are (h, w) arrays of packed pixels. A corner test leaves few places
    to compare in full.
    """
    x1, y1, x2, y2 = rect
    h, w = prev.shape
    block = cur[y1:y2, x1:x2]
    for v in hints:
        if v is not None and x1 + v[0] >= 0 and y1 + v[1] >= 0 and x2 + v[0] <= w and y2 + v[1] <= h and (prev[y1 + v[1] : y2 + v[1], x1 + v[0] : x2 + v[0]] == block).all():
            return v
    d = _table(far, near)
    xs, ys = d[:, 0] + x1, d[:, 1] + y1
    ok = (xs >= 0) & (ys >= 0) & (xs + (x2 - x1) <= w) & (ys + (y2 - y1) <= h)
    for oy, ox in ((0, 0), (y2 - y1 - 1, x2 - x1 - 1), (0, x2 - x1 - 1), (y2 - y1 - 1, 0)):
        at = np.flatnonzero(ok)
        ok[at] = prev[ys[at] + oy, xs[at] + ox] == block[oy, ox]
    for k in np.flatnonzero(ok):
        if (prev[ys[k] : ys[k] + y2 - y1, xs[k] : xs[k] + x2 - x1] == block).all():
            return int(d[k, 0]), int(d[k, 1])
    return None


@lru_cache(maxsize=8)
def _table(far: int, near: int) -> np.ndarray:
    return np.array(priorities(far, near), dtype=np.int64)


def packed(pixels: bytes, height: int, width: int) -> np.ndarray:
    a = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3).astype(np.int32)
    return a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]


def frame_vectors(prev: np.ndarray, cur: np.ndarray, rects: list[tuple[int, int, tuple[int, int, int, int]]], far: int = 256, near: int = 8, reuse: bool = False) -> list[tuple[int, int] | None]:
    """Vectors of (brow, bx, rectangle) in raster order. With ``reuse``, the last vector found and that of the block above are tried first."""
    last, at, out = None, {}, []
    for brow, bx, rect in rects:
        v = find_vector(prev, cur, rect, far, near, (last, at.get((brow - 1, bx))) if reuse else ())
        if v is not None:
            last = at[brow, bx] = v
        out.append(v)
    return out


def motion_vectors(images: DataFrame, blocks: DataFrame, far: int = 256, near: int = 8, reuse: bool = False) -> DataFrame:
    """Changed blocks with their vector (dx, dy), null where nothing matches.

    Each frame meets the frame before it (one equi-join of whole frames on
    their number) and its rectangles; frames are searched independently.
    """
    cur = images.select("frame_id", "height", "width", "pixels")
    prev = images.select((F.col("frame_id") + 1).alias("frame_id"), F.col("pixels").alias("before"))
    rects = blocks.groupBy("frame_id").agg(F.collect_list(F.struct("brow", "bx", "bt", "x1", "y1", "x2", "y2")).alias("rects"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                old, new = (packed(x[k], x["height"], x["width"]) for k in ("before", "pixels"))
                rects = sorted(x["rects"], key=lambda r: (r["brow"], r["bx"]))
                found = frame_vectors(old, new, [(r["brow"], r["bx"], (r["x1"], r["y1"], r["x2"], r["y2"])) for r in rects], far, near, reuse)
                for r, v in zip(rects, found, strict=True):
                    rows.append({"frame_id": x["frame_id"], **r, "dx": v and v[0], "dy": v and v[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=_MOVED)

    pairs = cur.join(prev, "frame_id").join(rects, "frame_id")
    return pairs.mapInArrow(search, "frame_id long, brow int, bx int, bt int, x1 int, y1 int, x2 int, y2 int, dx int, dy int")


_MOVED = pa.schema([("frame_id", pa.int64()), *((c, pa.int32()) for c in ("brow", "bx", "bt", "x1", "y1", "x2", "y2", "dx", "dy"))])


def with_motion_codes(moved: DataFrame) -> DataFrame:
    """Block codes 1 and 2 become 3 and 4 where a vector was found."""
    return moved.withColumn("bt", F.col("bt") + F.when(F.col("dx").isNotNull(), 2).otherwise(0))


def repeated_vectors(moved: DataFrame) -> DataFrame:
    """Adds same: the vector equals that of the matched block before in raster order (per frame)."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame_id").orderBy("brow", "bx")
    m = moved.where("dx IS NOT NULL")
    return m.withColumn("same", F.coalesce((F.lag("dx").over(w) == F.col("dx")) & (F.lag("dy").over(w) == F.col("dy")), F.lit(False)))
