"""Frame differencing: previous-frame match, changed pixels, blocks, regions. DataFrame operations on pixels, arrays on whole images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.pixel import BLOCK_EDGE

CHANNELS = ("r", "g", "b")


def with_previous(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds pr, pg, pb: the same place in the frame before (null in the first). One shuffle, by place.

    ``by`` names the columns that tell streams apart, here and below; each
    stream has its own frame numbers.
    """
    w = Window.partitionBy(*by, "y", "x").orderBy("frame_id")
    return frames.select("*", *(F.lag(c).over(w).alias(f"p{c}") for c in CHANNELS))


def changed() -> Column:
    """True where any channel differs from the frame before; null in the first frame."""
    return (F.col("r") != F.col("pr")) | (F.col("g") != F.col("pg")) | (F.col("b") != F.col("pb"))


def flat_frames(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, flat): all pixels equal. Minimum and maximum combine before the shuffle; no distinct count."""
    same = F.lit(True)
    for c in CHANNELS:
        same = same & (F.min(c) == F.max(c))
    return frames.groupBy(*by, "frame_id").agg(same.alias("flat"))


def changed_frames(paired: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, changed) for frames that have one before."""
    return paired.where("pr IS NOT NULL").groupBy(*by, "frame_id").agg(F.bool_or(changed()).alias("changed"))


def matched_pixels(paired: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, matched, total): pixels equal to those of the frame before at the same place."""
    return paired.where("pr IS NOT NULL").groupBy(*by, "frame_id").agg(F.sum(F.when(changed(), 0).otherwise(1)).cast("long").alias("matched"), F.count("*").alias("total"))


def changed_blocks(paired: DataFrame, edge: int = BLOCK_EDGE, by: tuple[str, ...] = ()) -> DataFrame:
    """Changed blocks with their least rectangle (half-open) and code: 1 whole block, 2 part of it.

    Unchanged blocks (code 0) are not listed. The code compares the rectangle
    with the block as clipped by the frame's edge.
    """
    row, bx = F.floor(F.col("y") / edge).cast("int"), F.floor(F.col("x") / edge).cast("int")
    p = paired.where("pr IS NOT NULL").select(*by, "frame_id", row.alias("brow"), bx.alias("bx"), "x", "y", changed().alias("c"))
    hit = lambda v: F.when(F.col("c"), F.col(v))
    blocks = p.groupBy(*by, "frame_id", "brow", "bx").agg(
        F.min(hit("x")).alias("x1"), F.min(hit("y")).alias("y1"), (F.max(hit("x")) + 1).alias("x2"), (F.max(hit("y")) + 1).alias("y2"),
        F.min("x").alias("bx1"), F.min("y").alias("by1"), (F.max("x") + 1).alias("bx2"), (F.max("y") + 1).alias("by2"),
    )
    whole = (F.col("x1") == F.col("bx1")) & (F.col("y1") == F.col("by1")) & (F.col("x2") == F.col("bx2")) & (F.col("y2") == F.col("by2"))
    return blocks.where("x1 IS NOT NULL").select(*by, "frame_id", "brow", "bx", F.when(whole, 1).otherwise(2).alias("bt"), "x1", "y1", "x2", "y2")


def region_bounds(paired: DataFrame, width: int, edge: int = BLOCK_EDGE, by: tuple[str, ...] = ()) -> DataFrame:
    """Per frame the bounds of its changed blocks and their first and last raster index; nulls where unchanged."""
    nbx = -(-width // edge)
    hit = lambda v: F.when(F.col("c"), F.col(v))
    p = paired.where("pr IS NOT NULL").select(*by, "frame_id", F.floor(F.col("y") / edge).cast("int").alias("brow"), F.floor(F.col("x") / edge).cast("int").alias("bx"), changed().alias("c"))
    out = p.groupBy(*by, "frame_id").agg(F.min(hit("bx")).alias("bx1"), F.min(hit("brow")).alias("by1"), F.max(hit("bx")).alias("bx2"), F.max(hit("brow")).alias("by2"))
    return out.select("*", (F.col("by1") * nbx + F.col("bx1")).alias("first_index"), (F.col("by2") * nbx + F.col("bx2")).alias("last_index"))


def block_types(paired: DataFrame, edge: int = BLOCK_EDGE, by: tuple[str, ...] = ()) -> DataFrame:
    """Every block with code 0, 1 or 2, and its raster place."""
    every = paired.where("pr IS NOT NULL").groupBy(*by, "frame_id", F.floor(F.col("y") / edge).cast("int").alias("brow"), F.floor(F.col("x") / edge).cast("int").alias("bx")).agg(F.count("*").alias("pixels"))
    some = changed_blocks(paired, edge, by).select(*by, "frame_id", "brow", "bx", "bt")
    return every.join(some, [*by, "frame_id", "brow", "bx"], "left").select(*by, "frame_id", "brow", "bx", F.coalesce("bt", F.lit(0)).alias("bt"), "pixels")


def changed_blocks_of_images(images: DataFrame, stream: str, edge: int = BLOCK_EDGE) -> DataFrame:
    """:func:`changed_blocks` from images (``stream``, frame_id, height, width, pixels), any number of streams in a table.

    Each image meets the one before it in its stream by one join on (stream,
    number); whole images travel, and blocks are compared as arrays. Frame
    numbers of a stream are dense. Images of another size than the one before
    have no blocks.
    """
    kind = dict(images.dtypes)[stream]
    cur = images.select(stream, "frame_id", "height", "width", "pixels")
    prev = images.select(stream, (F.col("frame_id") + 1).alias("frame_id"), "height", "width", F.col("pixels").alias("before"))
    ints = ("brow", "bx", "bt", "x1", "y1", "x2", "y2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for n, (h, w, p, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("height", "width", "pixels", "before")), strict=True)):
                new = block_rows(np.frombuffer(p, dtype=np.uint8).reshape(h, w, 3), np.frombuffer(q, dtype=np.uint8).reshape(h, w, 3), edge)
                at += [n] * len(new)
                rows += new
            t = b.take(pa.array(at, pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(ints)
            yield pa.RecordBatch.from_arrays([t.column(stream), t.column("frame_id"), *(pa.array(c, pa.int32()) for c in columns)], names=[stream, "frame_id", *ints])

    pairs = cur.join(prev, [stream, "frame_id", "height", "width"])
    return pairs.mapInArrow(compare, f"{stream} {kind}, frame_id long, " + ", ".join(f"{c} int" for c in ints))


def block_rows(now: np.ndarray, before: np.ndarray, edge: int = BLOCK_EDGE) -> list[tuple[int, ...]]:
    """(brow, bx, code, x1, y1, x2, y2) of each changed block of two (h, w, 3) images, in raster order."""
    h, w, _ = now.shape
    d = np.zeros((-(-h // edge) * edge, -(-w // edge) * edge), dtype=bool)
    d[:h, :w] = (now != before).any(axis=2)
    tiles = d.reshape(d.shape[0] // edge, edge, d.shape[1] // edge, edge)
    rows, columns = tiles.any(axis=3), tiles.any(axis=1)  # (block row, y, block), (block row, block, x)
    out = []
    for i, j in np.argwhere(columns.any(axis=2)):
        ys, xs = np.flatnonzero(rows[i, :, j]), np.flatnonzero(columns[i, j])
        x1, y1, x2, y2 = j * edge + xs[0], i * edge + ys[0], j * edge + xs[-1] + 1, i * edge + ys[-1] + 1
        whole = (x2 - x1, y2 - y1) == (min(edge, w - j * edge), min(edge, h - i * edge))
        out.append(tuple(int(v) for v in (i, j, 1 if whole else 2, x1, y1, x2, y2)))
    return out
