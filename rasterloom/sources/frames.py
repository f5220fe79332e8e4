"""Frames and packets as tables: schemas, formats, synthetic scenes, raw files in and out.

Long form: one row per pixel (frame_id, y, x, r, g, b). Order is frame_id; no
time value is implied. Tables of packets are ordinary Parquet, partitioned by
keyframe segment where they are large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = T.StructType([T.StructField("frame_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b"))])
IMAGE = T.StructType([T.StructField("frame_id", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.BinaryType())])
PACKET = T.StructType([T.StructField("frame_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("ftype", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("size", T.LongType())])

#: Width and height of the scenes that the registered queries build; neither is a multiple of the block edge.
WIDTH, HEIGHT, EVENTS_PER_FRAME = 50, 38, 250


#: Bits per pixel that can be coded.
DEPTHS = (16, 24, 32)


@dataclass(frozen=True)
class FrameFormat:
    """Fixed description of a stream: size, bits per pixel, channel masks of 16-bit pixels, search ranges, loss."""

    width: int
    height: int
    depth: int = 24
    masks: tuple[int, int, int] = (0x7C00, 0x03E0, 0x001F)
    far: int = 256
    near: int = 8
    loss: int = 0

    def can_encode(self) -> bool:
        """Uncompressed 16-, 24- or 32-bit pixels of a positive size."""
        return self.depth in DEPTHS and self.width > 0 and self.height > 0

    def can_decode(self, other: FrameFormat) -> bool:
        """Decoding needs equal width, height and depth."""
        return other.can_encode() and (self.width, self.height, self.depth) == (other.width, other.height, other.depth)

    def output_schema(self) -> T.StructType:
        """What decoding gives: packed words for 16 and 32 bits, channels for 24."""
        if self.depth == 24:
            return FRAME
        return T.StructType([*FRAME.fields[:3], T.StructField("word", T.LongType() if self.depth == 32 else T.IntegerType())])

    def stride(self) -> int:
        return (self.width * 3 + 3) // 4 * 4

    def blocks(self) -> tuple[int, int]:
        return -(-self.width // 16), -(-self.height // 16)

    def max_bytes(self) -> int:
        return self.width * self.height * 6

    def describe(self) -> dict:
        return {"name": "rasterloom", "lossless": self.loss == 0, "temporal": True, "quality": 10000, "max_bytes": self.max_bytes()}


def encodes(width: str, height: str, depth: str) -> Column:
    """:meth:`FrameFormat.can_encode` over columns."""
    return F.col(depth).isin(*DEPTHS) & (F.col(width) > 0) & (F.col(height) > 0)


def decodes(width: str, height: str, depth: str, own: FrameFormat) -> Column:
    """:meth:`FrameFormat.can_decode` of the format ``own`` over columns."""
    return encodes(width, height, depth) & (F.col(width) == own.width) & (F.col(height) == own.height) & (F.col(depth) == own.depth)


def scene_sql(dialect: str, events: str = "events") -> str:
    """SQL of a frame table built from all rows of ``events``, in integers only.

    Each 250 events give one frame. Two frames share a scene, whose seed is a
    count in the events: tiles with a moving box, a vertical scroll, a
    horizontal scroll, a flat or unchanged pair.
    """
    div = (lambda a, b: f"({a} div {b})") if dialect == "spark" else (lambda a, b: f"({a} // {b})")
    span = (lambda n: f"explode(sequence(0, {n - 1}))") if dialect == "spark" else (lambda n: f"unnest(range({n}))")
    f = div("event_id", EVENTS_PER_FRAME)
    tex = f"CASE WHEN ({div('px', 6)} + {div('py', 4)}) % 3 = 0 THEN (px * 13 + py * 29 + seed) % 256 ELSE ({div('px', 12)} * 40 + {div('py', 8)} * 24 + seed) % 256 END"
    return f"""
    WITH par AS (
      SELECT {f} AS frame_id, {div(f, 2)} % 5 AS kind, {f} % 2 AS step
      FROM {events} GROUP BY {f}, {div(f, 2)} % 5, {f} % 2
    ), seeds AS (
      SELECT {div('event_id', 2 * EVENTS_PER_FRAME)} AS scene, CAST(sum(CASE WHEN event_type = 'error' THEN 3 ELSE 1 END) % 256 AS INT) AS seed
      FROM {events} GROUP BY {div('event_id', 2 * EVENTS_PER_FRAME)}
    ), grid AS (
      SELECT frame_id, CAST(kind AS INT) AS kind, CAST(step AS INT) AS step, seed, y, {span(WIDTH)} AS x FROM (
        SELECT frame_id, kind, step, seed, {span(HEIGHT)} AS y
        FROM par JOIN seeds ON seeds.scene = {div('par.frame_id', 2)}) q
    ), place AS (
      SELECT frame_id, kind, step, seed, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
        CAST(x + CASE WHEN kind = 2 THEN 2 * step ELSE 0 END AS INT) AS px,
        CAST(y + CASE WHEN kind = 1 THEN 3 * step ELSE 0 END AS INT) AS py
      FROM grid
    ), tone AS (
      SELECT frame_id, y, x, seed, px, CAST(CASE
        WHEN kind = 3 THEN seed
        WHEN kind = 0 AND x >= 10 + 4 * step AND x < 26 + 4 * step AND y >= 8 AND y < 20 THEN 255 - seed
        WHEN kind = 4 AND step = 1 AND x = 30 AND y < 20 THEN 255 - seed
        ELSE {tex} END AS INT) AS t FROM place
    )
    SELECT CAST(frame_id AS BIGINT) AS frame_id, y, x, t AS r, CAST((t * 3 + seed) % 256 AS INT) AS g, CAST((t + seed) % 256 AS INT) AS b FROM tone
    """


def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes over the whole events table. Only event_id and event_type are read."""
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type").createOrReplaceTempView("_scene_events")
    return spark.sql(scene_sql("spark", "_scene_events"))


def to_images(frames: DataFrame) -> DataFrame:
    """Long form to one row per frame: pixels as r, g, b bytes in raster order.

    Frames meet by frame_id, each is one row by nature. Frames must be complete
    rectangles; others raise.
    """

    def build(key: tuple, t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        h, w = int(y.max()) + 1, int(x.max()) + 1
        if len(y) != h * w:
            raise ValueError(f"frame {key[0].as_py()} is not a full rectangle")
        a = np.zeros((h, w, 3), dtype=np.uint8)
        for k, c in enumerate("rgb"):
            a[y, x, k] = t.column(c).to_numpy()
        return pa.table({"frame_id": [key[0].as_py()], "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "pixels": [a.tobytes()]})

    return frames.select("frame_id", "y", "x", "r", "g", "b").groupBy("frame_id").applyInArrow(build, IMAGE)


def from_images(images: DataFrame) -> DataFrame:
    """One row per frame to the long form."""
    schema = T._parse_datatype_string("frame_id long, y int, x int, r int, g int, b int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, w, p in zip(*(b.column(c).to_pylist() for c in ("frame_id", "height", "width", "pixels")), strict=True):
                a = np.frombuffer(p, dtype=np.uint8).reshape(h * w, 3).astype(np.int32)
                n = np.arange(h * w, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, i, dtype=np.int64)), pa.array(n // w), pa.array(n % w), *(pa.array(a[:, k]) for k in range(3))], names=["frame_id", "y", "x", "r", "g", "b"])

    return images.mapInArrow(spread, schema)


def read_raw(spark: SparkSession, path: str, fmt: FrameFormat) -> DataFrame:
    """Raw frame dumps (one file a frame, rows padded to four bytes) as images; files sort by name.

    Files of another size than the format gives raise. 32-bit pixels lose their
    fourth byte, 16-bit ones are parted by the masks.
    """
    if not fmt.can_encode():
        raise ValueError(f"unsupported format {fmt}")
    size = fmt.depth // 8
    stride = (fmt.width * size + 3) // 4 * 4
    shifts = [(m & -m).bit_length() - 1 for m in fmt.masks]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(content) != stride * fmt.height:
                    raise ValueError(f"{name}: {len(content)} bytes, expected {stride * fmt.height}")
                a = np.frombuffer(content, dtype=np.uint8).reshape(fmt.height, stride)[:, : fmt.width * size].reshape(fmt.height, fmt.width, size)
                if size == 2:
                    w = a[..., 0].astype(np.int32) | a[..., 1].astype(np.int32) << 8
                    a = np.stack([(w & m) >> s for m, s in zip(fmt.masks, shifts, strict=True)], axis=-1).astype(np.uint8)
                out.append(a[..., :3].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "pixels"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, pixels binary")
    stem = F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("long")
    return files.select(stem.alias("frame_id"), F.lit(fmt.height).alias("height"), F.lit(fmt.width).alias("width"), "pixels")


def write_packets(packets: DataFrame, path: str) -> None:
    """Packets by keyframe segment, so that a reader takes whole segments."""
    packets.repartition("segment").sortWithinPartitions("segment", "frame_id").write.mode("overwrite").partitionBy("ftype").parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET).parquet(path)
