"""A Python data source of test frames: ``spark.read.format("testframes")`` after ``spark.dataSource.register(TestFrames)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rasterloom.sources.frames import FRAME


class FrameRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class TestFrames(DataSource):
    """Frames whose channels are sums of place and number, in the long form.

    Options: frames (10), width (50), height (38), partitions (as many as
    frames, 8 at most). A frame is made where it is read.
    """

    __test__ = False  # not a test class

    @classmethod
    def name(cls) -> str:
        return "testframes"

    def schema(self) -> StructType:
        return FRAME

    def reader(self, schema: StructType) -> TestFrameReader:
        number = lambda key, default: int(self.options.get(key, default))
        frames = number("frames", 10)
        return TestFrameReader(frames, number("width", 50), number("height", 38), number("partitions", max(1, min(8, frames))))


class TestFrameReader(DataSourceReader):
    __test__ = False

    def __init__(self, frames: int, width: int, height: int, partitions: int):
        self.frames, self.width, self.height, self.n = frames, width, height, partitions

    def partitions(self) -> list[FrameRange]:
        cuts = [self.frames * k // self.n for k in range(self.n + 1)]
        return [FrameRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        y, x = np.divmod(np.arange(self.width * self.height, dtype=np.int32), np.int32(self.width))
        for f in range(partition.start, partition.stop):
            channels = ((7 * x + 3 * y + 5 * f) % 256, (x + 11 * y + f) % 256, (x * y + 2 * f) % 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, dtype=np.int64)), pa.array(y), pa.array(x), *(pa.array(c.astype(np.int32)) for c in channels)], names=["frame_id", "y", "x", "r", "g", "b"])
