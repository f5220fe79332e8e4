"""Entropy coding: an rANS coder over 12-bit intervals, and a range coder over adaptive counts.

Both work on Python integers of unbounded size masked to their state, in
grouped Arrow functions: the JVM's signed arithmetic has no part in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.grouped import by_key
from rasterloom.operators.model import SCALE, Models

SCALE_BITS = 12
#: Lower end of the rANS state, intervals of one block.
STATE_LOW, BLOCK = 1 << 23, 131_072


def rans_encode(intervals: list[tuple[int, int]]) -> bytes:
    """One block of (start, frequency) intervals; frequency 0 passes ``start`` as a raw byte.

    Symbols go in backwards and bytes come out backwards, so that decoding runs
    forwards; raw bytes take their place between.
    """
    x, out = STATE_LOW, bytearray()
    for start, freq in reversed(intervals):
        if not freq:
            out.append(start)
            continue
        top = (STATE_LOW >> SCALE_BITS << 8) * freq
        while x >= top:
            out.append(x & 255)
            x >>= 8
        x = (x // freq << SCALE_BITS) + x % freq + start
    out += x.to_bytes(4, "big")
    return bytes(reversed(out))


class RansReader:
    """Decodes one block: :meth:`peek` gives the point in 0..4095, :meth:`take` moves on, :meth:`raw` reads a byte."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at + 4
        self.x = int.from_bytes(data[at : at + 4], "little")

    def peek(self) -> int:
        return self.x & (SCALE - 1)

    def take(self, start: int, freq: int) -> None:
        x = freq * (self.x >> SCALE_BITS) + (self.x & (SCALE - 1)) - start
        while x < STATE_LOW:
            x = x << 8 | self.data[self.at]
            self.at += 1
        self.x = x

    def raw(self) -> int:
        self.at += 1
        return self.data[self.at - 1]


def encode_blocks(intervals: list[tuple[int, int]], block: int = BLOCK, encode: Callable = rans_encode) -> bytes:
    """Blocks of at most ``block`` intervals, each led by its length in four bytes."""
    out = bytearray()
    for at in range(0, len(intervals), block):
        part = encode(intervals[at : at + block])
        out += len(part).to_bytes(4, "little") + part
    return bytes(out)


class SymbolReader:
    """Reads the symbols of :func:`encode_blocks` with the same models that wrote them; ``reader`` is the coder's."""

    def __init__(self, data: bytes, models: Models, block: int = BLOCK, reader: type = RansReader):
        self.data, self.models, self.block, self.make = data, models, block, reader
        self.next, self.left, self.reader = 0, 0, None

    def _ready(self) -> None:
        if not self.left:
            n = int.from_bytes(self.data[self.next : self.next + 4], "little")
            self.reader = self.make(self.data[self.next + 4 : self.next + 4 + n])
            self.next, self.left = self.next + 4 + n, self.block
        self.left -= 1

    def symbol(self, channel: str, ctx: int = 0) -> int:
        self._ready()
        table = self.models.of(channel, ctx).table
        if table is None:
            sym = self.reader.raw()
        else:
            sym = int(table.searchsorted(self.reader.peek(), side="right")) - 1
            self.reader.take(int(table[sym]), int(table[sym + 1] - table[sym]))
        self.models.tell(channel, ctx, sym)
        return sym

    def flag(self) -> int:
        """An even chance, without a model."""
        self._ready()
        half = SCALE // 2
        bit = int(self.reader.peek() >= half)
        self.reader.take(bit * half, half)
        return bit


class RangeEncoder:
    """Byte-wise range coder with carries, for counts with any total to 65536."""

    LEAST = 1 << 24

    def __init__(self):
        self.low, self.range, self.out = 0, 0xFFFFFFFF, bytearray()

    def put(self, start: int, freq: int, total: int) -> None:
        self.range //= total
        self.low += start * self.range
        self.range *= freq
        if self.low >> 32:  # a carry into bytes that are out already
            self.low &= 0xFFFFFFFF
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        while self.range < self.LEAST:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & 0xFFFFFFFF
            self.range <<= 8

    def done(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(4, "big")


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 4, 0xFFFFFFFF
        self.code = int.from_bytes(data[:4], "big")

    def point(self, total: int) -> int:
        self.range //= total
        return min(self.code // self.range, total - 1)

    def take(self, start: int, freq: int) -> None:
        self.code -= start * self.range
        self.range *= freq
        while self.range < RangeEncoder.LEAST:
            if self.at >= len(self.data) + 4:
                raise ValueError("range coder input is exhausted")
            self.code = self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.range <<= 8


def range_blocks_encode(intervals: list[tuple[int, int]]) -> bytes:
    """:func:`rans_encode` by the range coder: raw bytes take even shares of 256."""
    coder = RangeEncoder()
    for start, freq in intervals:
        coder.put(*((start, freq, SCALE) if freq else (start, 1, 256)))
    return coder.done()


class RangeReader:
    """:class:`RansReader` for :func:`range_blocks_encode`."""

    def __init__(self, data: bytes):
        self.coder, self.point = RangeDecoder(data), None

    def peek(self) -> int:
        if self.point is None:
            self.point = self.coder.point(SCALE)
        return self.point

    def take(self, start: int, freq: int) -> None:
        self.peek()
        self.coder.take(start, freq)
        self.point = None

    def raw(self) -> int:
        value = self.coder.point(256)
        self.coder.take(value, 1)
        return value


@dataclass(frozen=True)
class Coder:
    """An entropy coder: a block of intervals to bytes, and a reader of such bytes."""

    encode: Callable[[list[tuple[int, int]]], bytes]
    reader: type


#: Coders by name; codecs take any of them.
CODERS = {"rans": Coder(rans_encode, RansReader), "range": Coder(range_blocks_encode, RangeReader)}


class Counts:
    """Adaptive counts for the range coder: a step per symbol, halved (plus one) when the total passes 65536."""

    LIMIT = 1 << 16

    def __init__(self, n: int, step: int):
        self.n, self.step = [1] * n, step

    def interval(self, sym: int) -> tuple[int, int, int]:
        return sum(self.n[:sym]), self.n[sym], sum(self.n)

    def tell(self, sym: int) -> None:
        self.n[sym] += self.step
        if sum(self.n) > self.LIMIT:
            self.n = [(v >> 1) + 1 for v in self.n]


def range_encode(symbols: list[int], n: int, step: int) -> bytes:
    counts, coder = Counts(n, step), RangeEncoder()
    for s in symbols:
        coder.put(*counts.interval(s))
        counts.tell(s)
    return coder.done()


def range_decode(data: bytes, length: int, n: int, step: int) -> list[int]:
    counts, coder, out = Counts(n, step), RangeDecoder(data), []
    for _ in range(length):
        point, low, sym = coder.point(sum(counts.n)), 0, 0
        while low + counts.n[sym] <= point:
            low += counts.n[sym]
            sym += 1
        coder.take(low, counts.n[sym])
        counts.tell(sym)
        out.append(sym)
    return out


def entropy_blocks(intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Encodes rows (frame_id, seq, start, freq) per frame and block of ``block`` rows: (frame_id, block, n, payload)."""

    def code(batches):
        for (frame, number), t in by_key(batches, ["frame_id", "block"]):
            pairs = list(zip(t.column("start").to_pylist(), t.column("freq").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([frame]), pa.array([number]), pa.array([len(pairs)]), pa.array([rans_encode(pairs)], pa.binary())], names=["frame_id", "block", "n", "payload"])

    numbered = intervals.select("frame_id", F.floor(F.col("seq") / block).cast("long").alias("block"), "seq", "start", "freq")
    return numbered.repartition("frame_id", "block").sortWithinPartitions("frame_id", "block", "seq").mapInArrow(code, "frame_id long, block long, n long, payload binary")
