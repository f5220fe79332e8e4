"""Lossless frame codec over keyframe segments: images to packets and back.

Statistics live from a keyframe to the next, so segments are independent: they
encode and decode in parallel, frames within one in order. The packet layout is
our own: a tag byte, then entropy-coded symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.pixel import BLOCK_EDGE, RUN_CAP
from rasterloom.operators.entropy import CODERS, SymbolReader, encode_blocks
from rasterloom.operators.model import SCALE, Models
from rasterloom.operators.motion import find_vector
from rasterloom.operators.predict import DELTA_ORDER, KEY_ORDER, LEFT, LITERAL, PREVIOUS, UP, UP_LEFT, fits_of_image
from rasterloom.operators.runs import greedy_fold

#: Version, packet tags, fixed alphabets by channel (colours are adaptive bytes).
VERSION = 4
FLAT, CODED, SAME, DELTA = 1 + 16 * (VERSION - 1), 2 + 16 * (VERSION - 1), 0, 1
ALPHABETS = {"n": 256, "type": 6, "index": 256, "bn": 256, "bt": 5, "edge": 16, "mv": 512}


class FrameCodec(Protocol):
    """What a codec must do for one segment; :class:`SegmentCodec` is the one here."""

    def encode(self, image: np.ndarray, key: bool) -> bytes: ...

    def decode(self, packet: bytes) -> np.ndarray: ...


def _pack(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int32)
    return a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]


class SegmentCodec:
    """State of one segment: statistics and the frame before."""

    def __init__(self, height: int, width: int, far: int = 256, near: int = 8, coder: str = "rans"):
        self.h, self.w, self.far, self.near, self.coder = height, width, far, near, CODERS[coder]
        self.models, self.prev = Models(ALPHABETS), None
        self.nby, self.nbx = -(-height // BLOCK_EDGE), -(-width // BLOCK_EDGE)

    # Symbols: a list of (channel, ctx, value); channel "flag" has no model.
    def _intervals(self, symbols: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        half = SCALE // 2
        return [(v * half, half) if c == "flag" else self.models.interval(c, k, v) for c, k, v in symbols]

    @staticmethod
    def _colour(out: list, rgb, older: int, newer: int) -> None:
        for k, v in enumerate(int(c) for c in rgb):
            out.append((f"c{k}", (older >> 2 << 6) + (newer >> 2), v))
            older, newer = newer, v

    def encode(self, image: np.ndarray, key: bool) -> bytes:
        a = image.reshape(self.h, self.w, 3)
        if (a == a[0, 0]).all():
            if self.prev is None or not (self.prev == a).all():
                self.models = Models(ALPHABETS)
            self.prev = a.copy()
            return bytes([FLAT, *a[0, 0].tolist()])
        tag, symbols = self.symbols(a, key)
        if tag == CODED:
            self.models = Models(ALPHABETS)
        return bytes([tag]) + (encode_blocks(self._intervals(symbols), encode=self.coder.encode) if tag != SAME else b"")

    def symbols(self, image: np.ndarray, key: bool) -> tuple[int, list[tuple[str, int, int]]]:
        """Packet tag of an image and what it writes: (channel, context, value); the image becomes the frame before."""
        a = image.reshape(self.h, self.w, 3)
        if (a == a[0, 0]).all():
            out = FLAT, []
        elif key or self.prev is None:
            out = CODED, self._key_symbols(a)
        elif (a == self.prev).all():
            out = SAME, []
        else:
            out = DELTA, self._delta_symbols(a)
        self.prev = a.copy()
        return out

    def _key_symbols(self, a: np.ndarray) -> list:
        flat, out = a.reshape(-1, 3), []
        n = len(flat)
        head = min(self.w + 1, n)
        # The first row and one pixel: plain colour runs.
        cut = np.concatenate([[True], (flat[1:head] != flat[: head - 1]).any(axis=1)])
        starts = np.flatnonzero(cut).tolist() + [head]
        older = newer = 0
        for s, e in zip(starts, starts[1:], strict=False):
            for at in range(s, e, RUN_CAP):
                self._colour(out, flat[at], older, newer)
                out.append(("n", LITERAL, min(RUN_CAP, e - at)))
                older, newer = int(flat[at][1]), int(flat[at][2])
        if n > head:
            fits = fits_of_image(a, None)
            mask = sum((fits[k].reshape(-1).astype(np.int64) << k for k in KEY_ORDER), fits[LEFT].reshape(-1).astype(np.int64))
            types, lengths = greedy_fold(mask[head:], False)
            at, last = head, 0
            for t, m in zip(types, lengths, strict=True):
                out.append(("type", last, t))
                if t == LITERAL:
                    self._colour(out, flat[at], int(flat[at - 1][1]), int(flat[at - 1][2]))
                out.append(("n", t, m))
                at, last = at + m, t
        return out

    def _delta_symbols(self, a: np.ndarray) -> list:
        prev, now = _pack(self.prev), _pack(a)
        diff, e = prev != now, BLOCK_EDGE
        blocks = {}
        for by in range(self.nby):
            for bx in range(self.nbx):
                d = diff[by * e : by * e + e, bx * e : bx * e + e]
                if d.any():
                    ys, xs = np.flatnonzero(d.any(axis=1)), np.flatnonzero(d.any(axis=0))
                    rect = (bx * e + int(xs[0]), by * e + int(ys[0]), bx * e + int(xs[-1]) + 1, by * e + int(ys[-1]) + 1)
                    whole = (int(xs[-1]) - int(xs[0]) + 1, int(ys[-1]) - int(ys[0]) + 1) == d.shape[::-1]
                    mv = find_vector(prev, now, rect, self.far, self.near)
                    blocks[by * self.nbx + bx] = (1 if whole else 2) + (2 if mv else 0), rect, mv
        by_, bx_ = [k // self.nbx for k in blocks], [k % self.nbx for k in blocks]
        first, last = min(by_) * self.nbx + min(bx_), max(by_) * self.nbx + max(bx_)
        out = [("index", 0, v >> s & 255) for v in (first, last) for s in (0, 8, 16, 24)]
        codes = [blocks[k][0] if k in blocks else 0 for k in range(first, last + 1)]
        at = 0
        while at < len(codes):
            n = 1
            while at + n < len(codes) and codes[at + n] == codes[at] and n < RUN_CAP:
                n += 1
            out += [("bt", 0, codes[at]), ("bn", 0, n)]
            at += n
        fits, vector = fits_of_image(a, self.prev), (0, 0)
        for k in sorted(blocks):
            code, (x1, y1, x2, y2), mv = blocks[k]
            ox, oy = k % self.nbx * e, k // self.nbx * e
            if code in (2, 4):
                out += [("edge", i, v) for i, v in enumerate((x1 - ox, y1 - oy, x2 - 1 - ox, y2 - 1 - oy))]
            if mv:
                out.append(("flag", 0, int(mv == vector)))
                if mv != vector:
                    out += [("mv", 0, mv[0] + self.far), ("mv", 1, mv[1] + self.far)]
                    vector = mv
                continue
            part = {t: f[y1:y2, x1:x2].reshape(-1) for t, f in fits.items()}
            inside = now[y1:y2, x1:x2].reshape(-1)
            mask = sum((part[t].astype(np.int64) << t for t in DELTA_ORDER), np.concatenate([[0], inside[1:] == inside[:-1]]).astype(np.int64))
            types, lengths = greedy_fold(mask, True)
            colours = a[y1:y2, x1:x2].reshape(-1, 3)
            at, was = 0, 0
            for t, m in zip(types, lengths, strict=True):
                out.append(("type", was, t))
                if t == LITERAL:
                    before = colours[at - 1] if at else (0, 0, 0)
                    self._colour(out, colours[at], int(before[1]), int(before[2]))
                out.append(("n", t, m))
                at, was = at + m, t
        return out

    def decode(self, packet: bytes) -> np.ndarray | None:
        """The image; None for a delta without a frame before."""
        tag = packet[0]
        if tag == FLAT:
            a = np.zeros((self.h, self.w, 3), dtype=np.uint8)
            a[:] = np.frombuffer(packet[1:4], dtype=np.uint8)
            if self.prev is None or not (self.prev == a).all():
                self.models = Models(ALPHABETS)
        elif tag == CODED:
            self.models = Models(ALPHABETS)
            a = self._read_key(SymbolReader(packet[1:], self.models, reader=self.coder.reader))
        elif tag not in (SAME, DELTA):
            raise ValueError(f"packet of an unknown version: tag {tag:#x}")
        elif self.prev is None:
            return None
        else:
            a = self.prev if tag == SAME else self._read_delta(SymbolReader(packet[1:], self.models, reader=self.coder.reader))
        self.prev = a
        return a.copy()

    @staticmethod
    def _read_colour(r: SymbolReader, older: int, newer: int) -> tuple[int, int, int]:
        out = []
        for k in range(3):
            v = r.symbol(f"c{k}", (older >> 2 << 6) + (newer >> 2))
            out.append(v)
            older, newer = newer, v
        return tuple(out)

    def _read_key(self, r: SymbolReader) -> np.ndarray:
        n, w = self.h * self.w, self.w
        p = np.zeros((n, 3), dtype=np.int32)
        at, head, older, newer = 0, min(w + 1, n), 0, 0
        while at < head:
            c = self._read_colour(r, older, newer)
            m = r.symbol("n", LITERAL)
            p[at : at + m] = c
            older, newer, at = c[1], c[2], at + m
        last = 0
        while at < n:
            t = r.symbol("type", last)
            c = self._read_colour(r, int(p[at - 1][1]), int(p[at - 1][2])) if t == LITERAL else None
            m = r.symbol("n", t)
            for a in range(at, at + m, w):  # what a part of one width looks back to is decoded
                b = min(a + w, at + m)
                if t in (LITERAL, LEFT):
                    p[a:b] = c if t == LITERAL else p[a - 1]
                elif t == UP:
                    p[a:b] = p[a - w : b - w]
                elif t == UP_LEFT:
                    p[a:b] = p[a - w - 1 : b - w - 1]
                else:
                    p[a:b] = p[a - 1] + np.cumsum(p[a - w : b - w] - p[a - w - 1 : b - w - 1], axis=0)
            at, last = at + m, t
        return p.astype(np.uint8).reshape(self.h, w, 3)

    def _read_delta(self, r: SymbolReader) -> np.ndarray:
        e, prev = BLOCK_EDGE, self.prev.astype(np.int32)
        a = prev.copy()
        first, last = (sum(r.symbol("index", 0) << s for s in (0, 8, 16, 24)) for _ in range(2))
        codes: list[int] = []
        while len(codes) < last - first + 1:
            code = r.symbol("bt", 0)
            codes += [code] * r.symbol("bn", 0)
        vector = (0, 0)
        for k, code in enumerate(codes, first):
            if not code:
                continue
            ox, oy = k % self.nbx * e, k // self.nbx * e
            x1, y1, x2, y2 = ox, oy, min(ox + e, self.w), min(oy + e, self.h)
            if code in (2, 4):
                x1, y1, x2, y2 = (r.symbol("edge", i) for i in range(4))
                x1, y1, x2, y2 = x1 + ox, y1 + oy, x2 + ox + 1, y2 + oy + 1
            if code > 2:
                if not r.flag():
                    vector = r.symbol("mv", 0) - self.far, r.symbol("mv", 1) - self.far
                a[y1:y2, x1:x2] = prev[y1 + vector[1] : y2 + vector[1], x1 + vector[0] : x2 + vector[0]]
                continue
            at, was, before, side = 0, 0, (0, 0, 0), x2 - x1
            while at < side * (y2 - y1):
                t = r.symbol("type", was)
                c = self._read_colour(r, int(before[1]), int(before[2])) if t == LITERAL else None
                end = at + r.symbol("n", t)
                while at < end:  # row by row of the rectangle
                    y, xa = y1 + at // side, x1 + at % side
                    xb = min(x2, xa + end - at)
                    if t in (LITERAL, LEFT):
                        a[y, xa:xb] = c if t == LITERAL else a[y, xa - 1]
                    elif t == PREVIOUS:
                        a[y, xa:xb] = prev[y, xa:xb]
                    elif t == UP:
                        a[y, xa:xb] = a[y - 1, xa:xb]
                    elif t == UP_LEFT:
                        a[y, xa:xb] = a[y - 1, xa - 1 : xb - 1]
                    else:
                        a[y, xa:xb] = a[y, xa - 1] + np.cumsum(a[y - 1, xa:xb] - a[y - 1, xa - 1 : xb - 1], axis=0)
                    at += xb - xa
                was, before = t, a[y, xb - 1]
        return a.astype(np.uint8)


def encode(images: DataFrame, segments: DataFrame, far: int = 256, near: int = 8, coder: str = "rans") -> DataFrame:
    """Packets (frame_id, segment, ftype, payload, size) of images, by ``segments`` (frame_id, segment, is_key).

    A segment is at most a keyframe interval of frames: it streams through one
    task in order, one image at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, codec = None, None
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["segment"] != segment or codec is None:
                    segment, codec = x["segment"], SegmentCodec(x["height"], x["width"], far, near, coder)
                payload = codec.encode(np.frombuffer(x["pixels"], dtype=np.uint8), x["is_key"])
                rows.append({"frame_id": x["frame_id"], "segment": segment, "ftype": "I" if payload[0] in (FLAT, CODED) else "P", "payload": payload, "size": len(payload)})
            yield pa.RecordBatch.from_pylist(rows, schema=_PACKET)

    d = images.join(segments, "frame_id").select("segment", "frame_id", "height", "width", "pixels", "is_key")
    return d.repartition("segment").sortWithinPartitions("segment", "frame_id").mapInArrow(run, "frame_id long, segment long, ftype string, payload binary, size long")


def symbols(images: DataFrame, segments: DataFrame, far: int = 256, near: int = 8) -> DataFrame:
    """What :func:`encode` would write before entropy coding: rows (frame_id, segment, seq, channel, ctx, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, codec = None, None
        for b in batches:
            for x in b.to_pylist():
                if x["segment"] != segment or codec is None:
                    segment, codec = x["segment"], SegmentCodec(x["height"], x["width"], far, near)
                _, told = codec.symbols(np.frombuffer(x["pixels"], dtype=np.uint8), x["is_key"])
                n = len(told)
                columns = [pa.array([x["frame_id"]] * n, pa.int64()), pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t[0] for t in told], pa.string()), *(pa.array([t[k] for t in told], pa.int32()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, names=["frame_id", "segment", "seq", "channel", "ctx", "value"])

    d = images.join(segments, "frame_id").select("segment", "frame_id", "height", "width", "pixels", "is_key")
    return d.repartition("segment").sortWithinPartitions("segment", "frame_id").mapInArrow(run, "frame_id long, segment long, seq int, channel string, ctx int, value int")


_PACKET = pa.schema([("frame_id", pa.int64()), ("segment", pa.int64()), ("ftype", pa.string()), ("payload", pa.binary()), ("size", pa.int64())])


def decode(packets: DataFrame, height: int, width: int, far: int = 256, coder: str = "rans") -> DataFrame:
    """Images of packets; deltas that no keyframe precedes are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, codec = None, None
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["segment"] != segment or codec is None:
                    segment, codec = x["segment"], SegmentCodec(height, width, far, coder=coder)
                a = codec.decode(x["payload"])
                if a is not None:
                    rows.append({"frame_id": x["frame_id"], "height": height, "width": width, "pixels": a.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_IMAGE)

    d = packets.select("segment", "frame_id", "payload").repartition("segment").sortWithinPartitions("segment", "frame_id")
    return d.mapInArrow(run, "frame_id long, height int, width int, pixels binary")


_IMAGE = pa.schema([("frame_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])


def packet_type(first_byte, size, flag):
    """Frame type from a packet: tag 0 and 1 are deltas, the flat and coded tags keyframes, else the given flag."""
    b = F.col(first_byte) if isinstance(first_byte, str) else first_byte
    return F.when(b.isin(FLAT, CODED), "I").when(b.isin(SAME, DELTA), "P").otherwise(flag)
