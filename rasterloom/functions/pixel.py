"""Pixel and scalar expressions: channel packing, quantisation, block arithmetic. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default 16-bit layout (5 bits a channel), block edge, run cap, names of the loss levels.
MASKS_555 = (0x7C00, 0x03E0, 0x001F)
BLOCK_EDGE = 16
RUN_CAP = 255
LOSS_LABELS = ("lossless", "1 bit", "2 bits", "3 bits", "4 bits")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_shift(mask: int) -> int:
    """Position of the lowest set bit of a channel mask."""
    return (mask & -mask).bit_length() - 1 if mask else 0


def unpack16(word, masks: tuple[int, int, int] = MASKS_555) -> list[Column]:
    """Channels of a packed 16-bit pixel."""
    return [F.shiftright(_c(word).bitwiseAND(F.lit(m)), mask_shift(m)) for m in masks]


def pack16(channels, masks: tuple[int, int, int] = MASKS_555) -> Column:
    """Packed 16-bit pixel; channels must fit their masks."""
    parts = [F.shiftleft(_c(c).cast("int"), mask_shift(m)) for c, m in zip(channels, masks, strict=True)]
    return parts[0] + parts[1] + parts[2]


def unpack32(word) -> list[Column]:
    """Three channels of a 32-bit pixel; the fourth byte is dropped."""
    w = _c(word).cast("long")
    return [F.shiftright(w, s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0)]


def pack32(r, g, b) -> Column:
    """32-bit pixel whose fourth byte is 255 (a fourth byte is not kept through a round trip)."""
    part = lambda c, s: F.shiftleft(_c(c).cast("long"), s)
    return part(F.lit(255), 24) + part(r, 16) + part(g, 8) + part(b, 0)


def quantise(channel, loss) -> Column:
    """Clear the low ``loss`` bits and set the middle of the bucket; loss 0 keeps the value."""
    if isinstance(loss, int):
        return _c(channel) if loss == 0 else _c(channel).bitwiseAND(F.lit(255 & ~((1 << loss) - 1))).bitwiseOR(F.lit((1 << loss) >> 1))
    step = F.expr(f"shiftleft(1, {loss})")
    return (_c(channel) - _c(channel) % step) + F.floor(step / 2).cast("int")


def quality_to_loss(quality) -> Column:
    """Quality 0..10000 to loss 0..4; out-of-range qualities are clamped to 10000 above."""
    q = F.least(_c(quality), F.lit(10000))
    return F.least(F.floor((F.lit(10000) - q) / 2000), F.lit(4)).cast("int")


def loss_label(loss) -> Column:
    out = F.lit(None).cast("string")
    for k, name in enumerate(LOSS_LABELS):
        out = F.when(_c(loss) == k, name).otherwise(out)
    return out


def ceil_div(x, n: int = BLOCK_EDGE) -> Column:
    return F.floor((_c(x) + (n - 1)) / n).cast("int")


def align4(x) -> Column:
    """Bytes of a scan line padded to four."""
    return (F.floor((_c(x) + 3) / 4) * 4).cast("int")


def clamp(x, low, high) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def index_bytes(index) -> tuple[Column, Column]:
    """Low and high byte of a 16-bit block index; indexes that need more bits raise (no silent truncation)."""
    i = _c(index)
    ok = F.when((i < 0) | (i > 65535), F.raise_error(F.lit("block index needs more than 16 bits"))).otherwise(i)
    return ok.bitwiseAND(F.lit(255)), F.shiftright(ok, 8)


def version_tag(version, kind) -> Column:
    """First byte of a keyframe packet: kind in the low half, version - 1 in the high half."""
    return (_c(version) - 1) * 16 + _c(kind)


def tag_version(tag) -> Column:
    return F.shiftright(_c(tag), 4) + 1


def segment_of(index, total, workers: int) -> Column:
    """Which of ``workers`` even segments [total*i/n, total*(i+1)/n) holds ``index``."""
    i, t = _c(index).cast("long"), _c(total).cast("long")
    return F.floor(((i + 1) * workers - 1) / t).cast("int")


def max_packet_bytes(width, height) -> Column:
    """Upper bound on a packet: six bytes a pixel."""
    return _c(width).cast("long") * _c(height).cast("long") * 6


def row_bytes(pixels: Column, width: int, pad: bool = True) -> Column:
    """Hex text of one scan line from an ordered array of (r, g, b) structs, zero-padded to four bytes."""
    body = F.array_join(F.transform(pixels, lambda p: F.concat(*(F.lpad(F.lower(F.hex(p[c].cast("long"))), 2, "0") for c in "rgb"))), "")
    gap = (-3 * width) % 4 if pad else 0
    return F.concat(body, F.lit("00" * gap)) if gap else body
