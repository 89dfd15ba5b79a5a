"""Column functions: colour projections, rounding rules and bit-level codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block sizes and their codes in a record.
SIZE_CODES = {4: 1, 8: 2, 16: 3, 32: 4, 64: 5, 128: 6}


def java_round(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def idiv(x: Column, n: int) -> Column:
    """Integer quotient, rounded down."""
    return F.floor(x / n).cast("int")


def unpack_rgb(argb: Column) -> list[Column]:
    return [F.shiftright(argb, s).bitwiseAND(F.lit(255)).cast("int").alias(c) for s, c in ((16, "r"), (8, "g"), (0, "b"))]


def pack_argb(r: Column, g: Column, b: Column) -> Column:
    """Opaque packed colour as a non-negative number of 32 bits."""
    r, g, b = (c.cast("long") for c in (r, g, b))
    return F.lit(255 << 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Full-range BT.601."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    u, v = u - 128, v - 128
    return tuple(clamp(java_round(c), 0, 255).cast("int") for c in (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u))


def luma_milli(r: Column, g: Column, b: Column) -> Column:
    """Luma in whole thousandths."""
    return (299 * r + 587 * g + 114 * b).cast("long")


def chroma_micro(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """U and V of a pixel in whole millionths."""
    base = F.lit(128_000_000).cast("long")
    return base - 168_736 * r - 331_264 * g + 500_000 * b, base + 500_000 * r - 418_688 * g - 81_312 * b


def big_endian(x: Column, n: int) -> Column:
    """The low ``n`` bytes of a number, highest first, as hex."""
    return F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 8 * n))), 2 * n, "0")


def from_big_endian(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("long")


def signmag7(x: Column) -> Column:
    """Sign and the low seven bits of the magnitude in one byte."""
    return F.abs(x).bitwiseAND(F.lit(127)).bitwiseOR(F.when(x < 0, F.lit(128)).otherwise(F.lit(0))).cast("int")


def from_signmag7(b: Column) -> Column:
    low = b.bitwiseAND(F.lit(127))
    return F.when(b.bitwiseAND(F.lit(128)) > 0, -low).otherwise(low).cast("int")


def size_code(size: Column) -> Column:
    return F.coalesce(*[F.when(size == s, F.lit(c)) for s, c in SIZE_CODES.items()])


def refsize(ref: Column, size: Column) -> Column:
    return F.shiftleft(ref, 4).bitwiseOR(size_code(size)).cast("int")


def from_refsize(b: Column) -> tuple[Column, Column]:
    return F.shiftright(b, 4).cast("int"), F.call_function("shiftleft", F.lit(2), b.bitwiseAND(F.lit(15))).cast("int")


def record_size(size: Column) -> Column:
    half = F.floor(size / 2)
    return (7 + size * size + 2 * half * half).cast("long")


def quadkey(x: Column, y: Column, size: Column, root: int, height: int) -> Column:
    """Depth-first key: the root's number (columns first) and one digit per level down to ``size``."""
    rows = -(-height // root)
    key = F.lpad((idiv(x, root) * rows + idiv(y, root)).cast("string"), 5, "0")
    half = root // 2
    while half >= 4:
        digit = F.pmod(idiv(x, half), F.lit(2)) * 2 + F.pmod(idiv(y, half), F.lit(2))
        key = F.concat(key, F.when(size <= half, digit.cast("string")).otherwise(F.lit("")))
        half //= 2
    return key
