"""Boxes, clipping and colour values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of a height picture.
LEVELS = 197


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def scale_to_byte(x: Column, low: Column, high: Column) -> Column:
    """0 to 255, cut off (not rounded), of a value clipped to [low, high]; null for an empty range."""
    return F.floor(255 * F.try_divide(clip(x, low, high) - low, high - low) + 1e-9).cast("long")


def gamma(x: Column) -> Column:
    return F.pow(x, F.lit(1.0 / 2.2))


def color_index(x: Column, low: Column, high: Column, levels: int = LEVELS) -> Column:
    """Row of a colour table with ``levels`` rows, the last one closed."""
    share = F.try_divide(clip(x, low, high) - low, high - low)
    return F.when(share.isNotNull(), F.least(F.floor(share * levels + 1e-9), F.lit(levels - 1))).cast("long")


def void_nodata(x: Column, nodata: float) -> Column:
    """Null where a value equals the no-data value within a relative tolerance."""
    return F.when(~(F.abs(x - nodata) <= 1e-8 + 1e-5 * abs(nodata)), x)


def inside(col: Column, row: Column, width: Column, height: Column) -> Column:
    return (col >= 0) & (row >= 0) & (col < width) & (row < height)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """struct(x, y, w, h, first, second) of two boxes (x, y, w, h): the intersection and its share of each.

    Boxes that meet in one row or column of pixels, and boxes one pixel wide, count as apart
    (null box, shares 0), as the workload defines it.
    """

    def axis(i: int):
        lo1, hi1, lo2, hi2 = a[i], a[i] + a[i + 2] - 1, b[i], b[i] + b[i + 2] - 1
        low, high = F.greatest(lo1, lo2), F.least(hi1, hi2)
        return low, high - low + 1, high > low

    x, w, ok_x = axis(0)
    y, h, ok_y = axis(1)
    ok = ok_x & ok_y
    area = (w * h).cast("double")
    share = lambda box: F.when(ok, area / (box[2] * box[3])).otherwise(0.0)
    fields = [F.when(ok, v).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))]
    return F.struct(*fields, share(a).alias("first"), share(b).alias("second"))


def pair_id(a: Column, b: Column) -> Column:
    """One number for an unordered pair of image ids, base 2**31 - 1."""
    return F.least(a, b).cast("long") * 2147483647 + F.greatest(a, b).cast("long")


def pair_of(pair: Column) -> tuple[Column, Column]:
    """(smaller, larger) id; an integer division, as a double would lose the last digits."""
    base = F.lit(2147483647).cast("long")
    second = F.pmod(pair, base)
    return F.call_function("div", pair - second, base), second


def masked(value: Column, *masks: Column) -> Column:
    """Void where any mask holds or the value is void; a null mask doesn't hold."""
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return F.when(~(out | value.isNull()), value)
