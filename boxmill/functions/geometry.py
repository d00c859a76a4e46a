"""Boxes: pixel corners, normalised centre/size, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corners(points: Column | str) -> list[Column]:
    """First four numbers of a points array as the box corner columns."""
    p = _col(points)
    too_short = F.raise_error(
        F.concat(F.lit("rectangle has fewer than 4 coordinates: "), F.to_json(p))
    ).cast("double")
    names = ("bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br")
    return [
        F.when(F.size(p) >= 4, F.get(p, F.lit(i))).otherwise(too_short).alias(name)
        for i, name in enumerate(names)
    ]


def to_normalised(x_tl, y_tl, x_br, y_br, width, height) -> tuple[Column, ...]:
    """Pixel corners -> centre and size as fractions of the image."""
    x0, y0, x1, y1, w, h = (_col(c) for c in (x_tl, y_tl, x_br, y_br, width, height))
    return (
        ((x0 + x1) / F.lit(2.0)) / w,
        ((y0 + y1) / F.lit(2.0)) / h,
        (x1 - x0) / w,
        (y1 - y0) / h,
    )


def to_pixels(xc, yc, w, h, width, height) -> tuple[Column, ...]:
    """Centre and size as fractions -> pixel corners."""
    cx, cy, bw, bh, iw, ih = (_col(c) for c in (xc, yc, w, h, width, height))
    half_w, half_h = bw / F.lit(2.0), bh / F.lit(2.0)
    return (
        (cx - half_w) * iw,
        (cy - half_h) * ih,
        (cx + half_w) * iw,
        (cy + half_h) * ih,
    )


def fixed(value: Column | str, decimals: int) -> Column:
    """Decimal text of the exact binary value, rounded half to even.

    ``round`` and ``format_string`` start from other roundings of the double and
    differ from this on ties.
    """
    return F.call_function("format_number", _col(value), F.lit("0." + "0" * decimals))


def exact_round(value: Column | str, decimals: int = 2) -> Column:
    return fixed(value, decimals).cast("double")


def label_line(class_index: Column | str, xc, yc, w, h) -> Column:
    """``class xc yc w h`` with six decimals."""
    numbers = [fixed(c, 6) for c in (xc, yc, w, h)]
    return F.concat_ws(" ", _col(class_index).cast("string"), *numbers)
