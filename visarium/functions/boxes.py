"""Bounding boxes: one canonical struct<left,top,right,bottom> from every producer's order, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for n, c in zip(SIDES, (left, top, right, bottom), strict=True)))


def box_from(order: str, a: Column, b: Column, c: Column, d: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The canonical box of four numbers in an order: ltrb, trbl, xywh, or unit (ltrb as shares of width and height)."""
    if order == "ltrb":
        return box(a, b, c, d)
    if order == "trbl":
        return box(d, a, b, c)
    if order == "xywh":
        return box(a, b, a + c, b + d)
    if order == "unit" and width is not None and height is not None:
        return box((a * width).cast("int"), (b * height).cast("int"), (c * width).cast("int"), (d * height).cast("int"))
    raise ValueError(f"unknown order {order!r}")


def valid(b: Column) -> Column:
    """Neither empty nor turned over."""
    return (b["right"] > b["left"]) & (b["bottom"] > b["top"])


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The part of the box inside the image, as slicing takes it."""
    return box(F.greatest(b["left"], F.lit(0)), F.greatest(b["top"], F.lit(0)), F.least(b["right"], width), F.least(b["bottom"], height))


def padded(b: Column, width: Column, height: Column, ratio: float = 0.15) -> Column:
    """Grown by a share of its own size on all sides, cut at the image."""
    dx = ((b["right"] - b["left"]) * F.lit(float(ratio))).cast("int")
    dy = ((b["bottom"] - b["top"]) * F.lit(float(ratio))).cast("int")
    return clamped(box(b["left"] - dx, b["top"] - dy, b["right"] + dx, b["bottom"] + dy), width, height)


def area(b: Column) -> Column:
    return (b["right"] - b["left"]) * (b["bottom"] - b["top"])


def area_ratio(b: Column, width: Column, height: Column) -> Column:
    return area(b).cast("double") / (width * height)


def center_x(b: Column) -> Column:
    return (b["left"] + b["right"]) / F.lit(2.0)
