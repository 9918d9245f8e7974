"""Image statistics and raster operators on luma tiles (ARRAY<INT>, row after row) and on masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from visarium.functions import rasters


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Luma of a pixel."""
    return F.round(F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue).cast("int")


def mean(tile: Column) -> Column:
    return F.aggregate(tile, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(tile)


def variance(tile: Column) -> Column:
    """Population variance from whole-number sums: exact whatever the order."""
    zero = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("n"))
    add = lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x.cast("bigint") * x).alias("b"), (s["n"] + 1).alias("n"))
    return F.aggregate(tile, zero, add, lambda s: (s["b"] * s["n"] - s["a"] * s["a"]).cast("double") / (s["n"] * s["n"]))


def laplacian(tile: Column, width: int, height: int) -> Column:
    """Four neighbours less four times the pixel; borders are mirrored without repeating the edge."""
    mirror = lambda i, n: F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
    at = lambda x, y: F.element_at(tile, (mirror(y, height) * width + mirror(x, width) + 1).cast("int"))

    def pixel(k: Column) -> Column:
        x, y = k % width, F.floor(k / width).cast("int")
        return at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - 4 * at(x, y)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def face_quality(tile: Column, width: int, height: int, file_bytes: Column) -> Column:
    """0 to 1 from area, sharpness, contrast, brightness and file size; 0 for no image."""
    capped = lambda x: F.least(F.lit(1.0), x)

    def score(t: Column) -> Column:
        parts = (
            F.lit(0.3) * capped(F.lit(width * height / 10000.0))
            + F.lit(0.3) * capped(variance(laplacian(t, width, height)) / 1000.0)
            + F.lit(0.2) * (F.sqrt(variance(t)) / 127.5)
            + F.lit(0.1) * (1 - F.abs(mean(t) - 127.5) / 127.5)
            + F.lit(0.1) * capped(file_bytes / 50000.0)
        )
        return F.when(t.isNull() | (F.size(t) == 0), 0.0).otherwise(parts)

    return let(tile, score)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two tiles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(a)


def rectangle(tile: Column, width: int, height: int, box: Column, value: int = 255) -> Column:
    """The tile with a box's outline (both ends drawn) in one value; what is off the tile is left out."""

    def pixel(k: Column) -> Column:
        x, y = k % width, F.floor(k / width).cast("int")
        inside = (x >= box["left"]) & (x <= box["right"]) & (y >= box["top"]) & (y <= box["bottom"])
        edge = (x == box["left"]) | (x == box["right"]) | (y == box["top"]) | (y == box["bottom"])
        return F.when(inside & edge, value).otherwise(F.element_at(tile, k + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def _mapped(tile: Column, rows: np.ndarray, cols: np.ndarray) -> Column:
    """rows x tile x cols', in doubles: any resampling or blur that works along the sides one after another."""
    (to_h, h), (to_w, w) = rows.shape, cols.shape
    given = lambda m: F.array(*(F.lit(float(x)) for x in m.ravel()))
    total = lambda n, term: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + term(i))

    def down(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(to_h * w - 1)), lambda k: total(h, lambda i: F.element_at(a, (F.floor(k / w) * h + i + 1).cast("int")) * F.element_at(tile, (i * w + k % w + 1).cast("int"))))

    def across(mid: Column) -> Column:
        return let(given(cols), lambda b: F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), lambda k: total(w, lambda j: F.element_at(b, (k % to_w * w + j + 1).cast("int")) * F.element_at(mid, (F.floor(k / to_w) * w + j + 1).cast("int")))))

    return let(let(given(rows), down), across)


def resized(tile: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """The tile at another size, in doubles: shares of area where a side shrinks, between centres where it grows."""
    return _mapped(tile, rasters.resize_weights(height, to_height), rasters.resize_weights(width, to_width))


def blurred(tile: Column, width: int, height: int, kernel: int, sigma: float = 0) -> Column:
    """The tile under a bell of odd length, in doubles."""
    return _mapped(tile, rasters.blur_weights(height, kernel, sigma), rasters.blur_weights(width, kernel, sigma))


def columns(tile: Column, width: int, height: int, left: Column, to_width: int) -> Column:
    """So many columns of the tile from one on, which is moved so that they all exist."""
    start = F.greatest(F.lit(0), F.least(left, F.lit(width - to_width))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.slice(tile, y * width + start + 1, to_width)))


def oval_mask(width: int, height: int, width_ratio: float, height_ratio: float) -> Column:
    """255 inside the ellipse around the centre whose half axes are shares of the frame's sides, else 0."""
    cx, cy, rx, ry = width // 2, height // 2, int(width * width_ratio), int(height * height_ratio)

    def pixel(k: Column) -> Column:
        x, y = (k % width - cx).cast("double"), (F.floor(k / width) - cy).cast("double")
        return F.when(x * x * (ry * ry) + y * y * (rx * rx) <= float(rx * rx * ry * ry), 255).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def union_mask(masks: Column, threshold: float = 0.3) -> Column:
    """255 where any of the masks (an array of arrays of shares) is over the threshold."""
    on = F.transform(masks, lambda m: F.transform(m, lambda x: F.when(x > threshold, 255).otherwise(0)))
    return F.aggregate(F.slice(on, 2, F.greatest(F.size(on) - 1, F.lit(0))), F.element_at(on, 1), lambda s, m: F.zip_with(s, m, lambda x, y: F.greatest(x, y)))


def mask_choice(masks: Column, pixels: int, oval: Column, always_oval: bool = False, oval_fallback: bool = False, threshold: float = 0.3) -> Column:
    """The forced oval, else the persons' union, else the fallback oval, else nothing."""
    if always_oval:
        return oval
    empty = F.array_repeat(F.lit(0), pixels)
    return F.when(F.coalesce(F.size(masks), F.lit(0)) > 0, union_mask(masks, threshold)).otherwise(oval if oval_fallback else empty)


def background(frame: Column, color: int | None = None, image: Column | None = None) -> Column:
    """A solid colour, else a given image, else the frame itself."""
    if color is not None:
        return F.transform(frame, lambda _: F.lit(color))
    return F.coalesce(image, frame) if image is not None else frame


def composite(frame: Column, mask: Column, behind: Column) -> Column:
    """The frame where the mask is set and the background elsewhere, in bits as the mask has them, added up to 255."""
    front = F.zip_with(frame, mask, lambda x, m: F.when(m != 0, x).otherwise(0))
    back = F.zip_with(behind, mask, lambda x, m: F.when(m != 255, x).otherwise(0))
    return F.zip_with(front, back, lambda x, y: F.least(x + y, F.lit(255)))
