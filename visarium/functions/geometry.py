"""Crop geometry as expressions, and the smoothers as plain folds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CropConfig:
    """What a crop to another shape is made by; defaults for 9:16."""

    target_width: int = 1080
    target_height: int = 1920
    alpha: float = 0.12
    deadzone: int = 20
    max_jump: int = 35
    tolerance: int = 15
    scene_threshold: float = 28
    max_stretch: float = 1.2
    blur_kernel: int = 51
    blur_sigma: float = 30
    object_classes: tuple[int, ...] = field(default=(0, 1, 2, 3, 16, 17, 18))


@dataclass(frozen=True)
class TrackConfig:
    """The person tracker's smoothing."""

    alpha: float = 0.15
    deadzone: int = 10
    max_jump: int = 40


def crop_left(center: Column, frame_width: Column, target_width: int) -> Column:
    """Left edge of the crop. In a frame narrower than the target it is negative; whoever renders cuts it again."""
    return F.least(F.greatest(F.lit(0), center - target_width // 2), frame_width - target_width)


def face_center(faces: Column, target_width: int) -> Column:
    """Centre to follow among the faces' boxes (an array): the only one, the middle if all fit, else the widest by 80 %
    and the next by 20 %. Null without faces."""
    mid = F.transform(faces, lambda b: (b["left"] + b["right"]) / F.lit(2.0))
    # Widest first; of equal ones the first.
    ranked = F.array_sort(F.transform(faces, lambda b, k: F.struct((-(b["right"] - b["left"]) * (b["right"] - b["left"])).alias("w"), k.alias("k"), ((b["left"] + b["right"]) / F.lit(2.0)).alias("c"))))
    low, high = F.array_min(mid), F.array_max(mid)
    follow = F.get(ranked, F.lit(0))["c"] * 0.8 + F.get(ranked, F.lit(1))["c"] * 0.2
    return F.when(F.size(faces) == 1, F.element_at(mid, 1)).when(F.size(faces) > 1, F.when(high - low <= target_width, (low + high) / 2).otherwise(follow)).cast("int")


def class_center(boxes: Column, classes: tuple[int, ...]) -> Column:
    """Mean centre of the boxes (structs with cls, left, right) of some classes; null without any."""
    mid = F.transform(F.filter(boxes, lambda b: b["cls"].isin(*classes)), lambda b: (b["left"] + b["right"]) / F.lit(2.0))
    return F.when(F.size(mid) > 0, F.aggregate(mid, F.lit(0.0), lambda s, x: s + x) / F.size(mid)).cast("int")


def resize_dims(width: Column, height: Column, config: CropConfig = CropConfig()) -> Column:
    """struct<width, height, blur>: fitted to the target, stretched on the short side as far as allowed, blurred beyond."""
    tw, th = config.target_width, config.target_height
    by_w, by_h = F.lit(float(tw)) / width, F.lit(float(th)) / height
    scale = F.least(by_w, by_h)
    stretched = lambda side: (F.floor(side * scale).cast("int") * F.lit(float(config.max_stretch))).cast("int")
    fit_w, fit_h = F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
    out = lambda w, h, blur: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), F.lit(blur).alias("blur"))
    full = out(F.lit(tw), F.lit(th), False)
    tall = F.when((fit_h >= th) | (stretched(height) >= th), full).otherwise(out(F.lit(tw), stretched(height), True))
    wide = F.when((fit_w >= tw) | (stretched(width) >= tw), full).otherwise(out(stretched(width), F.lit(th), True))
    return F.when(by_w <= by_h, tall).otherwise(wide)


def smoothed(current: float, previous: float, alpha: float, deadzone: float, max_jump: float) -> int:
    """One step: small moves are ignored, large ones bounded (by the move as it came), then the moving average, truncated."""
    move = current - previous
    to = previous if abs(move) < deadzone else current
    if abs(move) > max_jump:
        to = previous + math.copysign(max_jump, move)
    return int(alpha * to + (1 - alpha) * previous)


def smoothed_column(current: Column, previous: Column, alpha: float, deadzone: float, max_jump: float) -> Column:
    """The same step as an expression."""
    move = current - previous
    to = F.when(F.abs(move) > max_jump, previous + F.signum(move) * max_jump).when(F.abs(move) < deadzone, previous).otherwise(current)
    return (F.lit(alpha) * to + F.lit(1 - alpha) * previous).cast("int")
