"""Frames made from frames: drawn annotations, vertical renders, backgrounds behind persons, motion between frames.

Frames are rows with an image struct (origin, height, width, nChannels, mode, data); a frame is made where it is read, in
batches, and keeps its row's other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.functions import rasters
from visarium.functions.geometry import CropConfig


@dataclass(frozen=True)
class BackgroundConfig:
    """What stands behind persons, and how persons are told from it."""

    blur: bool = False
    blur_kernel: int = 55
    mask_threshold: float = 0.3
    color: tuple[int, int, int] | None = None
    always_oval: bool = False
    oval_fallback: bool = False
    oval_width: float = 1.0
    oval_height: float = 1.0
    debug: bool = False


def pixels_of(image: Any) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def image_of(pixels: np.ndarray, origin: str | None) -> dict[str, Any]:
    """The image struct's fields of blue, green, red or grey pixels."""
    x = np.ascontiguousarray(pixels.reshape(*pixels.shape[:2], -1), np.uint8)
    return {"origin": origin, "height": x.shape[0], "width": x.shape[1], "nChannels": x.shape[2], "mode": 8 * (x.shape[2] - 1), "data": x.tobytes()}


def _each(frames: DataFrame, make: Callable[..., np.ndarray], inputs: list[str]) -> DataFrame:
    """Every frame's image replaced by make(pixels, inputs...); a frame without an image stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [None if image is None else image_of(make(pixels_of(image), *rest), image["origin"]) for image, *rest in zip(pdf["image"], *(pdf[c] for c in inputs), strict=True)]
            yield pdf.assign(image=pd.Series(made, index=pdf.index, dtype=object))

    return frames.mapInPandas(run, frames.schema)


def draw_annotations(frames: DataFrame, column: str = "annotations") -> DataFrame:
    """Frames with the boxes and labels of a column array<struct<bbox, label>> drawn on them; null draws nothing."""

    def make(pixels: np.ndarray, marks: Any) -> np.ndarray:
        out = pixels.copy()
        for m in marks if marks is not None else []:
            b = m["bbox"]
            rasters.draw_box(out, (b["left"], b["top"], b["right"], b["bottom"]))
            rasters.draw_text(out, m["label"] or "", b["left"], b["top"] - 10)
        return out

    return _each(frames, make, [column])


def render_vertical(frames: DataFrame, config: CropConfig = CropConfig()) -> DataFrame:
    """Frames (with left, the crop's left edge) cut to the target's width and brought to its size: stretched as far as allowed,
    the rest filled with the blurred cut."""

    def make(pixels: np.ndarray, left: Any) -> np.ndarray:
        width = pixels.shape[1]
        left = max(0, min(int(left), width - config.target_width))
        return vertical(pixels[:, left : left + config.target_width], config)

    return _each(frames, make, ["left"])


def vertical(cut: np.ndarray, config: CropConfig = CropConfig()) -> np.ndarray:
    """One frame's cut at the target's size."""
    tw, th = config.target_width, config.target_height
    h, w = cut.shape[:2]
    scale = min(tw / w, th / h)
    by_width = scale == tw / w
    side, most = (int(h * scale), th) if by_width else (int(w * scale), tw)
    stretched = side if side >= most else min(int(side * config.max_stretch), most)
    if stretched >= most:
        return rasters.resized(cut, tw, th)
    new_w, new_h = (tw, stretched) if by_width else (stretched, th)
    out = rasters.resized(rasters.blurred(cut, config.blur_kernel, config.blur_sigma), tw, th)
    y, x = (th - new_h) // 2, (tw - new_w) // 2
    out[y : y + new_h, x : x + new_w] = rasters.resized(cut, new_w, new_h)
    return out


def isolate_persons(frames: DataFrame, config: BackgroundConfig = BackgroundConfig(), background: np.ndarray | None = None, person: int = 0) -> DataFrame:
    """Frames (with objects: array<struct<bbox, cls, mask struct<height, width, share>>>) with what is behind persons replaced.

    Background: a colour, else an image (resized to the frame), else the frame itself; blurred if asked for. Mask: the forced
    oval, else the union of the persons' masks, else the fallback oval, else nothing."""

    def make(pixels: np.ndarray, objects: Any) -> np.ndarray:
        h, w = pixels.shape[:2]
        found = [o for o in (objects if objects is not None else []) if o["cls"] == person and not config.always_oval]
        masks = [np.asarray(m["share"], float).reshape(int(m["height"]), -1) for o in found if (m := o["mask"]) is not None and m["share"] is not None]
        if masks:
            shares = (rasters.applied(m, rasters.resize_weights(m.shape[0], h), rasters.resize_weights(m.shape[1], w)) for m in masks)
            mask = np.any([s > config.mask_threshold for s in shares], axis=0)
        elif config.always_oval or config.oval_fallback:
            y, x = np.arange(h)[:, None] - h // 2, np.arange(w)[None] - w // 2
            rx, ry = max(int(w * config.oval_width), 1), max(int(h * config.oval_height), 1)
            mask = (x / rx) ** 2 + (y / ry) ** 2 <= 1
        else:
            mask = np.zeros((h, w), bool)
        if config.color is not None:
            behind = np.broadcast_to(np.array(config.color[: pixels.shape[2]], np.uint8), pixels.shape)
        else:
            behind = pixels if background is None else rasters.resized(background, w, h)
        if config.blur and config.color is None:
            behind = rasters.blurred(behind, config.blur_kernel)
        out = np.where(mask[..., None], pixels, behind)
        if config.debug and found:
            for k, o in enumerate(found):
                b = o["bbox"]
                rasters.draw_box(out, (b["left"], b["top"], b["right"], b["bottom"]))
                rasters.draw_dot(out, (b["left"] + b["right"]) // 2, (b["top"] + b["bottom"]) // 2)
                rasters.draw_text(out, f"person {k + 1}", b["left"], b["top"] - 10, scale=1)
            rasters.draw_text(out, f"persons detected: {len(found)}", 10, 30)
        return out

    return _each(frames, make, ["objects"])


def grey_of(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., :3].astype(float) @ [0.114, 0.587, 0.299] if pixels.shape[2] >= 3 else pixels[..., 0].astype(float)


def motion_and_scenes(frames: DataFrame, threshold: float = 28) -> DataFrame:
    """video_id, frame_idx, motion_x (mean column of what moved since the frame before, null if nothing did) and scene (the mean
    absolute difference to it is over the threshold). The first frame of a video has neither.

    Videos are cut into stretches of frames, so a long one is read by many tasks; a stretch also gets the frame before it."""
    stretch = 500
    rows = frames.select("video_id", "frame_idx", "image")
    own = rows.withColumns({"part": F.floor(F.col("frame_idx") / stretch), "lead": F.lit(False)})
    lead = rows.filter((F.col("frame_idx") + 1) % stretch == 0).withColumns({"part": F.floor(F.col("frame_idx") / stretch) + 1, "lead": F.lit(True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = None, None
        for pdf in batches:
            out = []
            for v, p, k, is_lead, image in zip(pdf["video_id"], pdf["part"], pdf["frame_idx"], pdf["lead"], pdf["image"], strict=True):
                now = grey_of(pixels_of(image))
                if (v, p) != at:
                    at, before = (v, p), None
                if not is_lead:
                    known = before is not None and before.shape == now.shape
                    out.append((v, k, rasters.motion_center(before, now) if known else None, bool(known and np.abs(now - before).mean() > threshold)))
                before = now
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "motion_x", "scene"]).astype({"motion_x": "Int32"})

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionAll(lead).repartition(parts, "video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx")
    kind = frames.schema["video_id"].dataType.simpleString()
    return dealt.mapInPandas(run, f"video_id {kind}, frame_idx bigint, motion_x int, scene boolean")


def png_files(frames: DataFrame, name: Column) -> DataFrame:
    """name, content: every frame as a PNG, for visarium.sources.writers.write_binary_files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [rasters.encode_png(pixels_of(x)) for x in pdf["image"]]})

    return frames.filter("image is not null").select(name.alias("name"), "image").mapInPandas(run, "name string, content binary")


def with_crop(frames: DataFrame, track: DataFrame) -> DataFrame:
    """Frames with the left edge of their own place in the crop track (video_id, frame_idx, left)."""
    return frames.join(track.select("video_id", "frame_idx", "left"), ["video_id", "frame_idx"])


def sequence_names(frames: DataFrame) -> Column:
    """00000.png, 00001.png ... in frame order of each video."""
    return F.format_string("%05d.png", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1)
