"""Following a subject through the frames of a video: scene cuts, missing runs, the centre to follow, smoothed tracks.

What each frame says by itself is set-based (windows and expressions, one shuffle by video); only the smoother, whose output
is its next input, runs through a video's frames in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.functions.geometry import CropConfig, TrackConfig, crop_left, smoothed
from visarium.functions.images import mean_difference


def _in_order():
    return Window.partitionBy("video_id").orderBy("frame_idx")


def scene_changes(frames: DataFrame, tile: Column, threshold: float = 28) -> DataFrame:
    """scene: the mean absolute difference to the frame before is over the threshold; the first frame is none."""
    return frames.withColumn("scene", F.coalesce(mean_difference(tile, F.lag(tile).over(_in_order())) > threshold, F.lit(False)))


def missing_runs(frames: DataFrame) -> DataFrame:
    """missing: frames without a face since the last face or scene cut, this one included; 0 on a face.

    frames: has_face, scene. A cut sets the run to 0 before its own frame counts."""
    reset = (F.col("has_face") | F.col("scene")).cast("int")
    island = F.sum(reset).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    df = frames.withColumn("_island", island)
    inside = Window.partitionBy("video_id", "_island").orderBy("frame_idx")
    count = F.sum((~F.col("has_face")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("missing", F.when(F.col("has_face"), 0).otherwise(count).cast("bigint")).drop("_island")


def crop_candidates(frames: DataFrame, tolerance: int = 15) -> DataFrame:
    """cand: where to look by priority - face; then, when missing long enough, person, object, motion; null is to hold.

    frames: face_x, person_x, object_x, motion_x (null where there is none), missing."""
    late = F.when(F.col("missing") >= tolerance, F.coalesce("person_x", "object_x", "motion_x"))
    return frames.withColumn("cand", F.coalesce("face_x", late))


def step_track(cand: float | None, cut: bool, at: int | None, middle: int, config: CropConfig) -> int:
    """The smoothed centre after one frame: a cut goes back to the middle, a missing candidate holds the last centre."""
    at = middle if cut or at is None else at
    return smoothed(at if cand is None or cand != cand else int(cand), at, config.alpha, config.deadzone, config.max_jump)


def step_person(center: float | None, at: int | None, width: int, config: TrackConfig = TrackConfig()) -> int:
    """The person tracker: it starts at the first centre; without one it takes the last position, or the middle if that is 0 or unset."""
    now = float(center) if center is not None and center == center else float(at or width // 2)
    return smoothed(now, now if at is None else at, config.alpha, config.deadzone, config.max_jump)


def fold_track(cand: np.ndarray, scene: np.ndarray, middle: int, config: CropConfig, start: int | None = None) -> Iterator[int]:
    at = start
    for c, cut in zip(cand, scene, strict=True):
        at = step_track(c, cut, at, middle, config)
        yield at


def _folded(frames: DataFrame, inputs: list[str], step: Callable[..., int]) -> DataFrame:
    """video_id, frame_idx, center: step(inputs..., last centre or None) over each video's frames in order.

    Videos are dealt and sorted by Spark and read as a stream, so a video of any length takes one batch's memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, at = object(), None
        for pdf in batches:
            out = []
            for v, *values in zip(pdf["video_id"], *(pdf[c] for c in inputs), strict=True):
                at = step(*values, at if v == video else None)
                video = v
                out.append(at)
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"], "center": np.array(out, "int32")})

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.select("video_id", "frame_idx", *inputs).repartition(parts, "video_id").sortWithinPartitions("video_id", "frame_idx")
    return ordered.mapInPandas(run, "video_id bigint, frame_idx bigint, center int")


def crop_track(frames: DataFrame, frame_width: int, config: CropConfig = CropConfig()) -> DataFrame:
    """video_id, frame_idx, center, left of every frame (with cand, scene)."""
    middle = frame_width // 2
    track = _folded(frames.withColumn("cand", F.col("cand").cast("double")), ["cand", "scene"], lambda c, cut, at: step_track(c, cut, at, middle, config))
    return track.withColumn("left", crop_left(F.col("center"), F.lit(frame_width), config.target_width))


def person_track(frames: DataFrame, width: int, config: TrackConfig = TrackConfig()) -> DataFrame:
    """video_id, frame_idx, center of every frame (with center_x, null without a person)."""
    return _folded(frames.withColumn("center_x", F.col("center_x").cast("double")), ["center_x"], lambda c, at: step_person(c, at, width, config))
