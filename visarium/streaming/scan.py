"""Detection on a stream of frames: each micro-batch's frames are sampled, detected on and exploded as they come in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.functions import boxes, names
from visarium.operators.detect import detect
from visarium.operators.frames import sample_frames


def detect_stream(frames: DataFrame, detector: str, every: int = 10, **options: Any) -> DataFrame:
    """frame_name, pos, face_id, file_name, bbox, embedding, confidence of the valid faces on every k-th streamed frame
    (frame_idx, frame_name, image).

    A stream has no end to count to, so a face's id comes from its frame and its place there: frame_idx * 1000 + pos. No state
    is kept, so any output mode and any restart will do; a frame that is sent twice gives the same rows twice."""
    sampled = sample_frames(frames, every)
    found = detect(sampled.select(F.concat_ws("\u0000", F.col("frame_idx").cast("string"), "frame_name").alias("frame_name"), "image"), detector, **options)
    flat = found.select("frame_name", F.posexplode("faces").alias("pos", "face")).filter(boxes.valid(F.col("face.bbox")))
    whose = F.split("frame_name", "\u0000", 2)
    rows = flat.select(whose[1].alias("frame_name"), "pos", (whose[0].cast("long") * 1000 + F.col("pos")).alias("face_id"), F.col("face.bbox").alias("bbox"), F.col("face.embedding").alias("embedding"), F.coalesce("face.confidence", "face.score", F.lit(1.0)).alias("confidence"))
    return rows.withColumn("file_name", names.face_name(F.col("frame_name"), F.col("face_id")))
