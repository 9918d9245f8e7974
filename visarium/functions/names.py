"""File, frame and cluster names as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image files that a scan takes, in any case.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "webp"]
#: Fields of an annotated face file's name: seconds, frame, left, top, right, bottom, extension.
ANNOTATION = r"^.*?_(\d+(?:\.\d+)?)_(\d+)_face_\d+_\((\d+),\s*(\d+),\s*(\d+),\s*(\d+)\)\.(\w+)"


def timestamp(frame_idx: Column, fps: float = 25.0) -> Column:
    return F.round(frame_idx / F.lit(float(fps)), 2)


def frame_name(frame_idx: Column, fps: float = 25.0) -> Column:
    return F.format_string("frame_%s_%05d.jpg", timestamp(frame_idx, fps).cast("string"), frame_idx)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """With the dot; none for a name that begins or ends with its last dot."""
    return F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)$", 1)


def face_name(frame: Column, face_id: Column) -> Column:
    return F.format_string("%s_face_%05d.jpg", stem(frame), face_id)


def original_name(frame: Column, face_id: Column) -> Column:
    """The name under which a face's whole frame is kept beside it."""
    return F.format_string("%s_face%05d%s", stem(frame), face_id, suffix(frame))


def cluster_name(label: Column) -> Column:
    """person_007; noise (-1) is unknown."""
    return F.when(label == -1, "unknown").otherwise(F.format_string("person_%03d", label))


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$")


def sanitised(name: Column) -> Column:
    """Safe as a file name: signs that file systems refuse become _, white space and then dots at the ends go."""
    bare = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^\s+|\s+$", "")
    return F.regexp_replace(bare, r"^\.+|\.+$", "")


def annotation(name: Column) -> Column:
    """struct<seconds, frame, bbox, ext> of an annotated face file's name; null if it has another form."""
    part = lambda k: F.regexp_extract(name, ANNOTATION, k)
    sides = [part(k).cast("int").alias(n) for k, n in zip((3, 4, 5, 6), ("left", "top", "right", "bottom"), strict=True)]
    return F.when(name.rlike(ANNOTATION), F.struct(part(1).cast("double").alias("seconds"), part(2).cast("bigint").alias("frame"), F.struct(*sides).alias("bbox"), part(7).alias("ext")))


def seconds_of(name: Column) -> Column:
    """Seconds in a name that has them with a trailing s (12.34s), else the digits behind frame_, else null."""
    marked = F.regexp_extract(name, r"(\d+(?:\.\d+)?)s", 1)
    framed = F.regexp_extract(name, r"frame_(\d+)", 1)
    return F.when(marked != "", marked.cast("double")).when(framed != "", framed.cast("double"))


def clock(seconds: Column) -> Column:
    """mm:ss"""
    whole = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)
