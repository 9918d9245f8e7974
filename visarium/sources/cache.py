"""Detections kept across runs, by content: what a model has said of an image once is not asked again.

A row's key is the SHA-256 of an image's pixels and shape; rows lie by model. A run detects on one image of each key that the cache lacks and
adds a batch: written beside the cache, then moved into place under a name that its keys make. A run that fails leaves no batch, one
that is repeated finds its keys, and two equal ones at once make the same batch, which the second then drops. Runs that
overlap may add a key twice; of such rows the one in the first batch by name counts, wherever the cache is read.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visarium.operators.detect import FACES, detect
from visarium.tables import delete, stored

ROWS = f"key string, faces {FACES}, model string, batch string"


def content_key(image: Column) -> Column:
    """Hex SHA-256 of an image's shape and pixels; its place and name do not count."""
    shape = F.concat_ws("x", image["height"].cast("string"), image["width"].cast("string"), image["nChannels"].cast("string"))
    return F.sha2(F.concat(shape.cast("binary"), image["data"]), 256)


def read_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """key, faces of a model: one row a key. No rows where nothing is kept yet."""
    try:
        rows = spark.read.schema(ROWS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ROWS)
    own = rows.filter(F.col("model") == model)
    return own.groupBy("key").agg(F.min_by("faces", "batch").alias("faces"))


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder into place unless something is there already."""
    jvm = spark._jvm.org.apache.hadoop.fs
    a, b = jvm.Path(source), jvm.Path(target)
    fs = b.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(b.getParent())
    # Should the target come up in between, the folder lands inside of it, under a name that readers pass over.
    return not fs.exists(b) and bool(fs.rename(a, b))


def add_batch(spark: SparkSession, rows: DataFrame, path: str, model: str) -> int:
    """Adds rows (key, faces), one a key, as a batch named by its keys; how many rows were added."""
    kept = stored(rows.select("key", "faces"), "batch")
    n, mark, other = kept.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("key"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("key", F.lit(1)))).first()
    if not n:
        return 0
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    kept.write.parquet(staged)
    if not _moved(spark, staged, f"{path.rstrip('/')}/model={model}/batch={n}-{mark:x}-{other & (1 << 64) - 1:x}"):
        delete(spark, staged)
        return 0
    return n


def cached_detections(frames: DataFrame, detector: str, path: str, model: str | None = None, **options: Any) -> tuple[DataFrame, dict[str, int]]:
    """frame_name, faces of frames (frame_name, image) by the detector module:Class, from the cache at path where it has them; and
    how many images were new. model tells detectors, their options and versions apart (a name for folders)."""
    spark = frames.sparkSession
    name = model or detector.replace(":", ".")
    keyed = frames.select("frame_name", "image", content_key(F.col("image")).alias("key"))
    keys = stored(keyed.select("frame_name", "key"), "keys")
    lacking = stored(keys.groupBy("key").agg(F.min("frame_name").alias("frame_name")).join(read_cache(spark, path, name).select("key"), "key", "left_anti"), "lacking")
    # One image of each new key: the first frame that has it.
    first = keyed.join(lacking, ["key", "frame_name"], "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("frame_name"), "image")
    found = detect(first, detector, **options).select(F.col("frame_name").alias("key"), "faces")
    added = add_batch(spark, found, path, name)
    return keys.join(read_cache(spark, path, name), "key").select("frame_name", "faces"), {"new": lacking.count(), "added": added}


def compact(spark: SparkSession, path: str, model: str) -> int:
    """Writes a model's rows as one batch, one row a key, and removes the batches it is made of; how many rows. Not while
    other runs add to it."""
    folder = f"{path.rstrip('/')}/model={model}"
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = [s.getPath().toString() for s in fs.listStatus(jvm.Path(folder)) if s.getPath().getName().startswith("batch=")]
    if len(old) < 2:
        return read_cache(spark, path, model).count()
    whole = stored(read_cache(spark, path, model), "compact")
    add_batch(spark, whole, path, model)
    n = whole.count()
    kept = {s.getPath().toString() for s in fs.listStatus(jvm.Path(folder))} - set(old)
    if kept:
        for p in old:
            delete(spark, p)
    return n
