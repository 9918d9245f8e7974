"""Writers: cluster folders, crop tracks, binary files, results in portions."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visarium.functions.names import cluster_name
from visarium.operators.files import unique_names
from visarium.operators.frames import original_copies


def write_clusters(faces: DataFrame, labels: DataFrame, path: str, order: str = "face_id") -> None:
    """Faces (face_id, name, ...) in folders by cluster, joined to their labels by face_id; names that meet get suffixes."""
    named = faces.join(labels.select("face_id", "label"), "face_id").withColumn("cluster", cluster_name(F.col("label")))
    unique_names(named, "cluster", order).write.mode("overwrite").partitionBy("cluster").parquet(path)


def write_originals(faces: DataFrame, files: DataFrame, path: str) -> None:
    """The whole frames or images (files: path, content) that faces (face_id, cluster, source_file_path) come from, in folders by
    cluster, each under the face's own name."""
    named = original_copies(faces, files)
    named.join(files.select("path", "content"), "path").select("cluster", "target", "path", "content").write.mode("overwrite").partitionBy("cluster").parquet(path)


def write_crop_track(track: DataFrame, path: str, fps: int, width: int, height: int) -> None:
    """One JSON object a video: fps, width, height and the left edges in frame order."""
    lefts = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "left"))), lambda s: s["left"])
    track.groupBy("video_id").agg(lefts.alias("crop_left")).select("video_id", F.lit(fps).alias("fps"), F.lit(width).alias("width"), F.lit(height).alias("height"), "crop_left").write.mode("overwrite").partitionBy("video_id").json(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """A table of faces: JSON if the path ends so, else Parquet."""
    (df.write.mode("overwrite").json if path.endswith(".json") else df.write.mode("overwrite").parquet)(path)


def write_binary_files(files: DataFrame, folder: str) -> None:
    """Each row (name, content) as a file of a folder that all executors share. A repeated task writes the same files again."""

    def save(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            to = os.path.join(folder, r.name)
            with open(f"{to}.{os.getpid()}.tmp", "wb") as f:
                f.write(r.content)
            os.replace(f.name, to)

    files.select("name", "content").foreachPartition(save)


def process_new(spark: SparkSession, tasks: DataFrame, key: str, path: str, work) -> DataFrame:
    """Runs work on the tasks that have no result yet and appends theirs; the results so far are the checkpoint.

    Results that lack the key, or cannot be read, are an error: only where nothing is stored yet are all tasks run."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = None
    if done is not None:
        tasks = tasks.join(done.select(key), key, "left_anti")
    work(tasks).write.mode("append").parquet(path)
    return spark.read.parquet(path)
