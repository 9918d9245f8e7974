"""Readers: image folders, decoded videos, task lists, cluster folders, crop tracks, the registry of models."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from visarium.functions import names

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
TASK = "frame_path string, face_location array<int>, all_face array<array<int>>, already_processed_face boolean"
FACE = "face_id bigint, filename string, frame_number int, embedding array<double>, bbox struct<left:int,top:int,right:int,bottom:int>, confidence double, source_file_path string"
CROP_TRACK = "fps int, width int, height int, crop_left array<int>"
#: Artefacts smaller than this are broken downloads.
LEAST_MODEL_BYTES = 5 * 1024 * 1024


def _named(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("name", F.element_at(F.split(path, "/"), -1))


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, content, name of the image files under a folder, whichever case their extension has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _named(files, "path").filter(names.is_image(F.col("name")))


def _decoded(spark: SparkSession, path: str, decoder: str | None) -> DataFrame:
    """name, image of every image file of a folder by its extension; image is null where it cannot be read."""
    if decoder is None:
        found = _named(spark.read.format("image").load(path), "image.origin").filter(names.is_image(F.col("name")))
        return found.select("name", F.when(F.col("image.height") > 0, F.col("image")).alias("image"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, fn = decoder.partition(":")
        read = getattr(importlib.import_module(module), fn)
        for pdf in batches:
            rows = []
            for origin, content in zip(pdf["path"], pdf["content"], strict=True):
                got = read(content)
                rows.append(None if got is None else (origin, got[0], got[1], got[2], 16 if got[2] == 3 else 0, got[3]))
            yield pd.DataFrame({"name": pdf["name"], "image": pd.Series(rows, dtype=object)})

    return read_files(spark, path).mapInPandas(decode, f"name string, image {IMAGE}")


def read_images(spark: SparkSession, path: str, decoder: str | None = None) -> DataFrame:
    """frame_name, image of the readable images of a folder.

    Spark's own decoder knows bmp, gif, jpeg, png and tiff. For others (webp) decoder names a caller's
    module:function(bytes) -> (height, width, channels, bytes) or None. What can't be read is in unreadable_images."""
    return _decoded(spark, path, decoder).filter("image is not null").select(F.col("name").alias("frame_name"), "image")


def unreadable_images(spark: SparkSession, path: str, decoder: str | None = None) -> DataFrame:
    """name of the image files (by extension) of a folder that read_images leaves out; Spark lists no empty files."""
    files = read_files(spark, path).select("name")
    return files.join(read_images(spark, path, decoder).select(F.col("frame_name").alias("name")), "name", "left_anti")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Frame tasks of a JSON list; what is missing counts as not processed, and has no face yet (null)."""
    return spark.read.schema(TASK).option("multiLine", True).json(path).withColumn("already_processed_face", F.coalesce("already_processed_face", F.lit(False)))


def read_clusters(spark: SparkSession, path: str, prefix: str = "person_") -> DataFrame:
    """cluster, path, length, name of the images that lie directly in folders of this prefix (not in folders below them)."""
    files = read_files(spark, path, recursive=True).drop("content")
    folder = F.element_at(F.split("path", "/"), -2)
    return files.withColumn("cluster", F.regexp_replace(folder, "^cluster=", "")).filter(F.col("cluster").startswith(prefix)).select("cluster", "path", "length", "name")


def read_crop_track(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx, left, fps, width, height of a crop track's JSON."""
    whole = spark.read.schema(CROP_TRACK).option("multiLine", True).json(path)
    return whole.select("fps", "width", "height", F.posexplode("crop_left").alias("frame_idx", "left"))


def read_metadata(spark: SparkSession, path: str, schema: str = FACE) -> DataFrame:
    """A stored table of faces: Parquet, or JSON (lines, or one list) of this schema by its ending."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if path.endswith(".json") and not _is_lines(spark, path) else spark.read.schema(schema).json(path) if path.endswith(".json") else spark.read.parquet(path)


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file or folder holds an object a line: then its first line begins with a brace."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return first is not None and first.value.lstrip().startswith("{")


def read_background(spark: SparkSession, path: str):
    """The pixels of one image file, for visarium.operators.render.isolate_persons. One image: it goes to the driver."""
    found = spark.read.format("image").load(path).filter("image.height > 0").select("image.*").first()
    if found is None:
        raise ValueError(f"no readable image at {path}")
    return np.frombuffer(found.data, np.uint8).reshape(found.height, found.width, found.nChannels)


def model_registry(spark: SparkSession, models: dict[str, str], files: DataFrame) -> DataFrame:
    """name, url, present, usable of the models: files (name, length) that are large enough."""
    known = spark.createDataFrame(sorted(models.items()), "name string, url string")
    return known.join(files.select("name", "length"), "name", "left").select("name", "url", F.col("length").isNotNull().alias("present"), F.coalesce(F.col("length") > LEAST_MODEL_BYTES, F.lit(False)).alias("usable"))


class FrameSource(DataSource):
    """Frames of a video through a caller's decoder, in parallel stretches: spark.read.format("frames").

    Options: path; decoder (module:function(path, start, stop) -> iterator of (index, height, width, channels, bytes));
    count (frames), or counter (module:function(path) -> frames); fps; stretch (frames of a partition); every (only each k-th frame is passed on).
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"video_id string, frame_idx bigint, ts_sec double, frame_name string, image {IMAGE}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FrameStream(dict(self.options))


class _Stretch(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Frames:
    """What reading once and reading on share: how many frames there are, and the frames of a stretch."""

    def __init__(self, options: dict):
        self.o = options

    def there(self) -> int:
        if "count" in self.o:
            return int(self.o["count"])
        module, _, fn = self.o["counter"].partition(":")
        return int(getattr(importlib.import_module(module), fn)(self.o["path"]))

    def stretches(self, start: int, stop: int) -> list[_Stretch]:
        step = int(self.o.get("stretch", 1000))
        return [_Stretch(k, min(stop, k + step)) for k in range(start, stop, step)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        module, _, fn = self.o["decoder"].partition(":")
        fps, every = float(self.o.get("fps", 25)), int(self.o.get("every", 1))
        for k, h, w, c, data in getattr(importlib.import_module(module), fn)(self.o["path"], partition.start, partition.stop):
            if k % every == 0:
                ts = round(k / fps, 2)
                yield self.o["path"], k, ts, f"frame_{ts}_{k:05d}.jpg", (self.o["path"], h, w, c, 16 if c == 3 else 0, data)


class _FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> list[_Stretch]:
        return self.stretches(0, self.there())


class _FrameStream(_Frames, DataSourceStreamReader):
    """A video that may still grow: its offset is the number of frames read. A micro-batch has the frames that have come since the last
    one's offset, which Spark keeps with the query's checkpoint, so a query that starts again goes on where it was."""

    def initialOffset(self) -> dict:
        return {"frame": int(self.o.get("start", 0))}

    def latestOffset(self) -> dict:
        return {"frame": max(self.there(), int(self.o.get("start", 0)))}

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        return self.stretches(start["frame"], end["frame"])

    def commit(self, end: dict) -> None:
        """Frames can be decoded again: nothing is let go."""


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The frames of a video as a stream (options as for FrameSource; counter tells how many there are by now; start: the first)."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("frames").options(path=path, **options).load()


def read_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of a video if count (its frames) or counter and a decoder are given, else of a folder of images."""
    if {"count", "counter"} & set(options):
        spark.dataSource.register(FrameSource)
        return spark.read.format("frames").options(path=path, **options).load()
    return read_images(spark, path, **options)
