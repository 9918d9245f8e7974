"""Relational operators on frames, detections, faces and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.functions import boxes, names
from visarium.operators.files import unique_names
from visarium.tables import stored

#: Up to so many rows a global number comes from one sorted task; beyond, from sorted ranges with offsets.
ONE_TASK = 200_000
#: Bytes of texts that frames meet by broadcast; bytes of them that a task is to have, so that Parquet writes each of its texts once.
TEXTS, TASK_TEXTS = 64 << 20, 256 << 10


def ordinal(df: DataFrame, order: list[Column], name: str, one_task: int = ONE_TASK) -> DataFrame:
    """The rows with their number from 0 in a total order.

    Many rows are dealt into sorted ranges and numbered within them; a range's first number is the count of those before."""
    if df.count() <= one_task:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordinal")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row a range: bounded by the number of partitions.
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def sample_frames(frames: DataFrame, every: int = 10) -> DataFrame:
    """Every k-th frame of each video."""
    return frames.filter(F.col("frame_idx") % every == 0)


def file_order(frames: DataFrame) -> DataFrame:
    """file_ord: a frame's place among its video's files sorted by name, which is not its index."""
    by_name = Window.partitionBy("video_id").orderBy("frame_name", "frame_idx")
    return frames.withColumn("file_ord", (F.row_number().over(by_name) - 1).cast("bigint"))


def explode_detections(detections: DataFrame) -> DataFrame:
    """A row per valid face of (frame_name, faces): face_id counts them by frame name and place, confidence falls back to
    score and then to 1."""
    flat = detections.select("frame_name", F.posexplode("faces").alias("pos", "face")).filter(boxes.valid(F.col("face.bbox")))
    rows = flat.select("frame_name", "pos", F.col("face.bbox").alias("bbox"), F.col("face.embedding").alias("embedding"), F.coalesce(F.col("face.confidence"), F.col("face.score"), F.lit(1.0)).alias("confidence"))
    return ordinal(rows, [F.col("frame_name"), F.col("pos")], "face_id").withColumn("file_name", names.face_name(F.col("frame_name"), F.col("face_id")))


def confident(df: DataFrame, least: float = 0.8) -> DataFrame:
    return df.filter(F.col("confidence") >= least)


def large_enough(df: DataFrame, width: Column, height: Column, least: float = 0.01) -> DataFrame:
    """Boxes that take this share of the image or more."""
    return df.filter(boxes.area_ratio(F.col("bbox"), width, height) >= least)


def of_classes(df: DataFrame, classes: list[int]) -> DataFrame:
    return df.filter(F.col("cls").isin(*classes))


def largest_face(df: DataFrame, by: str) -> DataFrame:
    """The largest box of each group; of equal ones the first place."""
    return df.groupBy(by).agg(F.max_by("bbox", F.struct(boxes.area(F.col("bbox")), -F.col("pos"))).alias("face_location"))


def first_face(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.min_by("bbox", "pos").alias("face_location"))


def all_faces(df: DataFrame, by: str) -> DataFrame:
    """All boxes of each group in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "bbox"))), lambda s: s["bbox"])
    return df.groupBy(by).agg(ordered.alias("all_face"))


def unprocessed(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks that are neither marked as done nor in the table of results."""
    open_ = tasks.filter(~F.coalesce("already_processed_face", F.lit(False)))
    return open_.join(done.select(key), key, "left_anti")


def label_summary(labels: DataFrame) -> DataFrame:
    """method, persons, unknown, mean_probability of each method's labels (-1 is noise)."""
    real = F.when(F.col("label") != -1, F.col("label"))
    return labels.groupBy("method").agg(F.count_distinct(real).alias("persons"), F.count_if(F.col("label") == -1).alias("unknown"), F.avg(F.when(F.col("label") != -1, F.col("probability"))).alias("mean_probability"))


def annotate(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """frames with what is drawn on each: (bbox, cluster) of the faces at exactly its video and frame, in face order."""
    drawn = F.transform(F.array_sort(F.collect_list(F.struct("face_id", "bbox", "cluster"))), lambda s: F.struct(s["bbox"].alias("bbox"), s["cluster"].alias("label")))
    marks = faces.groupBy("video_id", "frame_idx").agg(drawn.alias("annotations"))
    return frames.join(marks, ["video_id", "frame_idx"], "left")


def annotate_at(frames: DataFrame, marks: DataFrame, form: Column | None = None) -> DataFrame:
    """frames (with ts_sec) with the (bbox, label) of the marks (seconds, frame, bbox, label) at exactly their time, to the
    hundredth of a second, in order of frame and label: marks from annotated files know a time and no video. form, an expression of annotations, is worked out
    once for each time, before frames meet it, and stands in their place. Frames are then dealt out by time, in order: a task has few of the texts,
which are as long as faces are many, and a writer that keeps a dictionary writes each once and not for each frame."""
    drawn = F.transform(F.array_sort(F.collect_list(F.struct("frame", "label", "bbox"))), lambda s: F.struct(s["bbox"].alias("bbox"), s["label"].alias("label")))
    at = marks.groupBy(F.round("seconds", 2).alias("_at")).agg(drawn.alias("annotations"))
    if form is not None:
        at = stored(at.select("_at", form.alias("annotations")), "marks")
        size = at.agg(F.sum(F.octet_length("annotations"))).first()[0] or 0
        parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_TEXTS))
        spread = F.xxhash64(*(c for c, kind in frames.dtypes if not kind.startswith(("binary", "map"))))
        own = frames.withColumn("_at", F.round("ts_sec", 2))
        dealt = own.repartitionByRange(parts, "_at", spread).sortWithinPartitions("_at")
        return dealt.join(F.broadcast(at) if size <= TEXTS else at, "_at", "left").drop("_at")
    return frames.withColumn("_at", F.round("ts_sec", 2)).join(at, "_at", "left").drop("_at")


def existing(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The rows whose file is among the files (path)."""
    return rows.join(files.select(F.col("path").alias(path)), path, "left_semi")


def original_copies(faces: DataFrame, files: DataFrame) -> DataFrame:
    """cluster, path, target: the whole frame or image that each face (face_id, cluster, source_file_path) comes from, under a
    name of its own beside the cluster's faces. Faces whose file is not there have none."""
    own = faces.filter(F.col("source_file_path").isNotNull()).select("face_id", "cluster", F.col("source_file_path").alias("path"))
    named = existing(own, files).withColumn("name", names.original_name(F.element_at(F.split("path", "/"), -1), F.col("face_id")))
    return unique_names(named, "cluster", "face_id").select("cluster", "face_id", "path", F.concat(F.lit("original_frames/"), "target").alias("target"))


def objects_of(detections: DataFrame, classes: list[int] | None = None, least: float = 0.0) -> DataFrame:
    """frame_name, pos, bbox, cls, confidence of the detected objects (of some classes, this sure)."""
    flat = detections.select("frame_name", F.posexplode("objects").alias("pos", "o")).filter(F.coalesce("o.confidence", F.lit(1.0)) >= least)
    rows = flat.select("frame_name", "pos", F.col("o.bbox").alias("bbox"), F.col("o.cls").alias("cls"), F.coalesce("o.confidence", F.lit(1.0)).alias("confidence"))
    return rows if classes is None else of_classes(rows, classes)


def largest_file(files: DataFrame, by: str) -> DataFrame:
    """The largest file of each folder; of equal ones the first path."""
    return files.groupBy(by).agg(F.min_by("path", F.struct(-F.col("length"), F.col("path"))).alias("path"), F.max("length").alias("length"))
