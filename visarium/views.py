"""Stand-ins for frames, faces and detections over the tables at hand: the same definitions as in the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visarium.functions import boxes, names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a video, its events in time order are the frames, at 25 a second."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").withColumn("frame_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return ev.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", "frame_idx", names.timestamp(F.col("frame_idx")).alias("ts_sec"), names.frame_name(F.col("frame_idx")).alias("frame_name"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a face with a made-up box; every seventh has no embedding."""
    v = F.col("vec_id")
    left, top = (v * 37) % 1600, (v * 53) % 800
    box = boxes.box(left, top, left + v % 97 - 3, top + v % 89 - 3)
    return table(spark, sf_dir, "embeddings").select(v.alias("face_id"), (v % 40).alias("video_id"), (v % 50).alias("frame_idx"), "label", box.alias("bbox"), F.when(v % 7 != 0, F.col("embedding").cast("array<double>")).alias("embedding"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces as a detector reports them: a list for each frame, confidence or score or neither."""
    f = faces(spark, sf_dir).withColumn("frame_name", F.format_string("frame_%02d.jpg", "frame_idx"))
    conf = F.when(F.col("face_id") % 3 != 0, (F.col("face_id") % 100) / 100.0)
    score = F.when(F.col("face_id") % 5 != 0, (F.col("face_id") % 50) / 50.0)
    row = F.struct("face_id", F.struct("bbox", "embedding", conf.alias("confidence"), score.alias("score")).alias("f"))
    return f.withColumn("row", row).groupBy("frame_name").agg(F.transform(F.array_sort(F.collect_list("row"), lambda a, b: (a["face_id"] - b["face_id"]).cast("int")), lambda r: r["f"]).alias("faces"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as a model of many classes reports them."""
    f = faces(spark, sf_dir).withColumn("frame_name", F.format_string("frame_%02d.jpg", "frame_idx"))
    o = F.struct("bbox", (F.col("label") % 4).cast("int").alias("cls"), ((F.col("face_id") % 100) / 100.0).alias("confidence"))
    return f.groupBy("frame_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("face_id", o.alias("o"))), lambda a, b: (a["face_id"] - b["face_id"]).cast("int")), lambda r: r["o"]).alias("objects"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in twelve clusters, with quality and time."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), F.format_string("person_%03d", F.col("vec_id") % 12).alias("cluster"), e.alias("embedding"), F.element_at(e, 1).alias("quality"), (F.col("vec_id") % 80).cast("double").alias("ts"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces clustered by their label, with time."""
    return people(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), "label"), "face_id").withColumn("cluster", F.format_string("person_%03d", "label")).drop("label")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 luma tile of every vector, in videos of forty."""
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("video_id"), F.floor(F.col("vec_id") / 40).alias("frame_idx"), e.alias("tile"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detectors say of each frame: a click is a face, a view a person, a purchase an object, an error a cut."""
    f, x = frames(spark, sf_dir), F.floor("value").cast("int")
    kind = F.col("event_type")
    return f.withColumns({"face_x": F.when(kind == "click", x), "person_x": F.when(kind == "view", x), "object_x": F.when(kind == "purchase", x), "motion_x": F.lit(None).cast("int"), "scene": (kind == "error") & (F.col("frame_idx") > 0), "has_face": kind == "click"})


#: The same views for the oracle.
SQL = {
    "frames": """frames AS (
        SELECT video_id, event_id, event_type, value, frame_idx, round(frame_idx / 25.0::DOUBLE, 2) AS ts_sec,
            printf('frame_%s_%05d.jpg', CAST(round(frame_idx / 25.0::DOUBLE, 2) AS VARCHAR), frame_idx) AS frame_name
        FROM (SELECT user_id AS video_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events))""",
    "faces": """faces AS (
        SELECT vec_id AS face_id, vec_id % 40 AS video_id, vec_id % 50 AS frame_idx, label,
            (vec_id * 37) % 1600 AS l, (vec_id * 53) % 800 AS t, (vec_id * 37) % 1600 + vec_id % 97 - 3 AS r, (vec_id * 53) % 800 + vec_id % 89 - 3 AS b,
            CASE WHEN vec_id % 7 <> 0 THEN embedding::DOUBLE[] END AS embedding FROM embeddings)""",
    "people": """people AS (
        SELECT vec_id AS face_id, printf('person_%03d', vec_id % 12) AS cluster, embedding::DOUBLE[] AS embedding, embedding[1]::DOUBLE AS quality, (vec_id % 80)::DOUBLE AS ts FROM embeddings)""",
    "timed": """timed AS (
        SELECT vec_id AS face_id, printf('person_%03d', label) AS cluster, embedding::DOUBLE[] AS embedding, embedding[1]::DOUBLE AS quality, (vec_id % 80)::DOUBLE AS ts FROM embeddings)""",
    "tiles": """tiles AS (
        SELECT vec_id, vec_id % 40 AS video_id, vec_id // 40 AS frame_idx,
            list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, floor((x + 0.5) * 255)))::INT) AS tile FROM embeddings)""",
    "leaders": """
        ord AS (SELECT i, coalesce(nb, []) AS nb, row_number() OVER (ORDER BY o) AS k FROM low),
        r(k, leaders, leader) AS (
            SELECT 1::BIGINT, [k], k FROM ord WHERE k = 1
            UNION ALL
            SELECT o.k, CASE WHEN len(list_intersect(r.leaders, o.nb)) = 0 THEN list_append(r.leaders, o.k) ELSE r.leaders END,
                CASE WHEN len(list_intersect(r.leaders, o.nb)) = 0 THEN o.k ELSE list_min(list_intersect(r.leaders, o.nb)) END
            FROM r JOIN ord o ON o.k = r.k + 1)""",
}
