"""Readers, writers, detectors and the streaming smoother, round trip."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from visarium import tables
from visarium.functions.geometry import CropConfig
from visarium.operators import detect, frames as fr, track
from visarium.plans import pipelines as pl
from visarium.sources import readers, writers
from visarium.streaming.smoother import smooth_stream


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def two_bytes(content):
    return (content[0], content[1], 1, content[2:]) if len(content) > 1 else None


def decoder(path, start, stop):
    for k in range(start, stop):
        yield k, 2, 2, 3, bytes([k % 256] * 12)


def test_images_and_detection(spark, tmp_path):
    d = tmp_path / "frames"
    d.mkdir()
    for k in range(3):
        x = np.zeros((4, 4, 3), np.uint8)
        x[:2, 2:] = 200
        (d / f"frame_0.{k}_0000{k}.PNG").write_bytes(png(x))
    (d / "broken.png").write_bytes(b"no image")
    (d / "notes.txt").write_text("x")
    assert readers.read_files(spark, str(d)).count() == 4
    images = readers.read_source(spark, str(d))
    assert images.count() == 3
    found = detect.detect(images, "visarium.operators.detect:BrightBlocks")
    faces = fr.explode_detections(found).orderBy("face_id").collect()
    assert len(faces) == 3 and faces[0].bbox.left == 2 and faces[0].confidence == 200 / 255
    crops = detect.crop_faces(fr.explode_detections(found), images)
    assert {(r.width, r.height, bytes(r.content)) for r in crops.collect()} == {(2, 2, png(np.full((2, 2, 3), 200, np.uint8)))} and all(0 < r.quality < 1 for r in crops.collect())
    writers.write_binary_files(crops.select(F.col("file_name").alias("name"), "content"), str(tmp_path / "faces"))
    assert len(list((tmp_path / "faces").iterdir())) == 3
    whole = pl.identify(images, "visarium.operators.detect:BrightBlocks", "leaders")
    assert {r.cluster for r in whole.collect()} == {"person_000"}


def test_video_source(spark):
    df = readers.read_source(spark, "clip", decoder="tests.test_sources:decoder", count=25, stretch=10, every=5, fps=25)
    rows = df.orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == [0, 5, 10, 15, 20] and rows[1].frame_name == "frame_0.2_00005.jpg" and rows[2].image.data == bytes([10] * 12)


def test_clusters_and_metadata(spark, tmp_path):
    faces = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "b.jpg"), (4, "c.jpg")], "face_id long, name string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "face_id long, label int")
    writers.write_clusters(faces, labels, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert sorted((r.cluster, r.target) for r in back.collect()) == [("person_000", "a.jpg"), ("person_000", "a_001.jpg"), ("person_001", "b.jpg"), ("unknown", "c.jpg")]
    for name in ("m.json", "m.parquet"):
        writers.write_metadata(faces, str(tmp_path / name))
        assert [r.face_id for r in readers.read_metadata(spark, str(tmp_path / name)).orderBy("face_id").collect()] == [1, 2, 3, 4]
    for folder in ("person_001", "unknown_2", "person_001/original_frames"):
        (tmp_path / "t" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / folder / "x.jpg").write_bytes(b"1")
    assert [r.cluster for r in readers.read_clusters(spark, str(tmp_path / "t")).collect()] == ["person_001"]
    assert [r.cluster for r in readers.read_clusters(spark, str(tmp_path / "t"), "unknown").collect()] == ["unknown_2"]


def test_tasks_and_checkpoint(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"frame_path": "a"}, {"frame_path": "b", "already_processed_face": True}, {"frame_path": "c", "face_location": [1, 2, 3, 4]}]))
    tasks = readers.read_tasks(spark, str(tmp_path / "t.json"))
    assert [r.already_processed_face for r in tasks.orderBy("frame_path").collect()] == [False, True, False]
    out = str(tmp_path / "done")
    work = lambda df: df.select("frame_path", F.lit(1).alias("n"))
    assert writers.process_new(spark, tasks.limit(1), "frame_path", out, work).count() == 1
    assert writers.process_new(spark, tasks, "frame_path", out, work).count() == 3
    assert writers.process_new(spark, tasks, "frame_path", out, work).count() == 3
    other = str(tmp_path / "other")
    writers.process_new(spark, tasks.limit(1), "frame_path", other, lambda df: df.select(F.lit(1).alias("n")))
    with pytest.raises(AnalysisException):  # results that lack the key are no first run
        writers.process_new(spark, tasks, "frame_path", other, lambda df: df.select(F.lit(1).alias("n")))
    assert spark.read.parquet(other).count() == 1


def test_scope_deletes_its_tables(spark):
    from pathlib import Path

    folder = Path(tables.shared_dir(spark), "visarium")
    before = set(folder.glob("*")) if folder.exists() else set()
    with tables.scope(spark):
        inner = tables.stored(spark.range(5), "inner")
        with tables.scope(spark):
            tables.stored(spark.range(7), "gone")
            outer = tables.stored(inner.filter("id > 1"), "outer", keep=True)
        assert outer.count() == 3 and not [p for p in folder.glob("gone-*") if p not in before]
    assert set(folder.glob("*")) == before


def test_images_beyond_sparks_decoder(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(bytes([2, 1, 9, 9]))
    (tmp_path / "b.webp").write_bytes(b"x")
    assert [r.name for r in readers.unreadable_images(spark, str(tmp_path)).orderBy("name").collect()] == ["a.webp", "b.webp"]
    some = readers.read_images(spark, str(tmp_path), decoder="tests.test_sources:two_bytes").collect()
    assert [(r.frame_name, r.image.height, r.image.width, r.image.data) for r in some] == [("a.webp", 2, 1, bytes([9, 9]))]
    assert [r.name for r in readers.unreadable_images(spark, str(tmp_path), "tests.test_sources:two_bytes").collect()] == ["b.webp"]


def test_crop_track_json(spark, tmp_path):
    track_ = spark.createDataFrame([(1, k, 10 * k) for k in range(5)], "video_id long, frame_idx long, left int")
    writers.write_crop_track(track_, str(tmp_path / "j"), 25, 1920, 1080)
    (tmp_path / "one.json").write_text(json.dumps({"fps": 25, "width": 9, "height": 8, "crop_left": [3, 4]}))
    assert [(r.frame_idx, r.left) for r in readers.read_crop_track(spark, str(tmp_path / "one.json")).collect()] == [(0, 3), (1, 4)]
    assert spark.read.json(str(tmp_path / "j")).first().crop_left == [0, 10, 20, 30, 40]


def test_registry(spark):
    files = spark.createDataFrame([("a.pt", 6 * 1024 * 1024), ("b.pt", 10)], "name string, length long")
    got = {r.name: (r.present, r.usable) for r in readers.model_registry(spark, {"a.pt": "u", "b.pt": "u", "c.pt": "u"}, files).collect()}
    assert got == {"a.pt": (True, True), "b.pt": (True, False), "c.pt": (False, False)}


def test_naming(spark):
    files = spark.createDataFrame([("person_000", "p/1.jpg", 5), ("person_000", "p/2.jpg", 9), ("person_001", "p/3.jpg", 1), ("person_002", "p/4.jpg", 1)], "cluster string, path string, length long")
    ask = lambda df: df.withColumn("reply", F.when(F.col("cluster") != "person_002", F.lit('{"character_name": "A: B"}')))
    assert sorted(tuple(r) for r in pl.name_clusters(files, ask).collect()) == [("person_000", "p/2.jpg", "A__B"), ("person_001", "p/3.jpg", "A__B_0")]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(v, k, int(rng.integers(0, 500)) if rng.random() < 0.6 else None, bool(rng.random() < 0.05 and k)) for k in range(60) for v in (1, 2)]
    schema = "video_id long, frame_idx long, cand int, scene boolean"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    config = CropConfig(target_width=200)
    q = smooth_stream(stream, 500, config).writeStream.format("memory").queryName("track").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("track").select("video_id", "frame_idx", "center", "left").collect())
    want = sorted(tuple(r) for r in track.crop_track(spark.createDataFrame(rows, schema), 500, config).collect())
    assert got == want
