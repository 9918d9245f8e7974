"""Rasters and rendered frames against plain arithmetic, and whole video plans with stand-in models."""

from __future__ import annotations

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import png
from visarium import logs
from visarium.functions import images, rasters
from visarium.functions.geometry import CropConfig, resize_dims
from visarium.operators import detect, frames as fr, render
from visarium.operators.detect import Detector
from visarium.plans import pipelines as pl
from visarium.sources import readers, writers
from visarium.streaming.scan import detect_stream

IMAGE = readers.IMAGE


class Person(Detector):
    """One person: the bright columns, with a mask at half the frame's size."""

    def load_model(self) -> None:
        self.loads = 1

    def detect_frame(self, name, pixels):
        assert self.origin is not None
        grey = pixels[..., 0]
        x = np.flatnonzero(grey.max(0) > 100)
        if not len(x):
            return []
        mask = (grey[::2, ::2] > 100).astype(float)
        return [{"bbox": (x[0], 0, x[-1] + 1, len(pixels)), "cls": 0, "confidence": 0.9, "mask": mask}, {"bbox": (0, 0, 1, 1), "cls": 16, "confidence": 0.4}]


class Face(Detector):
    def load_model(self) -> None:
        self.loads = 1

    def detect_frame(self, name, pixels):
        x = np.flatnonzero(pixels[..., 0].max(0) > 100)
        return [{"bbox": (x[0], 1, x[-1] + 1, 5), "embedding": [1.0, float(k)], "confidence": 0.9, "score": None} for k in range(2)] if len(x) else []


def video(n=6, width=32, height=24, gap=()):
    out = []
    for k in range(n):
        x = np.full((height, width, 3), 20, np.uint8)
        if k not in gap:
            x[6:18, 4 + 2 * k : 12 + 2 * k] = 220
        out.append(x)
    return out


def frame_rows(spark, pixels, video_id=1):
    rows = [(video_id, k, round(k / 25, 2), f"frame_{k:05d}.png", tuple(render.image_of(x, f"f{k}").values())) for k, x in enumerate(pixels)]
    return spark.createDataFrame(rows, f"video_id long, frame_idx long, ts_sec double, frame_name string, image {IMAGE}")


def test_weights():
    for size, to in ((8, 8), (8, 3), (3, 8), (1, 5), (5, 1)):
        w = rasters.resize_weights(size, to)
        assert w.shape == (to, size) and w.sum(1) == pytest.approx(np.ones(to)) and (w >= 0).all()
    assert rasters.resize_weights(6, 3).tolist() == [[0.5, 0.5, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0], [0, 0, 0, 0, 0.5, 0.5]]
    assert rasters.resize_weights(2, 4).tolist() == [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]]
    x = np.random.default_rng(0).integers(0, 256, (9, 7))
    bell = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1**2))  # 0.3 * ((5 - 1) / 2 - 1) + 0.8
    pad = np.pad(x.astype(float), 2, mode="reflect")
    want = sum(a * b * pad[i : i + 9, j : j + 7] for i, a in enumerate(bell / bell.sum()) for j, b in enumerate(bell / bell.sum()))
    assert np.abs(rasters.blurred(x, 5) - want).max() <= 0.5 + 1e-9
    assert rasters.blurred(np.full((3, 2), 7), 51, 30).tolist() == [[7, 7]] * 3  # a bell far wider than the frame


def test_tiles_equal_frames(spark):
    x = np.random.default_rng(1).integers(0, 256, (5, 7))
    tile = F.array(*(F.lit(int(v)) for v in x.ravel()))
    got = spark.range(1).select(images.resized(tile, 7, 5, 4, 9).alias("r"), images.blurred(tile, 7, 5, 3).alias("b"), images.columns(tile, 7, 5, F.lit(6), 3).alias("c"), images.columns(tile, 7, 5, F.lit(-2), 3).alias("d")).first()
    assert (np.rint(got.r).reshape(9, 4) == rasters.resized(x, 4, 9)).all() and (np.rint(got.b).reshape(5, 7) == rasters.blurred(x, 3)).all()
    assert (np.array(got.c).reshape(5, 3) == x[:, 4:]).all() and (np.array(got.d).reshape(5, 3) == x[:, :3]).all()


def test_png_and_quality(spark):
    x = np.random.default_rng(2).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert rasters.encode_png(x) == png(x[..., ::-1])
    grey = np.floor(x.astype(float) @ [0.114, 0.587, 0.299] + 0.5).astype(int)
    tile = F.array(*(F.lit(int(v)) for v in grey.ravel()))
    assert rasters.quality(x, 12345) == pytest.approx(spark.range(1).select(images.face_quality(tile, 5, 6, F.lit(12345))).first()[0])


def test_drawing():
    x = np.zeros((9, 9, 3), np.uint8)
    rasters.draw_box(x, (2, 2, 6, 6), (1, 2, 3), 1)
    want = np.zeros((9, 9), bool)
    want[2, 2:7] = want[6, 2:7] = want[2:7, 2] = want[2:7, 6] = True
    assert ((x == (1, 2, 3)).all(2) == want).all()
    rasters.draw_box(x, (-5, -5, 50, 50))
    rasters.draw_text(x, "a_1 ?", -3, 40)
    rasters.draw_text(x, "l", 0, 5, (9, 9, 9), 1)
    assert (x[:5, 0] == 9).all() and (x[4, :3] == 9).all() and not (x[0, 1:3] == 9).any()
    rasters.draw_dot(x, 4, 4, 1, (7, 7, 7))
    assert ((x == 7).all(2).sum()) == 5


def test_flow_finds_a_shift():
    rng = np.random.default_rng(5)
    big = rasters.blurred(rng.integers(0, 256, (60, 90)), 9).astype(float) * 2
    u, v = rasters.flow(big[5:55, 5:80], big[4:54, 2:77])  # all moves right by 3 and down by 1
    assert np.median(u) == pytest.approx(3, abs=0.3) and np.median(v) == pytest.approx(1, abs=0.3)
    still = np.zeros((40, 60))
    assert rasters.motion_center(still, still) is None
    one, two = still.copy(), still.copy()
    one[15:25, 40:50], two[15:25, 42:52] = 200, 200
    assert 36 <= rasters.motion_center(one, two) <= 56


def test_vertical_render(spark):
    config = CropConfig(target_width=12, target_height=30, blur_kernel=5, blur_sigma=2)
    for h, w in ((24, 32), (24, 12), (60, 12), (30, 40), (8, 12)):
        x = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)
        cut = x[:, 3:15] if w > 15 else x
        got = render.vertical(cut, config)
        dims = spark.range(1).select(resize_dims(F.lit(cut.shape[1]), F.lit(h), config).alias("r")).first().r
        assert got.shape == (30, 12, 3)
        inner = rasters.resized(cut, dims.width, dims.height)
        y, at = (30 - dims.height) // 2, (12 - dims.width) // 2
        assert (got[y : y + dims.height, at : at + dims.width] == inner).all()
        if dims.blur:
            back = rasters.resized(rasters.blurred(cut, 5, 2), 12, 30)
            assert (got[:y] == back[:y]).all()
    frames = frame_rows(spark, video()).withColumn("left", F.col("frame_idx").cast("int") * 9 - 5)
    out = render.render_vertical(frames, config).orderBy("frame_idx").collect()
    assert [(r.image.height, r.image.width, r.image.nChannels, r.image.mode) for r in out] == [(30, 12, 3, 16)] * 6
    want = render.vertical(video()[1][:, 4:16], config)
    assert bytes(out[1].image.data) == want.tobytes()


def test_isolate_persons(spark):
    pixels = video(3, gap=(2,))
    frames = frame_rows(spark, pixels)
    mask = np.zeros((24, 32), bool)
    mask[6:18, 4:12] = True
    out = [render.pixels_of(r.image) for r in pl.isolate_video(frames, "tests.test_render:Person", render.BackgroundConfig(color=(1, 2, 3))).orderBy("frame_idx").collect()]
    assert (out[0][8:16, 6:10] == 220).all() and (out[0][:4] == (1, 2, 3)).all() and (out[2] == (1, 2, 3)).all()
    custom = np.full((2, 2, 3), 50, np.uint8)
    out = [render.pixels_of(r.image) for r in pl.isolate_video(frames, "tests.test_render:Person", render.BackgroundConfig(oval_fallback=True, oval_width=0.25, oval_height=0.25), custom).orderBy("frame_idx").collect()]
    assert (out[0][:4] == 50).all() and (out[2][12, 16] == 20).all() and (out[2][0, 0] == 50).all()
    blur = render.BackgroundConfig(blur=True, blur_kernel=5, always_oval=True, oval_width=0.1, oval_height=0.1, debug=True)
    out = render.pixels_of(pl.isolate_video(frames, "tests.test_render:Person", blur).filter("frame_idx = 0").first().image)
    assert (out[0] == rasters.blurred(pixels[0], 5)[0]).all()
    seen = render.pixels_of(pl.isolate_video(frames, "tests.test_render:Person", render.BackgroundConfig(debug=True)).filter("frame_idx = 0").first().image)
    assert (seen[20, 4] == (0, 255, 0)).all() and (seen[12, 8] == (0, 0, 255)).all()


def test_crop_video(spark):
    frames = frame_rows(spark, video(8, gap=(5,)))
    config = CropConfig(target_width=12, target_height=24, tolerance=2, deadzone=0, max_jump=100, alpha=1.0)
    moved = render.motion_and_scenes(frames, 200).orderBy("frame_idx").collect()
    assert moved[0].motion_x is None and not moved[0].scene and 4 <= moved[1].motion_x <= 20 and not any(r.scene for r in moved)
    cuts = render.motion_and_scenes(frames, 20).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in cuts if r.scene] == [5, 6]
    out = pl.crop_video(frames, "tests.test_render:Face", "tests.test_render:Person", 32, config).orderBy("frame_idx").collect()
    assert [r.left for r in out][:5] == [2, 4, 6, 8, 10] and out[0].image.width == 12 and out[0].image.height == 24


def test_stretches_see_the_frame_before(spark):
    rows = [(v, k, tuple(render.image_of(np.full((2, 2, 1), 200 * (k >= 500), np.uint8), "f").values())) for v in (1, 2) for k in range(495, 505)]
    got = render.motion_and_scenes(spark.createDataFrame(rows, f"video_id long, frame_idx long, image {IMAGE}")).filter("scene").collect()
    assert sorted((r.video_id, r.frame_idx) for r in got) == [(1, 500), (2, 500)]


def test_annotated_video(spark):
    frames = frame_rows(spark, video(4))
    files = spark.createDataFrame([("person_001", "scene_0.04_1_face_00001_(3, 12, 9, 20).png"), ("person_002", "odd.png")], "cluster string, name string")
    out = [render.pixels_of(r.image) for r in pl.annotate_video(frames, files).orderBy("frame_idx").collect()]
    want = video(4)
    rasters.draw_box(want[1], (3, 12, 9, 20))
    rasters.draw_text(want[1], "person_001", 3, 2)
    assert all((a == b).all() for a, b in zip(out, want, strict=True))


def test_frames_to_files(spark, tmp_path):
    frames = frame_rows(spark, video(3))
    named = frames.withColumn("file", render.sequence_names(frames))
    writers.write_binary_files(render.png_files(named, F.col("file")), str(tmp_path / "out"))
    back = readers.read_images(spark, str(tmp_path / "out")).orderBy("frame_name").collect()
    assert [r.frame_name for r in back] == ["00000.png", "00001.png", "00002.png"] and bytes(back[2].image.data) == video(3)[2].tobytes()
    assert (readers.read_background(spark, str(tmp_path / "out" / "00001.png")) == video(3)[1]).all()
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.txt").write_text("x")
        readers.read_background(spark, str(tmp_path / "none"))
    gone = frames.withColumn("image", F.when(F.col("frame_idx") != 1, F.col("image"))).withColumn("annotations", F.lit(None).cast("array<struct<bbox:struct<left:int,top:int,right:int,bottom:int>,label:string>>"))
    assert [r.image is None for r in render.draw_annotations(gone).orderBy("frame_idx").collect()] == [False, True, False]


def test_originals_beside_faces(spark, tmp_path):
    faces = spark.createDataFrame([(1, "person_000", "in/a.jpg"), (2, "person_000", "in/a.jpg"), (3, "person_001", "in/b.jpg"), (4, "unknown", None)], "face_id long, cluster string, source_file_path string")
    files = spark.createDataFrame([("in/a.jpg", bytearray(b"a")), ("in/c.jpg", bytearray(b"c"))], "path string, content binary")
    writers.write_originals(faces, files, str(tmp_path / "o"))
    assert sorted((r.cluster, r.target, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("person_000", "original_frames/a_face00001.jpg", b"a"), ("person_000", "original_frames/a_face00002.jpg", b"a")]


def test_detections_of_one_face_and_metadata(spark, tmp_path):
    frames = frame_rows(spark, video(2))
    assert detect.detect(frames, "tests.test_render:Face", first_only=True).select(F.size("faces")).distinct().collect() == [(1,)]
    objects = detect.detect_objects(frames, "tests.test_render:Person")
    assert [(r.cls, r.confidence) for r in fr.objects_of(objects, least=0.5).collect()] == [(0, 0.9)] * 2
    assert objects.first().objects[0].mask.height == 12 and objects.first().objects[1].mask is None
    (tmp_path / "list.json").write_text('[{"face_id": 1, "bbox": {"left": 1, "top": 2, "right": 3, "bottom": 4}}, {"face_id": 2}]')
    (tmp_path / "lines.json").write_text('{"face_id": 1}\n{"face_id": 2, "confidence": 0.5}\n')
    for name in ("list.json", "lines.json"):
        got = readers.read_metadata(spark, str(tmp_path / name))
        assert [r.face_id for r in got.orderBy("face_id").collect()] == [1, 2] and got.columns == [x.split()[0] for x in readers.FACE.split(", ")]


def counted(path):
    return 7


def test_counted_video(spark):
    df = readers.read_source(spark, "clip", decoder="tests.test_sources:decoder", counter="tests.test_render:counted", stretch=3)
    assert df.count() == 7


def test_all_methods_and_one_that_fails(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(0, 0.01, (10, 6)) for c in np.eye(6)[:3]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, failed = pl.cluster_methods(df, ["hdbscan", "adaptive_similarity", "similarity_threshold", "distance_threshold", "nothing"])
    got = {r.method: r.n for r in out.groupBy("method").agg(F.count_distinct("label").alias("n")).collect()}
    assert got == {"hdbscan": 3, "adaptive_similarity": 3, "similarity_threshold": 3, "distance_threshold": 3} and list(failed) == ["nothing"]


def test_logging(tmp_path):
    log = logs.setup_logging(logging.INFO, str(tmp_path / "x.log"), most_bytes=200, kept=2)
    logs.setup_logging(logging.INFO, str(tmp_path / "x.log"), most_bytes=200, kept=2)
    for k in range(20):
        log.info("line %d", k)
    assert len(list(tmp_path.glob("x.log*"))) == 3 and "line 19" in (tmp_path / "x.log").read_text()
    for h in [h for h in log.handlers if h.get_name() in ("console", str(tmp_path / "x.log"))]:
        log.removeHandler(h)
        h.close()


def test_detection_on_a_stream(spark, tmp_path):
    frames = frame_rows(spark, video(12, gap=(4,)))
    for k in range(3):
        frames.filter(F.col("frame_idx") % 3 == k).select("frame_idx", "frame_name", "image").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.select("frame_idx", "frame_name", "image").schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = detect_stream(stream, "tests.test_render:Face", every=2).writeStream.format("memory").queryName("faces").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.face_id, r.frame_name, r.file_name, r.bbox.left) for r in spark.table("faces").collect())
    assert got == [(1000 * k + pos, f"frame_{k:05d}.png", f"frame_{k:05d}_face_{1000 * k + pos:05d}.jpg", 4 + 2 * k) for k in (0, 2, 6, 8, 10) for pos in (0, 1)]
