"""A growing video as a stream, frames out of order, ordered containers, detections kept across runs."""

from __future__ import annotations

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from visarium.functions.geometry import CropConfig
from visarium.operators.detect import BrightBlocks
from visarium.operators.track import crop_track
from visarium.sources import cache, container, readers
from visarium.streaming.ordered import PROVIDER, smooth_unordered


def grown(path: str) -> int:
    """How many frames there are by now."""
    with open(path) as f:
        return int(f.read())


def pixels(path: str, start: int, stop: int):
    for k in range(start, stop):
        yield k, 2, 2, 3, bytes([k % 256] * 12)


def test_stream_of_a_growing_video_restarts(spark, tmp_path):
    video = tmp_path / "video"
    out, options = str(tmp_path / "out"), {"decoder": f"{__name__}:pixels", "counter": f"{__name__}:grown", "stretch": 4}

    def run(frames: int) -> None:
        video.write_text(str(frames))
        q = readers.read_stream(spark, str(video), **options).select("frame_idx", "frame_name").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for frames in (10, 10, 23, 31):  # each time it starts anew from its checkpoint
        run(frames)
        got = [r.frame_idx for r in spark.read.parquet(out).orderBy("frame_idx").collect()]
        assert got == list(range(frames))
    batch = readers.read_source(spark, str(video), **options).select("frame_idx", "frame_name").orderBy("frame_idx").collect()
    assert batch == spark.read.parquet(out).orderBy("frame_idx").collect()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    yield
    spark.conf.set(key, old)


SIGNALS = "video_id long, frame_idx long, cand int, scene boolean"


def play(spark, tmp_path, parts, **options):
    """The rows that a stream of these micro-batches gives."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SIGNALS).coalesce(1).write.mode("append").parquet(str(folder))
    name = f"t{random.randrange(10**9)}"
    q = smooth_unordered(stream, 500, CropConfig(target_width=200), **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    return q, name


def wait(spark, name, rows):
    """Until the stream has given so many rows: with timers it never has nothing to do."""
    for _ in range(180):
        if spark.table(name).count() >= rows:
            return
        threading.Event().wait(0.5)


def test_frames_out_of_order_wait(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = [(v, k, rng.choice([None, rng.randrange(500)]), rng.random() < 0.1) for v in (1, 2) for k in range(40)]
    config = CropConfig(target_width=200)
    want = crop_track(spark.createDataFrame(rows, SIGNALS), 500, config).select("video_id", "frame_idx", "center", "left").orderBy("video_id", "frame_idx").collect()
    mixed = list(rows)
    rng.shuffle(mixed)
    parts = [mixed[k : k + 27] for k in range(0, len(mixed), 27)] + [mixed[:5]]  # some come once more
    q, name = play(spark, tmp_path, parts)
    try:
        wait(spark, name, len(want))
        assert spark.table(name).orderBy("video_id", "frame_idx").collect() == want
    finally:
        q.stop()


def test_a_gap_is_given_up_after_the_timeout(spark, tmp_path, rocks):
    rows = [(1, k, 10 * k, False) for k in range(12) if k not in (3, 4)]
    q, name = play(spark, tmp_path, [rows], timeout_ms=4000)
    try:
        wait(spark, name, 3)
        first = [r.frame_idx for r in spark.table(name).orderBy("frame_idx").collect()]
        assert first[:3] == [0, 1, 2] and 3 not in first
        wait(spark, name, 10)  # the timer needs another micro-batch, which time alone brings
        assert [r.frame_idx for r in spark.table(name).orderBy("frame_idx").collect()] == [k for k in range(12) if k not in (3, 4)]
    finally:
        q.stop()


def frames(spark, n=57, parts=6):
    rows = [(v, k, f"{v}-{k}".encode() * (k % 5)) for v in ("a", "b") for k in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, container.SCHEMA).repartition(parts), sorted(rows)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_container_round_trip(spark, tmp_path, scheme):
    spark.dataSource.register(container.FrameContainer)
    path = f"{scheme}{tmp_path}/box"
    df, rows = frames(spark)
    df.write.format("frame_container").mode("append").save(path)
    back = spark.read.format("frame_container").option("stretch", 10).load(path)
    assert back.rdd.getNumPartitions() == 12
    assert [(r[0], r[1], bytes(r[2])) for r in back.collect()] == rows  # in order as it is
    spark.createDataFrame([("a", 3, b"new"), ("c", 0, b"")], container.SCHEMA).write.format("frame_container").mode("append").save(path)
    got = {(r[0], r[1]): bytes(r[2]) for r in back.sparkSession.read.format("frame_container").load(path).collect()}
    assert got["a", 3] == b"new" and got["c", 0] == b"" and len(got) == len(rows) + 1
    spark.createDataFrame([("z", 7, b"x")], container.SCHEMA).coalesce(1).write.format("frame_container").mode("overwrite").save(path)
    assert spark.read.format("frame_container").load(path).count() == 1
    runs = [n for n in os.listdir(tmp_path / "box") if n.startswith("run-")]
    assert len(runs) == 1 and len(os.listdir(tmp_path / "box" / runs[0])) == 2  # a part and its index


def test_container_of_a_failed_task(spark, tmp_path):
    spark.dataSource.register(container.FrameContainer)
    path = f"{tmp_path}/box"
    df, rows = frames(spark, 20)
    df.write.format("frame_container").mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = df.withColumn("content", F.when((F.col("video_id") == "b") & (F.col("frame_idx") == 19), F.raise_error(F.lit("no frame")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no frame"):
        bad.write.format("frame_container").mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    assert spark.read.format("frame_container").load(path).count() == len(rows)


class Counted(BrightBlocks):
    """Leaves a line for each image that it looks at."""

    def __init__(self, log: str):
        self.log = log

    def detect_frame(self, name, pixels):
        with open(self.log, "a") as f:
            f.write(f"{name}\n")
        return super().detect_frame(name, pixels)


def images(spark, kinds):
    rng = np.random.default_rng(0)
    some = [rng.integers(0, 255, (8, 8, 3), dtype=np.uint8).tobytes() for _ in range(20)]
    rows = [(f"f{k}", (f"p{k}", 8, 8, 3, 16, some[i])) for k, i in enumerate(kinds)]
    return spark.createDataFrame(rows, f"frame_name string, image {readers.IMAGE}")


def test_detections_are_kept_by_content(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")
    looked = lambda: len(open(log).read().split())
    first, told = cache.cached_detections(images(spark, [0, 1, 2, 1, 0]), f"{__name__}:Counted", path, "m1", log=log)
    assert told == {"new": 3, "added": 3} and first.count() == 5 and looked() == 3
    again, told = cache.cached_detections(images(spark, [2, 1, 0]), f"{__name__}:Counted", path, "m1", log=log)
    assert told == {"new": 0, "added": 0} and again.count() == 3 and looked() == 3
    by = {r.frame_name: r.faces for r in first.collect()}
    assert by["f1"] == by["f3"] == {r.frame_name: r.faces for r in again.collect()}["f1"]
    more, told = cache.cached_detections(images(spark, [0, 5, 6]), f"{__name__}:Counted", path, "m1", log=log)
    assert told["added"] == 2 and more.count() == 3 and looked() == 5
    _, told = cache.cached_detections(images(spark, [0]), f"{__name__}:Counted", path, "m2", log=log)
    assert told["added"] == 1  # another model
    assert cache.read_cache(spark, path, "m1").count() == 5
    assert cache.compact(spark, path, "m1") == 5 and cache.read_cache(spark, path, "m1").count() == 5
    assert len([x for x in os.listdir(f"{path}/model=m1") if x.startswith("batch=")]) == 1


def test_two_runs_at_once_leave_one_row_a_key(spark, tmp_path):
    """Both have looked at the cache before either has written."""
    path = str(tmp_path / "cache")
    rows = lambda keys: spark.createDataFrame([(k, []) for k in keys], f"key string, faces {cache.FACES}")
    assert [cache.add_batch(spark, rows("abc"), path, "m"), cache.add_batch(spark, rows("cab"), path, "m")] == [3, 0]
    assert cache.add_batch(spark, rows("bcd"), path, "m") == 3  # an overlapping run
    assert sorted(r.key for r in cache.read_cache(spark, path, "m").collect()) == list("abcd")
    assert cache.compact(spark, path, "m") == 4
    assert cache.add_batch(spark, rows(""), path, "m") == 0
