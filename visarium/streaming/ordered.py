"""The smoothed crop track of frames that come out of order: a frame waits for the one before it.

A video's state is the number of the next frame, the last centre, and a map of the frames that wait. When the next frame comes, it and
those that follow it without a gap leave in order, so micro-batches in any order give the track of the batch. A frame that never
comes is given up after a timeout: the track then goes on with the first frame that waits. What comes later for a frame that was
given up, or once more for one that has left, is not used.

It needs Spark's state store on RocksDB (spark.sql.streaming.stateStore.providerClass), as all queries of this kind do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from visarium.functions.geometry import CropConfig
from visarium.operators.track import step_track

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameOrder(StatefulProcessor):
    """State of one video. first: its first frame; timeout_ms: how long a gap may hold the others up."""

    def __init__(self, frame_width: int, config: CropConfig, first: int = 0, timeout_ms: int = 60_000):
        self.width, self.config, self.first, self.timeout = frame_width, config, first, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next bigint, center int")
        self.waiting = handle.getMapState("waiting", "frame_idx bigint", "cand double, scene boolean")

    def _left(self, key: tuple, skip: bool, now: int) -> Iterator[pd.DataFrame]:
        """The frames that can leave; skip: from the first that waits on."""
        nxt, center = self.at.get() if self.at.exists() else (self.first, None)
        if skip:
            nxt = min((k[0] for k in self.waiting.keys()), default=nxt)
        rows = []
        while self.waiting.containsKey((nxt,)):
            cand, scene = self.waiting.getValue((nxt,))
            center = step_track(cand, scene, center, self.width // 2, self.config)
            self.waiting.removeKey((nxt,))
            rows.append((nxt, center))
            nxt += 1
        self.at.update((nxt, center))
        # One timer while something waits, from the last time that anything moved.
        timers = list(self.handle.listTimers())
        if rows or not any(True for _ in self.waiting.keys()):
            for t in timers:
                self.handle.deleteTimer(t)
            timers = []
        if not timers and any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(now + self.timeout)
        if rows:
            idx, centers = zip(*rows, strict=True)
            half, most = self.config.target_width // 2, self.width - self.config.target_width
            c = np.array(centers, "int32")
            yield pd.DataFrame({"video_id": np.full(len(idx), key[0]), "frame_idx": np.array(idx, "int64"), "center": c, "left": np.minimum(np.maximum(0, c - half), most).astype("int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        nxt = self.at.get()[0] if self.at.exists() else self.first
        for pdf in rows:
            for k, cand, scene in zip(pdf["frame_idx"].tolist(), pdf["cand"].tolist(), pdf["scene"].tolist(), strict=True):
                if k >= nxt:
                    self.waiting.updateValue((k,), (None if cand is None or cand != cand else float(cand), bool(scene)))
        yield from self._left(key, False, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._left(key, True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        return


def smooth_unordered(frames: DataFrame, frame_width: int, config: CropConfig = CropConfig(), first: int = 0, timeout_ms: int = 60_000) -> DataFrame:
    """video_id, frame_idx, center, left of streamed frames (video_id bigint, frame_idx bigint, cand int, scene boolean) in any order; a
    video's frames are numbered from first on without gaps."""
    rows = frames.select("video_id", "frame_idx", frames["cand"].cast("double").alias("cand"), "scene")
    return rows.groupBy("video_id").transformWithStateInPandas(FrameOrder(frame_width, config, first, timeout_ms), "video_id bigint, frame_idx bigint, center int, left int", "Append", "ProcessingTime")
