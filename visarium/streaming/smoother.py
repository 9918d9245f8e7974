"""The smoothed crop track of a stream of frames: one small state a video, whatever its length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visarium.functions.geometry import CropConfig
from visarium.operators.track import fold_track


def smooth_stream(frames: DataFrame, frame_width: int, config: CropConfig = CropConfig()) -> DataFrame:
    """video_id, frame_idx, center, left of streamed frames (video_id bigint, frame_idx bigint, cand int, scene boolean).

    A video's frames must arrive in order from one micro-batch to the next; within one they are sorted."""
    half, most = config.target_width // 2, frame_width - config.target_width

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("frame_idx")
        start = state.get[0] if state.exists else None
        out = list(fold_track(pdf["cand"].to_numpy(float, na_value=np.nan), pdf["scene"].to_numpy(bool), frame_width // 2, config, start))
        if out:
            state.update((out[-1],))
        center = np.array(out, "int32")
        yield pd.DataFrame({"video_id": key[0], "frame_idx": pdf["frame_idx"].to_numpy(), "center": center, "left": np.minimum(np.maximum(0, center - half), most).astype("int32")})

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id bigint, frame_idx bigint, center int, left int", "center int", "append", GroupStateTimeout.NoTimeout)
