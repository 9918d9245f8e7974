"""The boundary to neural models: a detector is a caller's class, loaded once in each worker, fed batches of frames.

No model is shipped and nothing is downloaded; `BrightBlocks` is a deterministic stand-in for tests.
"""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from visarium.functions.rasters import encode_png, quality

FACES = "array<struct<bbox:struct<left:int,top:int,right:int,bottom:int>,embedding:array<double>,confidence:double,score:double>>"
DETECTIONS = f"frame_name string, faces {FACES}"
#: Objects have a class, and a mask of shares (of any size) where the model segments.
OBJECTS = "array<struct<bbox:struct<left:int,top:int,right:int,bottom:int>,cls:int,confidence:double,mask:struct<height:int,width:int,share:array<float>>>>"


class Detector(ABC):
    """Loads lazily, detects on one frame, lets go of its model in the end."""

    _loaded = False
    #: The file that the frame now detected on comes from, for models that read files themselves.
    origin: str | None = None

    def load(self) -> None:
        if not self._loaded:
            self.load_model()
            self._loaded = True

    def detect(self, name: str, pixels: np.ndarray) -> list[dict[str, Any]]:
        """bbox (left, top, right, bottom), embedding or None, confidence and score or None of every face."""
        self.load()
        return self.detect_frame(name, pixels)

    def cleanup(self) -> None:
        if self._loaded:
            self.cleanup_model()
            self._loaded = False

    @abstractmethod
    def load_model(self) -> None: ...

    @abstractmethod
    def detect_frame(self, name: str, pixels: np.ndarray) -> list[dict[str, Any]]: ...

    def cleanup_model(self) -> None:
        return


class BrightBlocks(Detector):
    """Reports each quadrant brighter than the frame, with its mean colours as embedding."""

    def load_model(self) -> None:
        self.parts = 2

    def detect_frame(self, name: str, pixels: np.ndarray) -> list[dict[str, Any]]:
        h, w = pixels.shape[:2]
        out = []
        for y in range(self.parts):
            for x in range(self.parts):
                block = pixels[y * h // 2 : (y + 1) * h // 2, x * w // 2 : (x + 1) * w // 2]
                if block.size and block.mean() > pixels.mean():
                    out.append({"bbox": (x * w // 2, y * h // 2, (x + 1) * w // 2, (y + 1) * h // 2), "embedding": block.reshape(-1, block.shape[-1]).mean(0).astype(float).tolist(), "confidence": float(block.mean() / 255), "score": None})
        return out


_LOADED: dict[tuple, Detector] = {}


def _instance(where: str, options: tuple) -> Detector:
    """The worker's detector of module:Class."""
    if (where, options) not in _LOADED:
        module, _, name = where.partition(":")
        _LOADED[where, options] = getattr(importlib.import_module(module), name)(**dict(options))
    return _LOADED[where, options]


def _box(b: Any) -> dict[str, int]:
    return dict(zip(("left", "top", "right", "bottom"), map(int, b), strict=True))


def detect(frames: DataFrame, detector: str, first_only: bool = False, **options: Any) -> DataFrame:
    """frame_name, faces of frames (frame_name, image) by the detector module:Class with these options; first_only keeps the
    first face of a frame alone."""
    made = tuple(sorted(options.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _instance(detector, made)
        for pdf in batches:
            rows = []
            for name, image in zip(pdf["frame_name"], pdf["image"], strict=True):
                pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
                model.origin = image["origin"]
                found = model.detect(name, pixels)
                rows.append([{**f, "bbox": _box(f["bbox"])} for f in (found[:1] if first_only else found)])
            yield pd.DataFrame({"frame_name": pdf["frame_name"], "faces": rows})

    return frames.select("frame_name", "image").mapInPandas(run, DETECTIONS)


def detect_objects(frames: DataFrame, detector: str, **options: Any) -> DataFrame:
    """frame_name, objects of frames: what the detector reports as bbox, cls, confidence and, if it segments, mask (an array of
    shares, height x width)."""
    made = tuple(sorted(options.items()))

    def one(o: dict[str, Any]) -> dict[str, Any]:
        m = o.get("mask")
        mask = None if m is None else {"height": m.shape[0], "width": m.shape[1], "share": np.asarray(m, np.float32).ravel().tolist()}
        return {"bbox": _box(o["bbox"]), "cls": int(o["cls"]), "confidence": o.get("confidence"), "mask": mask}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _instance(detector, made)
        for pdf in batches:
            rows = []
            for name, image in zip(pdf["frame_name"], pdf["image"], strict=True):
                model.origin = image["origin"]
                rows.append([one(o) for o in model.detect(name, np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]))])
            yield pd.DataFrame({"frame_name": pdf["frame_name"], "objects": rows})

    return frames.select("frame_name", "image").mapInPandas(run, f"frame_name string, objects {OBJECTS}")


def crop_faces(faces: DataFrame, frames: DataFrame) -> DataFrame:
    """file_name, width, height, content (a PNG), quality: each face's pixels, cut at the frame's edges; empty crops go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, b, image in zip(pdf["file_name"], pdf["bbox"], pdf["image"], strict=True):
                pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
                cut = pixels[max(0, b["top"]) : b["bottom"], max(0, b["left"]) : b["right"]]
                if cut.size:
                    png = encode_png(cut)
                    out.append((name, cut.shape[1], cut.shape[0], png, quality(cut, len(png))))
            yield pd.DataFrame(out, columns=["file_name", "width", "height", "content", "quality"])

    return faces.join(frames.select("frame_name", "image"), "frame_name").select("file_name", "bbox", "image").mapInPandas(run, "file_name string, width int, height int, content binary, quality double")
