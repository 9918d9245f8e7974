"""Frames in order, as one container a video: a data source to write, with commit and abort, and to read.

df.write.format("frame_container") takes rows (video_id, frame_idx, content). Each task writes one part a video, with an index of its
frames beside it, in the run's folder; the commit writes a manifest that names the parts with their first and last frames, and only
then do they exist. A failed task leaves nothing that the manifest names; an abort removes the run's folder. Readers take stretches of
frame numbers: each looks into the indexes of the parts that reach into its stretch and gives their frames in order. The driver
holds a line for each part and video, no task a whole video.

Paths may lie in any store that pyarrow opens by its address (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "video_id string, frame_idx bigint, content binary"
#: Name of the manifest in a container's folder, and frame numbers of a stretch that one task reads.
MANIFEST, STRETCH = "manifest.json", 500


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> list[dict]:
    store, at = _store(path)
    if store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    """Parts of a task: video, name, number of frames, first and last."""

    parts: list[dict]


class FrameContainer(DataSource):
    """Options: path, a folder; stretch, frame numbers of a reading task."""

    @classmethod
    def name(cls) -> str:
        return "frame_container"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("stretch", STRETCH)))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        # The driver alone makes the run's folder: a task that starts behind an abort finds none.
        store, at = _store(path)
        store.create_dir(f"{at}/run-{self.run}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> _Written:
        """Frames may come in any order and are written as they come; the index beside them is in order."""
        store, at = _store(self.path)
        task, files = uuid.uuid4().hex, {}
        try:
            for row in iterator:
                video, frame, content = row[0], row[1], bytes(row[2])
                if video not in files:
                    name = f"run-{self.run}/part-{task}-{len(files)}"
                    files[video] = [name, store.open_output_stream(f"{at}/{name}"), 0, []]
                own = files[video]
                own[1].write(content)
                own[3].append((frame, own[2], len(content)))
                own[2] += len(content)
        except BaseException:
            for name, out, _, _ in files.values():
                out.close()
                store.delete_file(f"{at}/{name}")
            raise
        parts = []
        for video, (name, out, _, frames) in files.items():
            out.close()
            index = np.array(sorted(frames), "<i8")
            with store.open_output_stream(f"{at}/{name}.index") as f:
                f.write(index.tobytes())
            parts.append({"video": video, "part": name, "frames": len(index), "first": int(index[0, 0]), "last": int(index[-1, 0])})
        return _Written(parts)

    def commit(self, messages: list[_Written | None]) -> None:
        new = [p for m in messages if m for p in m.parts]
        parts = new if self.overwrite else _manifest(self.path) + new
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/.{MANIFEST}-{self.run}") as f:
            f.write(json.dumps(parts).encode())
        store.move(f"{at}/.{MANIFEST}-{self.run}", f"{at}/{MANIFEST}")
        self._clean(parts, self.overwrite)

    def abort(self, messages: list[_Written | None]) -> None:
        """All that the run has written goes; tasks that still run find no folder to write to."""
        store, at = _store(self.path)
        if store.get_file_info(f"{at}/run-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/run-{self.run}")

    def _clean(self, parts: list[dict], all_runs: bool) -> None:
        """Removes what no manifest names: parts of this run's failed and repeated tasks, and behind an overwrite other runs."""
        store, at = _store(self.path)
        named = {p["part"] for p in parts}
        runs = {x.split("/")[0] for x in named}
        for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if all_runs and info.base_name.startswith("run-") and info.base_name not in runs:
                store.delete_dir(info.path)
        for info in store.get_file_info(fs.FileSelector(f"{at}/run-{self.run}", allow_not_found=True)):
            if f"run-{self.run}/{info.base_name.removesuffix('.index')}" not in named:
                store.delete_file(info.path)


class _Run(InputPartition):
    def __init__(self, video: str, first: int, last: int, parts: list[str]):
        self.video, self.first, self.last, self.parts = video, first, last, parts


class _Reader(DataSourceReader):
    """A partition is a stretch of a video's frame numbers; of a frame that was written twice the one written last counts."""

    def __init__(self, path: str, stretch: int):
        self.path, self.stretch = path, stretch

    def partitions(self) -> list[_Run]:
        by: dict[str, list[dict]] = {}
        for p in _manifest(self.path):
            by.setdefault(p["video"], []).append(p)
        out = []
        for video, parts in sorted(by.items()):
            for k in range(min(p["first"] for p in parts), max(p["last"] for p in parts) + 1, self.stretch):
                reach = [p["part"] for p in parts if p["first"] < k + self.stretch and p["last"] >= k]
                if reach:
                    out.append(_Run(video, k, k + self.stretch - 1, reach))
        return out or [_Run("", 0, -1, [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        store, at = _store(self.path)
        found: dict[int, tuple[str, int, int]] = {}
        for part in partition.parts:
            with store.open_input_stream(f"{at}/{part}.index") as f:
                index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
            lo, hi = np.searchsorted(index[:, 0], (partition.first, partition.last + 1))
            found |= {k: (part, offset, size) for k, offset, size in index[lo:hi].tolist()}
        files = {}
        try:
            for k in sorted(found):
                part, offset, size = found[k]
                if part not in files:
                    files[part] = store.open_input_file(f"{at}/{part}")
                files[part].seek(offset)
                yield partition.video, k, files[part].read(size)
        finally:
            for f in files.values():
                f.close()
