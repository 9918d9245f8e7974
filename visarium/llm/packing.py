"""Bounded-space online packing of token sequences.

Each partition keeps OPEN windows. A document's ids (with the end id) first fill whole windows; what is left goes to the open
window that it fills best. If none has room, the fullest window is filled up with the piece's beginning and emitted, and
a new one opens. So a window leaves a partition full, and pieces are cut only when nothing fits. At the end
the open windows of MERGE partitions are poured together into full windows and one that stays open, and those of MERGE
such groups again, until MERGE or fewer are left; only the last window is padded.

Defined results: null text is a document of the end id alone; null doc_id is carried as it is; repeated rows are
packed each; an empty table gives no sequences; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visarium.llm.arrays import steps
from visarium.llm.chunks import encoder
from visarium.llm.tables import stored

#: Tokens of a window, windows open at a time, partitions whose leftovers are merged in one task.
WINDOW, OPEN, MERGE = 1024, 32, 8

PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, seq bigint, offset bigint, part bigint, ids binary"


def _short(ids: np.ndarray) -> bytes:
    """Two bytes an id where all are small enough, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


class Packer:
    """Open windows of one partition. Finished windows' pieces wait in `rows`; open ones' ids are held."""

    def __init__(self, part: int, window: int = WINDOW, open_windows: int = OPEN):
        self.part, self.window, self.most = part, window, open_windows
        self.rows: list[tuple] = []
        self.seq = 0
        self.open: list[list[tuple]] = []
        self.room: list[int] = []

    def _emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.seq, at, self.part, _short(ids) if keep_ids else None))
            at += len(ids)
        self.seq += 1

    def add(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        whole = len(ids) // self.window * self.window
        for k in range(0, whole, self.window):
            self._emit([(doc, start + k, ids[k : k + self.window], total)])
        if whole < len(ids):
            self.place(doc, start + whole, ids[whole:], total)

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        best, n = -1, len(ids)
        for k, room in enumerate(self.room):
            if room >= n and (best < 0 or room < self.room[best]):
                best = k
        if best < 0 and len(self.open) < self.most:
            self.open.append([])
            self.room.append(self.window)
            best = len(self.open) - 1
        if best < 0:  # none fits: the fullest is filled with the piece's beginning and goes
            best = min(range(len(self.room)), key=self.room.__getitem__)
            cut = self.room[best]
            self.open[best].append((doc, start, ids[:cut], total))
            self._emit(self.open[best])
            self.open[best], self.room[best] = [(doc, start + cut, ids[cut:], total)], self.window - (n - cut)
            return
        self.open[best].append((doc, start, ids, total))
        self.room[best] -= n
        if not self.room[best]:
            self._emit(self.open.pop(best))
            self.room.pop(best)

    def close(self) -> None:
        """Open windows leave as they are, with their ids; seq is negative."""
        done = self.seq
        for k, pieces in enumerate(self.open):
            self.seq = -1 - k
            self._emit(pieces, True)
        self.open, self.room, self.seq = [], [], done

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in PIECE]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, PIECE, strict=True)], names=[n for n, _ in PIECE])


def _merge_group(window: int, last: bool):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Leftover pieces of some partitions in one stream: windows are filled by cutting, the last stays open."""
        pdf = pdf.sort_values(["part", "seq", "offset"], ascending=[True, False, True])
        out = Packer(int(pdf["part"].min()), window, 1)
        for doc, start, n, ids, total in zip(pdf["doc_id"], pdf["start"], pdf["length"], pdf["ids"], pdf["doc_tokens"], strict=True):
            out.place(None if pd.isna(doc) else int(doc), int(start), np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"), int(total))
        if last:
            for pieces in out.open:
                out._emit(pieces)
        else:
            out.close()
        return out.batch().to_pandas(integer_object_nulls=True)

    return merge


def _sequence_id() -> Column:
    """Round, partition and number in it in one long: rounds are few, partitions under 2^24, windows of one under 2^36."""
    return F.shiftleft(F.col("turn").cast("long"), 60).bitwiseOR(F.shiftleft("part", 36)).bitwiseOR(F.col("seq"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN, merge: int = MERGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(tokenizer), Packer(TaskContext.get().partitionId(), window, open_windows)
        for part, data, offs in steps(batches):
            ids, n = enc.encode(data, offs)
            end = np.array([end_id], np.uint32)
            at = 0
            for doc, k in zip(part.column("doc_id").to_pylist(), n.tolist(), strict=True):
                out.add(doc, np.concatenate([ids[at : at + k], end]))
                at += k
            yield out.batch()
        out.close()
        yield out.batch()

    pieces = stored(few.mapInArrow(scan, SCHEMA), "pieces")
    done = [pieces.filter("seq >= 0")]
    open_, parts = pieces.filter("seq < 0"), 1
    # Leftovers are a bounded number of windows of each partition; each round merges those of `merge` partitions.
    left, turn = open_.agg(F.countDistinct("part")).first()[0], 0
    done = [d.withColumn("turn", F.lit(0)) for d in done]
    while left:
        turn += 1
        parts *= merge
        last = left <= merge
        group = F.floor(F.col("part") / parts)
        merged = stored(open_.groupBy(group.alias("g")).applyInPandas(_merge_group(window, last), SCHEMA), "merged")
        done.append(merged.filter("seq >= 0").withColumn("turn", F.lit(turn)))
        open_ = merged.filter("seq < 0")
        left = 0 if last else open_.agg(F.countDistinct("part")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", _sequence_id().alias("sequence_id"), "offset")
