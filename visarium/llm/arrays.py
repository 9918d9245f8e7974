"""Texts of an Arrow batch as one numpy byte array, and ragged arithmetic on it."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: Text bytes that one step of a vectorised operator holds at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts one after another, and the len+1 offsets of the texts in it. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most so many text bytes each, with the slice's bytes and offsets.

    Behind each batch, and at the end, the worker gives back the memory that it has freed: workers wait for their next task
    beside others of the executor."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = as_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi
        del batch, data, offs
        give_back()
    give_back()


def give_back() -> None:
    """Frees what the allocators hold for later."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def take_ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every piece, one piece after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, cut at the texts' ends."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = np.zeros(len(mask) + 1, bool)
    ends[1:-1] = mask[:-1] & ~mask[1:]
    ends[-1] = mask[-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    both = cut[mask[cut] & mask[cut - 1]]
    begins[both] = True
    ends[both] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def binary_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The pieces between the offsets, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
