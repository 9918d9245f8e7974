"""Token counts of a piece BPE by rank-synchronous array merging.

Texts are cut wherever two neighbouring bytes stand side by side in no piece: nothing merges across such a place. The
distinct chunks of a step become one ragged numpy array of symbols. In every round each chunk finds its pair of lowest
rank (the leftmost, of equal ones) and all chunks merge theirs at once; a chunk with that pair at several places merges
all of them, if no pair that this makes ranks as low - else only the first, as the sequential rule has it. Symbols that
survive are counted; characters without a piece count as their bytes.

The model file is read for its pieces, scores and kinds only. Defined results: null is empty; an empty text has no
tokens; null or repeated doc_ids are carried as they are; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.llm.arrays import binary_array, steps

LIMIT = 4096
#: Chunk counts that a worker holds, and the longest chunk it holds.
MEMO_CHUNKS, LONG = 1_000_000, 256
SPACE, BAR = "▁", "▁".encode()
NONE = np.iinfo(np.int64).max


class PieceCounter:
    """Counts tokens as the model's library does, from the model's pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix or any(p.type == 4 for p in model.pieces):
            raise ValueError("only byte-fallback BPE models with the identity normaliser and a prefix space are known here")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        # A symbol's number is its rank among pieces; characters that only occur inside pieces come behind.
        names = [p for p, _ in sorted(pieces, key=lambda x: -x[1])]
        self.pieces = len(names)
        names += sorted({c for p in names for c in p} - set(names))
        code = {p: k for k, p in enumerate(names)}
        self.n = len(names)
        keys, to = [], []
        for p in names[: self.pieces]:
            for k in range(1, len(p)):
                if p[:k] in code and p[k:] in code:
                    keys.append(code[p[:k]] * self.n + code[p[k:]])
                    to.append(code[p])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        points = np.array([ord(c) for c in code if len(c) == 1], np.int64)
        self.point_code = np.full(0x110000, -1, np.int32)
        self.point_code[points] = [code[chr(c)] for c in points]
        # Bytes that stand side by side in some piece, with the bar written as a space.
        self.joins = np.zeros((256, 256), bool)
        for p in names[: self.pieces]:
            b = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.joins[b[:-1], b[1:]] = True
        self.joins[:, 0x80:0xC0] = True  # never inside a character
        self.memo: dict[bytes, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges into, which is its rank; NONE where it merges not."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.to[at], NONE)

    def symbols(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and weight of every character, and the characters of each chunk."""
        text = b"".join(chunks).decode().replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter((len(c.decode()) for c in chunks), np.int64, len(chunks))
        code = self.point_code[points].astype(np.int64)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        return code, np.where((code >= 0) & (code < self.pieces), 1, width), size

    def merged(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each chunk."""
        sym, weight, size = self.symbols(chunks)
        who = np.arange(len(chunks))
        out = np.zeros(len(chunks), np.int64)
        while len(sym):
            first = np.cumsum(size) - size
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[first + size - 1] = NONE
            least = np.minimum.reduceat(rank, first)
            still = least < NONE
            if not still.all():
                out[who[~still]] = np.add.reduceat(weight, first)[~still]
                keep = np.repeat(still, size)
                sym, weight, rank = sym[keep], weight[keep], rank[keep]
                size, who, least = size[still], who[still], least[still]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            seq = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == least[seq])
            # Of places that overlap, every second from the left.
            run = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            many = np.bincount(seq[at], minlength=len(size)) > 1
            if many.any():
                at = at[self._safe(sym, rank, seq, at, many, first, size)]
            sym, weight = sym.copy(), weight.copy()
            sym[at], weight[at] = rank[at], 1
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            size = size - np.bincount(seq[at], minlength=len(size))
            sym, weight = sym[~gone], weight[~gone]
        return out

    def _safe(self, sym, rank, seq, at, many, first, size) -> np.ndarray:
        """Which places may merge now: all of a chunk if no new pair ranks as low as these, else its first."""
        new = rank[at]
        before_merged = np.concatenate([[False], (at[1:] == at[:-1] + 2) & (seq[at[1:]] == seq[at[:-1]])])
        left = np.where(before_merged, np.concatenate([[0], new[:-1]]), sym[np.maximum(at - 1, 0)])
        left_ok = at > first[seq[at]]
        right = sym[np.minimum(at + 2, len(sym) - 1)]
        right_ok = at + 2 < (first + size)[seq[at]]
        bad = (left_ok & (self.ranks(left, new) <= new)) | (right_ok & (self.ranks(new, right) <= new))
        risky = np.zeros(len(size), bool)
        risky[seq[at[bad]]] = True
        lead = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
        return lead | ~(risky & many)[seq[at]]

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        raw = data.tobytes()
        if BAR in raw:
            texts = [raw[a:b].replace(BAR, b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.diff(offs)
        full = np.flatnonzero(size > 0)
        if not len(full):
            return np.zeros(len(size), np.int64)
        data = np.insert(data, offs[full], 0x20)  # the space that the library puts first
        offs = np.concatenate([[0], np.cumsum(size + (size > 0))])
        mark = np.zeros(len(data) + 1, bool)
        mark[1:-1] = ~self.joins.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        mark[offs] = True
        at = np.flatnonzero(mark)
        coded = pc.dictionary_encode(binary_array(data, at))
        index, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
        get = self.memo.get
        counts = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(counts < 0)
        for k in range(0, len(new), 1 << 16):
            part = new[k : k + (1 << 16)]
            some = [chunks[j] for j in part]
            counts[part] = self.merged(some)
            self.memo.update((c, n) for c, n in zip(some, counts[part].tolist(), strict=True) if len(c) <= LONG)
        total = np.concatenate([[0], np.cumsum(counts[index])])
        where = np.searchsorted(at, offs)
        return total[where[1:]] - total[where[:-1]]


_LOADED: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = PieceCounter(model)
        for part, data, offs in steps(batches):
            n = _LOADED[model].count(data, offs)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offs)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return few.mapInArrow(scan, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
