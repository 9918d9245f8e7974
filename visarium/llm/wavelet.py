"""Token ids in wavelet-matrix files: succinct bit planes with rank and select, one compressed file per shard.

A file holds the ids of consecutive documents. Plane 0 is the top bit of every id in document order; each next plane is
the next bit, with the ids stably parted by the bit above: zeros first. Ones are counted at every 512 bits, so rank is
a table entry and a population count, and select a binary search. That gives the id at a place, the number of times an id
occurs in a stretch, and where its k-th occurrence stands. The planes are compressed in chunks of CHUNK bits: an access
reads the index and unpacks one chunk of each plane.

File: magic "WVM2", then as little-endian numbers: documents (u4), ids (u8), planes (u1), bytes of the packed index (u8);
index (zstandard): ids before each document and behind the last (u8 each), zeros of each plane (u8), ones before each 512
bits of each plane and behind its last (u4), packed bytes of each chunk of each plane (u4); then the chunks, plane by
plane (zstandard each; bits packed, lowest first).

write_tokens() deals documents in ascending doc_id into shards, by ranges of doc_id, and writes a file a shard (a shard
of more than FILE_TOKENS ids, which only a doc_id with very many rows makes, in several) through Spark's own writer, a row a
file, so any file system will do and a lost executor's files are written anew. Where a shard begins is summed up by
Spark in two levels; no list of files comes to the driver. Defined results: null text is a document with the end id only; null doc_id
comes first; of rows that repeat a doc_id any order; empty tables give no files; further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visarium.llm.arrays import steps
from visarium.llm.chunks import encoder
from visarium.llm.tables import shared_dir, stored

MAGIC, HEAD = b"WVM2", struct.Struct("<4sIQBQ")
#: Ids of a file, text bytes of a shard, bits between two entries of a rank table, bits of a chunk, chunks that an open file keeps.
FILE_TOKENS, SHARD_BYTES, BLOCK, CHUNK, KEPT = 8 << 20, 16 << 20, 512, 1 << 18, 64
#: Up to so many shards, the table of where each begins (12 bytes a shard) is broadcast; shards whose sums one task adds up.
BROADCAST_SHARDS, TOGETHER = 1 << 20, 1024
#: Text bytes of a step: of more text at a time fewer chunks are distinct.
STEP = 8 << 20


def encode_file(ids: np.ndarray, lens: np.ndarray) -> bytes:
    """The file of the documents whose ids stand one after another; lens: the ids of each."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, ranks, sizes, chunks = [], [], [], []
    pack = zstandard.ZstdCompressor(level=1).compress
    for p in range(planes - 1, -1, -1):
        bit = (seq & (1 << p)) != 0
        raw = np.packbits(bit, bitorder="little")
        ranks.append(_ranks(raw))
        zeros.append(len(seq) - int(ranks[-1][-1]))
        packed = [pack(raw[k : k + CHUNK // 8].tobytes()) for k in range(0, len(raw), CHUNK // 8)]
        sizes += map(len, packed)
        chunks += packed
        if p:  # by places, which is three times as fast as by masks
            seq = np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))])
    index = pack(b"".join([np.concatenate([[0], np.cumsum(lens)]).astype("<u8").tobytes(), np.array(zeros, "<u8").tobytes(), np.concatenate(ranks).astype("<u4").tobytes(), np.array(sizes, "<u4").tobytes()]))
    return b"".join([HEAD.pack(MAGIC, len(lens), len(ids), planes, len(index)), index, *chunks])


def _ranks(raw: np.ndarray) -> np.ndarray:
    """Ones before each block of a packed plane, and all."""
    ones = np.add.reduceat(np.bitwise_count(raw).astype(np.int64), np.arange(0, len(raw), BLOCK // 8)) if len(raw) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


class WaveletFile:
    """Token access, counts and occurrences from the bytes of one file."""

    def __init__(self, raw: bytes):
        magic, docs, self.n, self.planes, size = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        blocks, self._many = -(-self.n // BLOCK) + 1, -(-self.n // CHUNK)
        parts = [8 * (docs + 1), 8 * self.planes, 4 * self.planes * blocks, 4 * self.planes * self._many]
        index = zstandard.ZstdDecompressor().decompress(raw[HEAD.size : HEAD.size + size], max_output_size=sum(parts))
        at = np.concatenate([[0], np.cumsum(parts)])
        part = lambda k, kind: np.frombuffer(index[at[k] : at[k + 1]], kind).astype(np.int64)
        self.offsets, self.zeros = part(0, "<u8"), part(1, "<u8").tolist()
        self.ranks = part(2, "<u4").reshape(self.planes, blocks)
        self._raw, self._at = raw, HEAD.size + size + np.concatenate([[0], np.cumsum(part(3, "<u4"))])
        self._open: dict[int, np.ndarray] = {}

    def _chunk(self, plane: int, chunk: int) -> np.ndarray:
        """The bits of one chunk of a plane, packed."""
        k = plane * self._many + chunk
        if k not in self._open:
            if len(self._open) >= KEPT:
                del self._open[next(iter(self._open))]
            packed = self._raw[self._at[k] : self._at[k + 1]]
            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=CHUNK // 8), np.uint8)
        return self._open[k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._chunk(plane, i // CHUNK)[i % CHUNK >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        out = int(self.ranks[plane, i // BLOCK])
        if i % BLOCK:
            bits = self._chunk(plane, i // CHUNK)
            lo, hi = (i - i % BLOCK) % CHUNK >> 3, i % CHUNK >> 3
            out += int(np.bitwise_count(bits[lo:hi]).sum())
            if i & 7:
                out += (int(bits[hi]) & ((1 << (i & 7)) - 1)).bit_count()
        return out

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            bit = self._bit(p, i)
            out = out << 1 | bit
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def rank(self, token: int, i: int) -> int:
        """How often the id stands among the first i places."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id stands in places lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number k, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            i = self._select_bit(p, i - self.zeros[p], 1) if token >> (self.planes - 1 - p) & 1 else self._select_bit(p, i, 0)
        return i

    def _select_bit(self, plane: int, k: int, bit: int) -> int:
        """The place of one or zero number k of a plane."""
        lo, hi = 0, self.n
        while lo < hi:  # least i with more than k such bits among the first i + 1
            mid = (lo + hi) >> 1
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def occurrences(self, token: int) -> list[int]:
        """All places of the id."""
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every id, from the lowest plane up: each plane says how the one below was parted."""
        seq = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._chunk(p, k) for k in range(self._many)]) if self.n else np.zeros(0, np.uint8)
            bit = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(seq)
            out[np.flatnonzero(~bit)] = seq[: self.zeros[p]]
            out[np.flatnonzero(bit)] = seq[self.zeros[p] :] | (1 << (self.planes - 1 - p))
            seq = out
        return seq


KIND = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("payload", pa.binary())])
SCHEMA = "shard int, part int, before bigint, n_tokens bigint, doc_ids binary, known binary, payload binary"


def _shards(df: DataFrame, shard_bytes: int) -> int:
    """Range partitions for the input, from the planner's size of it; the session's number where that is unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usual if size > 1 << 55 else max(usual, -(-size // shard_bytes))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files as rows (shard, part, before - ids of the shard in files before -, n_tokens, doc_ids, known, payload) at
    the path; returns the table read back."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        part, before, total, held = 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            ids, n, own, known = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[shard], [part], [before], [len(ids)], [own.astype("<i8").tobytes()], [np.packbits(known).tobytes()], [encode_file(ids, n)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, KIND, strict=True)], schema=KIND)

        for b, data, offs in steps(batches, most=STEP):
            ids, n = enc.encode(data, offs)
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            col = b.column("doc_id")
            held.append((ids, n, col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)))
            total += len(ids)
            if total >= file_tokens:
                yield flush()
                part, before, total, held = part + 1, before + total, 0, []
        if held:
            yield flush()

    order = F.asc_nulls_first("doc_id")
    files = few.repartitionByRange(_shards(docs, shard_bytes), order).sortWithinPartitions(order).mapInArrow(scan, SCHEMA)
    files.write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def shard_starts(files: DataFrame, together: int = TOGETHER) -> DataFrame:
    """shard, first: ids of all shards before each. Shards are added up in stretches, and the stretches' sums in one small task."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("stretch", F.floor(F.col("shard") / together))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sums.select("shard", "stretch", before(Window.partitionBy("stretch").orderBy("shard")).alias("a"))
    across = sums.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", before(Window.orderBy("stretch")).alias("b"))
    return inside.join(across, "stretch").select("shard", (F.col("a") + F.col("b")).alias("first"))


def read_tokens(files: DataFrame, broadcast: int = BROADCAST_SHARDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    first = stored(shard_starts(files.select("shard", "n_tokens")), "starts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                f = WaveletFile(b.column("payload")[r].as_py())
                ids, offs = f.all().astype("<u4").tobytes(), f.offsets
                n = np.diff(offs)
                known = np.unpackbits(np.frombuffer(b.column("known")[r].as_py(), np.uint8), count=len(n)).view(bool)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.frombuffer(b.column("doc_ids")[r].as_py(), "<i8"), mask=~known), "start": pa.array(offs[:-1] + b.column("first")[r].as_py() + b.column("before")[r].as_py()), "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(offs[:-1], offs[1:], strict=True)], pa.int64()),
                })

    return files.join(F.broadcast(first) if first.count() <= broadcast else first.hint("merge"), "shard").mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark: SparkSession = docs.sparkSession
    return read_tokens(write_tokens(docs, tokenizer, end_id, f"{shared_dir(spark).rstrip('/')}/visarium/tokens-{uuid.uuid4().hex}"))
