"""SimHash near-duplicates by anchor-point covering.

The anchors are the product of two binary Golay codes on bits 0-22 and 23-45 of the fingerprint: perfect codes of
covering radius 3, so every fingerprint has one home anchor within radius 3 on either half. A fingerprint is replicated to
every anchor within covering radius plus threshold: distances d1 and d2 on the halves with
max(0, d1 - 3) + max(0, d2 - 3) <= threshold. If x and y differ in at most that many bits, x has a replica at y's home
(each differing bit moves x by one on one half only), so comparing replicas with the homes of an anchor finds every link.

Copies first collapse to distinct fingerprints. Each anchor's links leave it as a spanning forest: one link less
than fingerprints, never all pairs. Anchors with many homes look neighbours up by value instead of comparing pairs.
Components then meet over the links.

Defined results: null and wordless text has fingerprint zero, linked like any other; a null doc_id is a row like the
others but never names a component unless all are null; repeated rows all come back; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.llm.arrays import steps
from visarium.llm.components import components
from visarium.llm.tables import stored

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Generator polynomial of the binary Golay code, and the bits of a half.
GOLAY, HALF = 0b110001110101, 23
#: Above so many homes in an anchor, and hashes held of one text at a time.
MANY_HOMES, HASHES = 512, 1 << 20
#: Replicas of one partition, about.
REPLICAS = 4_000_000
#: The column that a filter adds for a while beside those that come in.
ROW = "__visarium_row"


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the XXH64 of all word shingles of a text."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    begins, ends = begins[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, HASHES):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[k : k + HASHES], ends[k : k + HASHES], strict=True)], np.uint64)
        for j in range(0, len(h), 4096):
            ones += np.unpackbits(h[j : j + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > n)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": _signed(fps)})

    return few.mapInArrow(scan, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, fp bigint")


class Covering:
    """For each syndrome of a half, the error patterns that lead to code words within 3 + threshold, and their excess over 3."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold
        near = np.array([sum(1 << b for b in bits) for w in range(4 + threshold) for bits in combinations(range(HALF), w)], np.int64)
        syn, weight = self.syndrome(near), np.bitwise_count(near).astype(np.int64)
        order = np.lexsort((near, weight, syn))
        near, syn, weight = near[order], syn[order], weight[order]
        self.error, self.excess = near, np.maximum(0, weight - 3)
        self.first = np.searchsorted(syn, np.arange(1 << 11))
        # Patterns of a syndrome are sorted by excess: how many there are up to each excess.
        self.upto = np.zeros((threshold + 1, 1 << 11), np.int64)
        for t in range(threshold + 1):
            self.upto[t] = np.bincount(syn[self.excess <= t], minlength=1 << 11)

    @staticmethod
    def syndrome(x: np.ndarray) -> np.ndarray:
        """Remainder of each 23-bit word by the generator."""
        r = x.astype(np.int64).copy()
        for bit in range(HALF - 1, 10, -1):
            r ^= ((r >> bit) & 1) * (GOLAY << (bit - 11))
        return r

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, anchor, home of all replicas of the fingerprints."""
        m = (1 << HALF) - 1
        lo, hi = (fp & np.uint64(m)).astype(np.int64), ((fp >> np.uint64(HALF)) & np.uint64(m)).astype(np.int64)
        s1, s2 = self.syndrome(lo), self.syndrome(hi)
        rows, out, home = [], [], []
        for t in range(self.threshold + 1):  # excess t exactly on the first half, the rest at most on the second
            below = self.upto[t - 1][s1] if t else np.zeros(len(fp), np.int64)
            n1, n2 = self.upto[t][s1] - below, self.upto[self.threshold - t][s2]
            n = n1 * n2
            row = np.repeat(np.arange(len(fp)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            e1 = self.error[self.first[s1[row]] + below[row] + k // n2[row]]
            e2 = self.error[self.first[s2[row]] + k % n2[row]]
            rows.append(row)
            out.append((lo[row] ^ e1) | ((hi[row] ^ e2) << HALF))
            home.append((np.bitwise_count(e1) <= 3) & (np.bitwise_count(e2) <= 3))
        return np.concatenate(rows), np.concatenate(out), np.concatenate(home)


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = _find(parent, x), _find(parent, y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _masks(threshold: int) -> np.ndarray:
    """All 64-bit words of up to so many bits, but none."""
    masks = {0}
    for _ in range(threshold):
        masks |= {m | 1 << k for m in masks for k in range(64)}
    return np.array(sorted(masks - {0}), np.uint64)


def anchor_links(fp: np.ndarray, home: np.ndarray, first: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found at the anchors; first: where each anchor's rows begin, and the end. Homes come first in an anchor."""
    size = np.diff(first)
    homes = np.add.reduceat(home.astype(np.int64), first[:-1]) if len(size) else size
    found: list[tuple[int, int]] = []
    few = np.flatnonzero((homes > 0) & (homes <= MANY_HOMES) & (size > 1))
    # Anchors with few homes: each row against each home of its anchor, a bounded number of pairs at a time.
    cost = homes[few] * size[few]
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(cost[lo:]), 1 << 22, "right")) + lo)
        part = few[lo:hi]
        c = cost[lo:hi]
        g = np.repeat(np.arange(len(part)), c)
        k = np.arange(len(g)) - np.repeat(np.cumsum(c) - c, c)
        n = homes[part][g]
        x, y = fp[first[part][g] + k // n], fp[first[part][g] + k % n]
        ok = (np.bitwise_count(x ^ y) <= threshold) & (x < y)
        # A row after the homes with x > y is found from the other side, at the other's home.
        found += _forest(x[ok], y[ok])
        lo = hi
    many = np.flatnonzero(homes > MANY_HOMES)
    masks = _masks(threshold) if len(many) else None
    for a in many:
        at_home = np.sort(fp[first[a] : first[a] + homes[a]])
        rows = fp[first[a] : first[a + 1]]
        links = []
        for m in masks:
            near = rows ^ m
            at = np.minimum(np.searchsorted(at_home, near), len(at_home) - 1)
            ok = (at_home[at] == near) & (rows < near)
            links.append(np.stack([rows[ok], near[ok]]))
            if sum(x.shape[1] for x in links) > 1 << 20:
                links = [np.array(_forest(*np.concatenate(links, 1)), np.uint64).reshape(-1, 2).T]
        found += _forest(*np.concatenate(links, 1))
    out = np.array(found, np.uint64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def links_of(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b of links between the distinct fingerprints (column fp): enough of them to connect all that is linked."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Covering(threshold)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fp), 8192):
                row, anchor, home = cover.anchors(fp[k : k + 8192])
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor), "visit": pa.array(~home), "fp": _signed(fp[k : k + 8192][row])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pieces: list[tuple]) -> pa.RecordBatch:
            anchor, visit, fp = (np.concatenate(x) for x in zip(*pieces, strict=True))
            first = np.concatenate([np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1)), [len(anchor)]])
            a, b = anchor_links(fp, ~visit, first, threshold)
            return pa.RecordBatch.from_pydict({"a": _signed(a), "b": _signed(b)})

        held, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column("anchor").to_numpy(), batch.column("visit").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64))
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last anchor may go on
            if many > 1 << 17 and (cut or new[0][0] != held[-1][0][-1]):
                # All that is held up to here is whole; pieces are joined once, however long an anchor lasts.
                yield done([*held, tuple(x[:cut] for x in new)])
                held, many, new = [], 0, tuple(x[cut:] for x in new)
            held.append(new)
            many += len(new[0])
        if held:
            yield done(held)

    copies = distinct.mapInArrow(replicate, "anchor bigint, visit boolean, fp bigint")
    # Some 62 replicas a fingerprint: partitions of a bounded number of them, whatever the session's usual number is.
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() * 62 // REPLICAS, 1)
    return copies.repartition(parts, "anchor").sortWithinPartitions("anchor", "visit").mapInArrow(compare, "a bigint, b bigint")


def _classes(fps: DataFrame, threshold: int) -> DataFrame:
    """fp, component_id, keep (uid of the row that stays) of every distinct fingerprint of fps (doc_id, fp, uid)."""
    first = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("uid"))
    distinct = stored(fps.groupBy("fp").agg(F.min(first).alias("least")), "distinct")
    spread = distinct.select("fp").repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    roots = components(stored(links_of(spread, threshold), "found"))
    grouped = distinct.join(roots.withColumnRenamed("key", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only classes of several fingerprints meet; the others know their smallest row already.
    several = grouped.filter("root <> fp").groupBy("root").agg(F.min("least").alias("others"))
    own = distinct.select(F.col("fp").alias("root"), F.col("least").alias("own"))
    best = stored(several.join(own, "root").select("root", F.least("own", "others").alias("best")), "classes")
    out = grouped.join(best, "root", "left").withColumn("best", F.coalesce("best", "least"))
    return stored(out.select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keep")), "named")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    return fps.join(_classes(fps, threshold), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all columns as they came.

    The documents are written once with a number for each row, by which the rows that go are told; repeated doc_ids
    are rows like any other.
    """
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    fps = stored(fingerprints(rows.select(F.struct(F.col(id_col).alias("id"), F.col(ROW).alias("row")).alias("both"), F.col(text_col).alias("text")), shingle, "both").select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.row").alias("uid"), "fp"), "fingerprints")
    gone = stored(fps.join(_classes(fps, threshold), "fp").filter("keep <> uid").select(F.col("uid").alias(ROW)), "gone")
    return rows.join(gone, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
