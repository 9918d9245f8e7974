"""Links between vectors by buckets: candidates from random projections, each checked exactly.

For cosines a vector's bucket in a table is the signs of its products with some random directions: vectors at an angle agree in a
sign with probability 1 - angle / pi. For Euclidean distances it is the cells of a grid on some random lines (Datar and others, 2004). A vector lies
in its own bucket and visits those behind the sides it is nearest to; visitors meet residents. Numbers of tables and directions are
chosen for the recall wanted of links just at the threshold (closer ones are found more often) and for the least work; what
comes out is checked, so nothing wrong is among it.

visarium.operators.links.vector_links finds all links, and is what to use unless vectors are many and without structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.operators import links as lk
from visarium.tables import stored

#: Vectors of a bucket, about; vectors of a bucket that are compared at once; buckets that a vector visits in a table.
BUCKET, BLOCK, VISITS = 64, 1024, 3
#: Pairs by which a plan's recall is worked out, and the seed of directions.
TRIALS, SEED = 4000, 7


@dataclass(frozen=True)
class Plan:
    """tables of `bits` directions each; for Euclid the width of a grid's cells."""

    metric: str
    bits: int
    tables: int
    width: float
    found: float

    def directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.normal(size=(self.tables, self.bits, size)), rng.uniform(0, 1, (self.tables, self.bits))


def _codes(x: np.ndarray, plan: Plan, visits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each table: rows, buckets and whether the row is at home there."""
    turn, shift = plan.directions(x.shape[1])
    weight = np.random.default_rng(SEED + 1).integers(1, 1 << 62, plan.bits) | 1
    for t in range(plan.tables):
        y = x @ turn[t].T
        if plan.metric == "cosine":
            cell, side = (y >= 0).astype(np.int64), np.where(y >= 0, -1, 1)
            far = np.abs(y)
        else:
            y = y / plan.width + shift[t]
            cell = np.floor(y).astype(np.int64)
            low = y - cell
            side, far = np.where(low < 0.5, -1, 1), np.minimum(low, 1 - low)
        with np.errstate(over="ignore"):
            home = (cell * weight).sum(1)
        every = np.arange(len(x))
        yield t, every, home, np.ones(len(x), bool)
        near = np.argsort(far, axis=1, kind="stable")[:, : min(visits, plan.bits)]
        for k in range(near.shape[1]):
            b = near[:, k]
            with np.errstate(over="ignore"):
                yield t, every, home + side[every, b] * weight[b], np.zeros(len(x), bool)


@cache
def _meet(metric: str, threshold: float, bits: int, width: float, visits: int) -> float:
    """How often two vectors just at the threshold meet in one table, from drawn projections."""
    rng = np.random.default_rng(SEED + 2)
    x = rng.normal(size=(TRIALS, bits))
    if metric == "cosine":
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * rng.normal(size=(TRIALS, bits))
        differ = (x >= 0) != (y >= 0)
        far_x, far_y = np.abs(x), np.abs(y)
        reach_x = reach_y = differ
    else:
        x = rng.uniform(0, 1, (TRIALS, bits))
        y = x + threshold / width * rng.normal(size=(TRIALS, bits))
        cell = np.floor(y)
        differ, low = cell != 0, y - cell
        far_x, far_y = np.minimum(x, 1 - x), np.minimum(low, 1 - low)
        reach_x, reach_y = differ & (np.where(x < 0.5, -1, 1) == cell), differ & (cell + np.where(low < 0.5, -1, 1) == 0)
    n = differ.sum(1)
    rank = lambda far: np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable") < visits
    one = (n == 1) & ((reach_x & rank(far_x)).any(1) | (reach_y & rank(far_y)).any(1))
    return float(((n == 0) | one).mean())


def plan_for(n: int, threshold: float, metric: str = "cosine", recall: float = 0.95, spread: float = 1.0, visits: int = VISITS, most: int = 64) -> Plan:
    """The plan of least work, tables times the size of buckets, that finds a link at the threshold with this probability. spread: how
    far Euclidean vectors lie from their mean."""
    best = None
    for bits in range(1, max(2, ceil(log(max(n, 2) / 4, 2)) + 1)):
        for width in (0.0,) if metric == "cosine" else (threshold, 2 * threshold, 4 * threshold):
            p = _meet(metric, threshold, bits, width, visits)
            if p <= 0:
                continue
            tables = 1 if p >= 1 else max(1, ceil(log(1 - recall) / log(1 - p)))
            if tables > most:
                continue
            # Two vectors at random share a sign half the time, a cell of a line by its width and their spread on it.
            share = (0.5 if metric == "cosine" else min(1.0, width / (2 * sqrt(pi) * max(spread, 1e-9)))) ** bits
            work = tables * (1 + visits) * (BUCKET + n * share)
            if best is None or work < best[0]:
                best = work, Plan(metric, bits, tables, width, 1 - (1 - p) ** tables)
    if best is None:
        raise ValueError(f"no plan of {most} tables finds {recall:.0%} of links at {threshold}")
    return best[1]


def _spread(rows: DataFrame) -> float:
    """How far vectors lie from their mean, from a bounded sample: it only tells which plan costs least."""
    x = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(lk.SAMPLE).collect()], float)
    return float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()))


def _planned(rows: DataFrame, threshold: float, metric: str, recall: float, plan: Plan | None) -> Plan | None:
    """The plan given or one for these vectors; none if there are none."""
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return None
    if low != high:
        raise ValueError("vectors of several lengths")
    return plan or plan_for(n, threshold, metric, recall, _spread(rows) if metric == "euclid" else 1.0)


def bucket_links(df: DataFrame, threshold: float, metric: str = "cosine", recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, plan: Plan | None = None) -> DataFrame:
    """src < dst, value of pairs with cosine >= threshold or euclid <= threshold: about the share `recall` of those just at the threshold,
    more of closer ones, and no others. Null vectors and ids have no links; vectors of several lengths are an error."""
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"no buckets for {metric!r}")
    rows = stored(lk._rows(df, id_col, vec_col), "vectors")
    plan = _planned(rows, threshold, metric, recall, plan)
    if plan is None:
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("value"))
    visits = VISITS

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = lk._scaled(np.stack(pdf["v"].to_numpy()).astype(float), metric)
            ids, packed = pdf["id"].to_numpy(), [v.astype("<f8").tobytes() for v in x]
            for t, row, bucket, home in _codes(x, plan, visits):
                yield pd.DataFrame({"t": np.int32(t), "bucket": bucket, "visit": ~home, "id": ids[row], "v": [packed[k] for k in row]})

    placed = rows.mapInPandas(place, "t int, bucket bigint, visit boolean, id bigint, v binary")
    # Buckets without residents need no visitors; large ones are compared a pair of blocks at a time.
    sizes = rows.mapInPandas(lambda it: (p.drop(columns=["id", "v"]) for p in place(it)), "t int, bucket bigint, visit boolean").filter("not visit").groupBy("t", "bucket").agg(F.count("*").alias("m"))
    sizes = stored(sizes, "buckets")
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    known = placed.join(sizes, ["t", "bucket"]).withColumns({"parts": parts, "own": own})
    # A resident meets the blocks up to its own as the second side and those from its own on as the first.
    pairs = F.when(F.col("visit"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("second"))))
    pairs = pairs.otherwise(F.flatten(F.array(
        F.transform(F.sequence(F.col("own"), F.col("parts") - 1), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(False).alias("second"))),
        F.transform(F.sequence(F.lit(0), F.col("own")), lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(True).alias("second"))),
        F.array(F.struct(F.col("own").alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("second"))),
    )))
    dealt = known.select("t", "bucket", F.explode(pairs).alias("p"), "id", "v").select("t", "bucket", "p.i", "p.j", "p.second", "id", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            ids, second = t.column("id").to_numpy(), t.column("second").to_numpy()
            x = np.frombuffer(b"".join(t.column("v").to_pylist()), "<f8").reshape(len(ids), -1)
            p, q, value = lk._compare(x[~second], x[second], metric, threshold)
            a, b = ids[~second][p], ids[second][q]
            keep = a != b
            return pa.RecordBatch.from_pydict({"src": pa.array(np.minimum(a, b)[keep]), "dst": pa.array(np.maximum(a, b)[keep]), "value": pa.array(value[keep])})

        keys, held = ["t", "bucket", "i", "j"], []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            k = np.stack([t.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                piece = t.slice(lo, hi - lo)
                if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in keys):
                    yield done(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield done(pa.concat_tables(held))

    found = dealt.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j").mapInArrow(compare, "src bigint, dst bigint, value double")
    return found.groupBy("src", "dst").agg((F.max if metric == "cosine" else F.min)("value").alias("value"))


def recall_of(df: DataFrame, threshold: float, metric: str = "cosine", recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", plan: Plan | None = None, block: int = lk.BLOCK) -> tuple[int, int]:
    """Links that bucket_links finds, and all links (by the exact join): what a plan misses on these vectors. It finds those of which one lies in
    a bucket where the other lies or that the other visits; the tile that finds a link looks there, and only counts leave it."""
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"no buckets for {metric!r}")
    rows = stored(lk._rows(df, id_col, vec_col), "vectors")
    plan = _planned(rows, threshold, metric, recall, plan)
    if plan is None:
        return 0, 0
    packed = lk._packed(rows, metric, lk.pivots(rows, metric, block), block, lk.GROUP)
    reach, held = lk._reach(metric, threshold), []

    def buckets(x: np.ndarray) -> list[list[np.ndarray]]:
        """For each table the buckets of all vectors: at home first, then those visited."""
        out: list[list[np.ndarray]] = [[] for _ in range(plan.tables)]
        for t, _, bucket, _ in _codes(x, plan, VISITS):
            out[t].append(bucket)
        return out

    def run(ga: int, gb: int, x: lk._Blocks, k: int, y: lk._Blocks) -> Iterator[pa.RecordBatch]:
        if not held or held[0] is not x:
            held[:] = [x, [buckets(v) for v in x.vecs]]
        other, found, every = buckets(y.vecs[0]), 0, 0
        for i in np.flatnonzero(x.apart(y)[:, 0] <= reach):
            if ga == gb and x.blk[i] > k:
                continue
            p, q, _ = lk._compare(x.vecs[i], y.vecs[0], metric, threshold)
            keep = x.ids[i][p] < y.ids[0][q] if ga == gb and x.blk[i] == k else x.ids[i][p] != y.ids[0][q]
            p, q = p[keep], q[keep]
            every += len(p)
            for own, their in zip(held[1][i], other, strict=True):
                if not len(p):
                    break
                home, seat = own[0][p], their[0][q]
                apart = home != seat
                for mine, yours in zip(own[1:], their[1:], strict=True):
                    apart &= (mine[p] != seat) & (home != yours[q])
                found += len(p) - int(apart.sum())
                p, q = p[apart], q[apart]
        yield pa.RecordBatch.from_pydict({"found": pa.array([found], pa.int64()), "every": pa.array([every], pa.int64())})

    counts = lk._stream_tiles(packed, packed, lk._tiles(packed, packed, False, F.lit(reach)), run, "found bigint, every bigint")
    return tuple(counts.agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first())


def pairs_compared(df: DataFrame, plan: Plan, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """Pairs of vectors that a plan compares."""
    rows = lk._rows(df, id_col, vec_col)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = lk._scaled(np.stack(pdf["v"].to_numpy()).astype(float), plan.metric)
                for t, _, bucket, home in _codes(x, plan, VISITS):
                    yield pd.DataFrame({"t": np.int32(t), "bucket": bucket, "home": home.astype("int64")})

    m, v = F.sum("home"), F.count("*") - F.sum("home")
    cost = rows.mapInPandas(place, "t int, bucket bigint, home bigint").groupBy("t", "bucket").agg((m * (m - 1) / 2 + m * v).alias("c"))
    return int(cost.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0])
