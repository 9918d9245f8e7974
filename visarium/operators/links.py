"""Similarity joins of vectors.

Vectors are dealt into blocks by the nearest of some pivots and the distance to it, and blocks that follow one another
into groups. A task gets a tile: the blocks of two groups, so a vector is shipped once for each group and not once for each
block. Every block knows its centre, its radius and how far from the first pivots it reaches; by the triangle inequality
two blocks, or two groups, that are further apart than linked vectors can be are not compared, exactly. Only pairs that
pass leave the task.

How much is left out depends on the vectors: clusters that are narrow beside their distances are never compared, while
vectors without any structure are all about as far from each other, and then every tile is compared - one matrix product
for a pair of blocks - whatever the threshold. A dot product bounds no distance, so it compares all tiles as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visarium.tables import stored

#: Vectors of a block, blocks of a group at most, pivots, vectors that pivots are chosen from, pivots that blocks are told apart by.
BLOCK, GROUP, PIVOTS, SAMPLE, TOLD = 1024, 32, 256, 2048, 16

PACKED = "grp int, blk int, ids binary, vecs binary, lo array<double>, hi array<double>, centre binary, radius double"


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def pivots(rows: DataFrame, metric: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a bounded sample, each the furthest from those before, in an order in which neighbours are near; and the
    first of them as chosen, by which blocks are told apart."""
    most = min(PIVOTS, max(TOLD, -(-rows.count() // block)))
    found = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not found:
        return np.zeros((1, 1)), np.zeros((1, 1))
    x = _scaled(np.array(found, float), metric)  # vectors of several lengths are an error here
    chosen, gap = [0], _gaps(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)) and gap.max() > 1e-9:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _gaps(x, x[chosen[-1:]])[:, 0])
    tour, gap = [0], _gaps(x[chosen], x[chosen])
    left = np.ones(len(chosen), bool)
    for _ in range(len(chosen) - 1):
        left[tour[-1]] = False
        tour.append(int(np.where(left, gap[tour[-1]], np.inf).argmin()))
    return x[chosen][tour], x[chosen[:TOLD]]


def _packed(rows: DataFrame, metric: str, pivot: tuple[np.ndarray, np.ndarray], block: int, group: int, least: int | None = None) -> DataFrame:
    """The vectors in blocks of blocks, stored: numbers as packed bytes, and what bounds their distance to other blocks. least: groups
    that there are to be at least, by the number of shuffle partitions if not given."""
    n, (cells, told) = rows.count(), pivot
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block))
    # Few blocks still make several tiles for every task slot; many make groups of a bounded size.
    groups = max(-(-blocks // group), min(blocks, least or int(np.ceil(np.sqrt(4 * parts)))))
    size = max(1, min(block, -(-n // groups)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                if {len(x) for x in pdf["v"]} != {cells.shape[1]}:
                    raise ValueError("vectors of several lengths")
                gap = _gaps(_scaled(np.stack(pdf["v"].to_numpy()).astype(float), metric), cells)
                cell = gap.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), gap=gap[np.arange(len(pdf)), cell])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        many = number = 0
        grp = TaskContext.get().partitionId()

        def one(pdf: pd.DataFrame) -> tuple:
            x = _scaled(np.stack(pdf["v"].to_numpy()).astype(float), metric)
            gap, centre = _gaps(x, told), x.mean(0)
            return grp, number, pdf["id"].to_numpy("<i8").tobytes(), x.astype("<f8").tobytes(), gap.min(0).tolist(), gap.max(0).tolist(), centre.astype("<f8").tobytes(), float(np.sqrt(((x - centre) ** 2).sum(1)).max())

        for pdf in batches:
            held.append(pdf)
            many += len(pdf)
            while many >= size:
                whole = pd.concat(held)
                yield pd.DataFrame([one(whole[:size])], columns=[c.split()[0] for c in PACKED.split(", ")])
                held, many, number = [whole[size:]], many - size, number + 1
        if many:
            yield pd.DataFrame([one(pd.concat(held))], columns=[c.split()[0] for c in PACKED.split(", ")])

    dealt = rows.mapInPandas(place, "id bigint, v array<double>, cell int, gap double").repartitionByRange(groups, "cell", "gap", "id").sortWithinPartitions("cell", "gap", "id")
    return stored(dealt.mapInPandas(pack, PACKED), "blocks")


def _numbers(raw: bytes, kind: str = "<f8", width: int = 1) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width) if width > 1 else np.frombuffer(raw, kind)


class _Blocks:
    """The blocks of one group, as a task holds them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("blk")
        self.blk = table["blk"].to_numpy()
        self.ids = [_numbers(x, "<i8") for x in table["ids"].to_pylist()]
        self.vecs = [np.frombuffer(x, "<f8").reshape(len(i), -1) for x, i in zip(table["vecs"].to_pylist(), self.ids, strict=True)]
        self.lo, self.hi = (np.array(table[c].to_pylist()) for c in ("lo", "hi"))
        self.centre, self.radius = np.array([_numbers(x) for x in table["centre"].to_pylist()]), table["radius"].to_numpy()

    def apart(self, other: _Blocks) -> np.ndarray:
        """How far apart vectors of two blocks are at least, for all pairs of blocks."""
        if self.centre.shape[1] != other.centre.shape[1]:
            raise ValueError("vectors of several lengths")
        by_centre = _gaps(self.centre, other.centre) - self.radius[:, None] - other.radius[None]
        by_pivot = np.maximum(self.lo[:, None] - other.hi[None], other.lo[None] - self.hi[:, None]).max(2)
        return np.maximum(by_centre, by_pivot)


def _tiles(a: DataFrame, b: DataFrame, both_ways: bool, reach: Column) -> DataFrame:
    """ga, gb of the pairs of groups that may hold links: numbers of groups are paired, not rows joined with all others."""
    told = lambda c, best: F.array(*(best(F.get(F.col(c), F.lit(k))) for k in range(TOLD)))
    stats = lambda d: d.groupBy("grp").agg(told("lo", F.min).alias("lo"), told("hi", F.max).alias("hi"), *([F.max("reach").alias("reach")] if "reach" in d.columns else []))
    left, right = stored(stats(a), "groups"), stored(stats(b), "groups")
    numbers = right.agg(F.sort_array(F.collect_list("grp")).alias("all")).first()["all"]  # one number for each group
    if not numbers:
        return left.select(F.col("grp").alias("ga"), F.col("grp").alias("gb")).filter("false")
    first = F.col("grp") if not both_ways else F.lit(numbers[0])
    pairs = left.withColumn("gb", F.explode(F.sequence(F.least(first, F.lit(numbers[-1])), F.lit(numbers[-1]))))
    full = pairs.withColumnRenamed("grp", "ga").join(right.select(F.col("grp").alias("gb"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "gb")
    gap = F.array_max(F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    return full.filter(F.coalesce(gap, F.lit(0.0)) <= reach).select("ga", "gb")


def _each_tile(a: DataFrame, b: DataFrame, tiles: DataFrame, run, schema: str) -> DataFrame:
    """run(ga, gb, blocks of ga, blocks of gb) for every tile."""
    left = a.withColumnRenamed("grp", "ga").join(tiles, "ga").groupBy("ga", "gb")
    fresh = b.select(*(F.col(c).alias("gb" if c == "grp" else f"b_{c}") for c in b.columns))  # the same table may be on both sides
    right = fresh.join(tiles.select(F.col("ga").alias("ga"), F.col("gb").alias("gb")), "gb")
    right = right.select("ga", "gb", *(F.col(f"b_{c}").alias(c) for c in b.columns if c != "grp")).groupBy("ga", "gb")

    def tile(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        return run(key[0].as_py(), key[1].as_py(), x, y)

    return left.cogroup(right).applyInArrow(tile, schema)


def _stream_tiles(a: DataFrame, b: DataFrame, tiles: DataFrame, run, schema: str) -> DataFrame:
    """What run(ga, gb, blocks of ga, a block of gb) yields for every tile: a task holds one side of a tile and a block of the other, and
    what comes out leaves it by pairs of blocks."""
    put = lambda d, own, side: d.withColumnRenamed("grp", own).join(tiles.select("ga", "gb"), own).select("ga", "gb", F.lit(side).alias("side"), *(c for c in d.columns if c != "grp"))
    both = put(a, "ga", 0).unionByName(put(b, "gb", 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, x = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if key != at:
                    at, held, x = key, [], None
                if not row.column(2)[0].as_py():
                    held.append(row)
                elif held:
                    x = x or _Blocks(pa.Table.from_batches(held))
                    yield from run(*key, x, row.column("blk")[0].as_py(), _Blocks(pa.Table.from_batches([row])))

    return both.repartition("ga", "gb").sortWithinPartitions("ga", "gb", "side", "blk").mapInArrow(each, schema)


def _compare(a: np.ndarray, c: np.ndarray, metric: str, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of c that are linked, and their value."""
    rough = a @ c.T
    if metric != "euclid":
        i, j = np.nonzero(rough >= threshold)
        return i, j, rough[i, j]
    rough = (a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * rough
    i, j = np.nonzero(rough <= threshold * threshold + 1e-6 * (1 + threshold * threshold))
    value = np.sqrt(((a[i] - c[j]) ** 2).sum(1))
    ok = value <= threshold
    return i[ok], j[ok], value[ok]


def _reach(metric: str, threshold: float) -> float:
    """How far apart two linked vectors can be, with a little for rounding."""
    if metric == "euclid":
        return threshold + 1e-6 * (1 + threshold)
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6 if metric == "cosine" else float("inf")


def vector_links(df: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", other: DataFrame | None = None, other_id: str | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """src, dst, value of all pairs with cosine or dot >= threshold, or euclid <= threshold.

    Within one table src < dst; with another table src is of the first and dst of the other. Null vectors and ids have no
    links; vectors of several lengths are an error."""
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError(f"unknown metric {metric!r}")
    rows, others = _rows(df, id_col, vec_col), None if other is None else _rows(other, other_id or id_col, vec_col)
    pivot = pivots(rows if others is None or not rows.isEmpty() else others, metric, block)
    a = _packed(rows, metric, pivot, block, group)
    b = a if others is None else _packed(others, metric, pivot, block, group)
    reach, alone = _reach(metric, threshold), other is None

    def run(ga: int, gb: int, x: _Blocks, k: int, y: _Blocks) -> Iterator[pa.RecordBatch]:
        itself = alone and ga == gb
        for i in np.flatnonzero(x.apart(y)[:, 0] <= reach):
            if itself and x.blk[i] > k:
                continue
            p, q, value = _compare(x.vecs[i], y.vecs[0], metric, threshold)
            src, dst = x.ids[i][p], y.ids[0][q]
            if alone:
                keep = src < dst if itself and x.blk[i] == k else src != dst
                src, dst, value = np.minimum(src, dst)[keep], np.maximum(src, dst)[keep], value[keep]
            yield pa.RecordBatch.from_pydict({"src": src, "dst": dst, "value": value})

    return _stream_tiles(a, b, _tiles(a, b, not alone, F.lit(reach)), run, "src bigint, dst bigint, value double")


def reachable_links(df: DataFrame, threshold: float, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """src < dst, value of all pairs with a distance <= threshold: their mutual reachability, the largest of the distance and both
    core distances (nearest_distances). Cores travel with the vectors; links meet no table."""
    rows = _rows(df, id_col, vec_col)
    marked = stored(rows.join(nearest_distances(rows, k, "id", "v", block, group), "id").select("id", F.concat("v", F.array("core")).alias("v")), "cores")
    packed = _packed(marked, "euclid", pivots(marked, "euclid", block), block, group)
    # Two cores differ by no more than their vectors' distance: with them as one more number linked vectors are root 2 times as far at most.
    reach = _reach("euclid", float(np.sqrt(2)) * threshold)

    def run(ga: int, gb: int, x: _Blocks, k: int, y: _Blocks) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(x.apart(y)[:, 0] <= reach):
            if ga == gb and x.blk[i] > k:
                continue
            p, q, value = _compare(x.vecs[i][:, :-1], y.vecs[0][:, :-1], "euclid", threshold)
            src, dst, value = x.ids[i][p], y.ids[0][q], np.maximum(value, np.maximum(x.vecs[i][p, -1], y.vecs[0][q, -1]))
            keep = src < dst if ga == gb and x.blk[i] == k else src != dst
            yield pa.RecordBatch.from_pydict({"src": np.minimum(src, dst)[keep], "dst": np.maximum(src, dst)[keep], "value": value[keep]})

    return _stream_tiles(packed, packed, _tiles(packed, packed, False, F.lit(reach)), run, "src bigint, dst bigint, value double")


def _closest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of each row of x to rows of y, in order; fewer if y has fewer."""
    rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    m = min(k + 2, rough.shape[1])
    j = np.argpartition(rough, m - 1, axis=1)[:, :m]
    return np.sort(np.sqrt(((x[:, None] - y[j]) ** 2).sum(2)), axis=1)[:, :k]


def nearest_distances(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """id, core: Euclidean distance to the k-th nearest vector, the vector itself counting as the first; with fewer vectors to
    the furthest.

    Within its own block a vector finds k neighbours, whose distance bounds the answer. Only blocks that may hold something
    nearer than the largest of a block's bounds are compared with it, exactly."""
    rows = _rows(df, id_col, vec_col)
    pivot = pivots(rows, "euclid", block)
    a = _packed(rows, "euclid", pivot, block, group)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = []
            for i, v in zip(b.column("ids"), b.column("vecs"), strict=True):
                n = len(i.as_py()) // 8
                x = np.frombuffer(v.as_py(), "<f8").reshape(n, -1)
                most.append(float(_closest(x, x, k)[:, -1].max()) * (1 + 1e-9) + 1e-9 if n >= k else float("inf"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(most)], [*b.schema.names, "reach"])

    told = stored(a.mapInArrow(bound, f"{PACKED}, reach double"), "blocks")

    def run(ga: int, gb: int, x: pa.Table, y: pa.Table) -> pa.Table:
        reach = x.sort_by("blk")["reach"].to_numpy()
        x, y = _Blocks(x), _Blocks(y)
        apart, ids, found = x.apart(y), [], []
        for i in range(len(x.ids)):
            near = [_closest(x.vecs[i], y.vecs[j], k) for j in np.flatnonzero(apart[i] <= reach[i])]
            if near:
                d = np.sort(np.concatenate(near, 1), axis=1)[:, :k]
                ok = d <= reach[i]
                ids.append(np.repeat(x.ids[i], ok.sum(1)))
                found.append(d[ok])
        return pa.table({"id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "d": np.concatenate(found) if found else np.zeros(0)})

    near = _each_tile(told, told, _tiles(told, told, True, F.col("reach")), run, "id bigint, d double")
    ranked = F.slice(F.array_sort(F.collect_list("d")), 1, k)
    return near.groupBy("id").agg(F.element_at(ranked, -1).alias("core")).withColumnRenamed("id", id_col)


def blocks_compared(df: DataFrame, threshold: float, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> tuple[int, int]:
    """Pairs of blocks that vector_links compares within one table, and all pairs: what the bounds leave out of these vectors."""
    rows = _rows(df, id_col, vec_col)
    a = _packed(rows, metric, pivots(rows, metric, block), block, GROUP)
    reach = _reach(metric, threshold)

    def run(ga: int, gb: int, x: pa.Table, y: pa.Table) -> pa.Table:
        near = _Blocks(x).apart(_Blocks(y)) <= reach
        return pa.table({"n": [int(np.triu(near).sum() if ga == gb else near.sum())]})

    n = a.count()
    kept = _each_tile(a, a, _tiles(a, a, False, F.lit(reach)), run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return kept, n * (n + 1) // 2
