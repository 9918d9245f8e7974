"""Jaccard join of word n-gram sets: a size-aware heavy-light join.

A document's set holds its distinct shingles. Equal sets collapse to one first. Two sets link when
100 * intersection >= percent * union, so either shares need(n) = ceil(percent * n / 100) of its n shingles at least.

1. *Sets that can link.* need(n) shingles of a set must lie in other sets too. Every step of texts sends its distinct
   shingles, cut into ranges of their hashes, once each (32 bits and the set's number); a range tells the steps how many
   shingles of each set came from elsewhere as well. Sets with fewer than need(n) such shingles are out, exactly: most
   of a corpus. A shingle that all documents have is one entry a step, in any range.
2. *Order.* Shingles of the sets left are ordered by their number of sets, rare ones first. Of two sets that link, the first
   k common shingles lie among the first n - need(n) + k of either.
3. *Light sets* (up to a boundary in size) enumerate the subsets of PICK = 2 of those with k = 2: two light sets that link share
   one. *Heavy sets* enumerate nothing: the inverted lists of the first shingles (k = 1) are scanned for pairs in which one set
   at least is heavy (or that may link with less than PICK common shingles). The boundary is the size with the least cost, counted from the real lengths of both kinds of lists.
4. *Scans* leave out what size, the positions of the common shingle, or a parity bitmap of the sets rule out (bits that differ are
   shingles that differ), none of which a link can fail. What is left is verified on the shingles themselves.
5. *Long lists.* A first scan looks at every pair of short lists, and of a set's longest long ones at a share that grows with their
   length, not with its square, drawn by a hash of the pair. Components are formed of the links verified. A second scan looks at
   all pairs of the long lists that are not in one component yet: so each link lies within a component in the end, and pairs inside a dense group
   of near copies are never listed. Lists over BLOCK sets are scanned in blocks; in the second scan only sets outside of the
   list's largest component meet all others.

Shingles are told apart by 64-bit hashes.

Defined results: null and wordless text is an empty set, linked with nothing, not even with another; a text with fewer words than a
shingle has is one shingle; repeated rows come back each, in one component by their sets; a null doc_id is a row like the others but
names a component only where all are null; texts of any length are read whole, one that is longer than a step alone; an empty table
gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.llm.arrays import lowered, steps, take_ragged
from visarium.llm.components import components
from visarium.llm.decontaminate import word_hashes
from visarium.llm.tables import stored

#: Words of a shingle, and the similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Shingles of the subsets that light sets enumerate, and the largest size that the boundary may have.
PICK, MOST_LIGHT = 2, 40
#: Shingles of a range of hashes, about; sets of a step at most, and bytes of text (a longer text is a step of its own).
RANGE, SETS, STEP = 1 << 20, 60_000, 1 << 20
#: Sets of a list that are compared at once; partners of a set that the first scan looks at in a longer list, and such lists of a set;
#: bytes of a bitmap.
BLOCK, FIRST, LISTS, BITMAP = 4096, 32, 2, 128
#: Digests that are joined by broadcast: 16 bytes each.
BROADCAST = 500_000
#: Cost of a row that is written and sorted, in compared pairs.
ROW_COST = 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MANY = 0xFFFF


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending in each, and the offsets of the texts in them."""
    h, _, _, before = word_hashes(lowered(data), offs, word=_WORD)
    words = np.diff(before)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    first, length = take_ragged(before[:-1], n), np.repeat(np.minimum(words, size), n)
    s = length.astype(np.uint64) * _ODD
    for j in range(size):
        on = length > j
        at = first + j if on.all() else np.minimum(first + j, max(len(h) - 1, 0))
        s = np.where(on, _mixed((s ^ h[at]) * _ODD), s) if len(s) else s
    cut = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(s[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _digests(values: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    return [_digest(values[a:b]) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _need(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Shingles that a set of n must share with any set it links to."""
    return F.floor((n * percent + 99) / 100).cast("int") if isinstance(n, Column) else (n * percent + 99) // 100


def members_of(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n and digest of the set (null if empty) of every document."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches, most=STEP):
            values, cuts = shingle_sets(data, offs, size)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(np.diff(cuts)), "digest": pa.array(_digests(values, cuts), pa.binary())})

    return few.mapInArrow(scan, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, n bigint, digest binary")


def _distinct_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Digests, hashes and offsets of the distinct sets of some texts, without the empty one."""
    values, cuts = shingle_sets(data, offs, size)
    seen: dict[bytes, int] = {}
    for k, d in enumerate(_digests(values, cuts)):
        if d is not None:
            seen.setdefault(d, k)
    which = np.fromiter(seen.values(), np.int64, len(seen))
    n = np.diff(cuts)[which]
    return list(seen), values[take_ragged(cuts[which], n)], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


_BLOCK = "span bigint, step bigint, digests binary, n binary, who binary, value binary"


def _blocks(docs: DataFrame, bits: int, size: int) -> DataFrame:
    """Of each step: a row with its sets (digests, sizes, shingles that two sets of the step share), and for each
    range of hashes a row with the step's distinct shingles (value) and their sets (who; _MANY for several sets)."""

    def row(span: int, step: int, digests: bytes = b"", n: bytes = b"", who: bytes = b"", value: bytes = b"") -> tuple:
        return span, step, digests, n, who, value

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = TaskContext.get().partitionId() << 33
        for part, data, offs in steps(batches, most=2 * STEP):
            for lo in range(0, part.num_rows, SETS):
                hi = min(lo + SETS, part.num_rows)
                digests, values, cuts = _distinct_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
                step += 1
                who = np.repeat(np.arange(len(digests)), np.diff(cuts))
                order = np.argsort(values, kind="stable")
                values, who = values[order], who[order]
                first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(values))) > 1
                twice = np.repeat(many, np.diff(np.append(first, len(values))))
                local = np.bincount(who[twice], minlength=len(digests)).astype(np.int32)
                rows = [row(-1 - (step & 0xFF), step, b"".join(digests), np.diff(cuts).astype(np.int32).tobytes(), value=local.tobytes())]
                kept = np.where(many, _MANY, who[first]).astype(np.uint16)
                values = values[first]
                span = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
                low = (values >> np.uint64(32 - bits)).astype(np.uint32)
                ends = np.searchsorted(span, np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
                rows += [row(k, step, who=kept[a:b].tobytes(), value=low[a:b].tobytes()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], ["span", "step", "digests", "n", "who", "value"])

    return docs.mapInArrow(cut, _BLOCK)


def _shared_in_span(table: pa.Table) -> pa.Table:
    """Of a range: for each step how many of the shingles of each of its sets come from other steps as well (who, value)."""
    if table.column("span")[0].as_py() < 0:
        return table  # the steps' own rows pass
    values = [np.frombuffer(x, np.uint32) for x in table.column("value").to_pylist()]
    who = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("who").to_pylist()])
    block = np.repeat(np.arange(len(values)), [len(x) for x in values])
    values = np.concatenate(values)
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values), bool)
    shared[order] = same[1:] | same[:-1]
    hit = shared & (who != _MANY)
    cell, n = np.unique(block[hit] << 16 | who[hit], return_counts=True)
    ends = np.searchsorted(cell, np.arange(len(table) + 1) << 16)
    rows = [(a, b, k) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
    steps_ = table.column("step").to_pylist()
    return pa.table({
        "span": pa.array([0] * len(rows), pa.int64()), "step": pa.array([steps_[k] for _, _, k in rows], pa.int64()), "digests": pa.array([b""] * len(rows), pa.binary()), "n": pa.array([b""] * len(rows), pa.binary()),
        "who": pa.array([(cell[a:b] & 0xFFFF).astype(np.uint16).tobytes() for a, b, _ in rows], pa.binary()), "value": pa.array([n[a:b].astype(np.int32).tobytes() for a, b, _ in rows], pa.binary()),
    })


def linkable(docs: DataFrame, total: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Distinct digests of the sets that share need(n) of their shingles with any others; docs: text; total: shingles of all sets."""
    bits = max(0, (max(total, 1) // RANGE).bit_length())

    def told(table: pa.Table) -> pa.Table:
        out: list[bytes] = []
        own = table.filter(pa.array([x < 0 for x in table.column("span").to_pylist()]))
        if len(own):
            n = np.frombuffer(own.column("n")[0].as_py(), np.int32)
            shared = np.frombuffer(own.column("value")[0].as_py(), np.int32).astype(np.int64)
            for s, w, v in zip(table.column("span").to_pylist(), table.column("who").to_pylist(), table.column("value").to_pylist(), strict=True):
                if s >= 0:
                    np.add.at(shared, np.frombuffer(w, np.uint16), np.frombuffer(v, np.int32))
            raw = own.column("digests")[0].as_py()
            out = [raw[16 * k : 16 * k + 16] for k in np.flatnonzero(shared >= _need(n.astype(np.int64), percent))]
        return pa.table({"digest": pa.array(out, pa.binary())})

    found = _blocks(docs, bits, size).groupBy("span").applyInArrow(_shared_in_span, _BLOCK)
    return found.groupBy("step").applyInArrow(told, "digest binary").distinct()


def _bitmap(values: np.ndarray) -> bytes:
    """The parity of the number of shingles in each cell: sets with d different shingles differ in d cells at most."""
    return np.packbits(np.bincount((values % np.uint64(8 * BITMAP)).astype(np.int64), minlength=8 * BITMAP) & 1).tobytes()


def sets_of(docs: DataFrame, digests: DataFrame, size: int = SHINGLE) -> DataFrame:
    """sid, digest, n, hashes and bits of the distinct sets with these digests, written once. docs: text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in steps(batches, most=STEP):
            names, values, cuts = _distinct_sets(data, offs, size)
            each = [_bitmap(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            hashes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"digest": pa.array(names, pa.binary()), "n": pa.array(np.diff(cuts)), "hashes": hashes, "bits": pa.array(each, pa.binary())})

    few = F.broadcast(digests) if digests.count() <= BROADCAST else digests
    made = docs.mapInArrow(make, "digest binary, n bigint, hashes array<bigint>, bits binary").join(few, "digest", "left_semi")
    one = made.groupBy("digest").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    return stored(one.withColumn("sid", F.monotonically_increasing_id()), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sid, n, h, df, pos of the shingles that stand among a set's first n - need(n) + PICK and in other sets too; df: sets that
    have it. Shingles of one set come before all others, and are counted only."""
    tokens = sets.select("sid", "n", F.explode("hashes").alias("h"))
    df = stored(tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "df")
    own = Window.partitionBy("sid")
    shared = tokens.join(df, "h").withColumn("s", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy("df", "h")))
    need = _need(F.col("n"), percent)
    pos = F.col("n") - F.col("s") + F.col("k") - 1
    return stored(shared.filter(F.col("s") >= need).withColumn("pos", pos.cast("int")).filter(F.col("pos") < F.col("n") - need + PICK).select("sid", "n", "h", "df", "pos"), "prefixes")


def entries(sets: DataFrame, percent: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """kind, key, m, sid, n, pos, bits: sets in the lists that are scanned (kind 1: a shingle's, 2: a subset's; m sets in it), and
    the boundary: sets of that size or below are light."""
    first = prefixes(sets, percent)
    need = _need(F.col("n"), percent)
    scanned = first.filter(F.col("pos") < F.col("n") - need + 1).select(F.lit(1).alias("kind"), F.col("h").alias("key"), "sid", "n", "pos")
    picks = F.array_sort(F.collect_list("h"))
    subsets = F.flatten(F.transform(F.col("hs"), lambda x, i: F.transform(F.slice(F.col("hs"), i + 2, F.size("hs")), lambda y: F.xxhash64(x, y))))
    light = first.filter(F.col("n") <= MOST_LIGHT).groupBy("sid", "n").agg(picks.alias("hs")).select(F.lit(2).alias("kind"), F.explode(subsets).alias("key"), "sid", "n", F.lit(-1).alias("pos"))
    rows = stored(scanned.unionAll(light), "entries")
    lengths = stored(rows.groupBy("kind", "key").agg(F.count("*").alias("m")).filter("m > 1"), "lengths")
    rows = stored(rows.join(lengths, ["kind", "key"]).join(sets.select("sid", "bits"), "sid"), "lists")
    # By size, up to MOST_LIGHT: what its sets cost in either kind of lists.
    cost = F.sum(F.least("m", F.lit(block)) + ROW_COST).cast("double")
    costs = {(r.kind, r.n): r.cost for r in rows.filter(F.col("n") <= MOST_LIGHT).groupBy("kind", "n").agg(cost.alias("cost")).collect()}
    total = [sum(costs.get((2, n), 0) for n in range(b + 1)) + sum(costs.get((1, n), 0) for n in range(b + 1, MOST_LIGHT + 1)) for b in range(MOST_LIGHT + 1)]
    boundary = total.index(min(total))
    partner = (percent * (boundary + 1) + 99) // 100
    use = ((F.col("kind") == 1) & ((F.col("n") >= partner) | (need < PICK))) | ((F.col("kind") == 2) & (F.col("n") <= boundary))
    return rows.filter(use), boundary


def _drawn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number of 32 bits for each pair of sets."""
    return _mixed(x.astype(np.uint64) * _ODD ^ _mixed(y.astype(np.uint64))) >> np.uint64(32)


def _share(m: np.ndarray, block: int) -> np.ndarray:
    """The first scan looks at pairs drawn below this: about FIRST partners of each set, whatever the list's length."""
    return np.minimum(FIRST * (1 << 32) // np.maximum(np.minimum(m, block) - 1, 1), 1 << 32).astype(np.uint64)


def _scan(rows: dict[str, np.ndarray], boundary: int, percent: int, block: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of the same list (kind, key, part) that may link; rows are sorted by list and size."""
    n, sid, m, pos = rows["n"], rows["sid"], rows["m"], rows["pos"]
    new = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["kind"][1:] != rows["kind"][:-1]) | (rows["part"][1:] != rows["part"][:-1])])
    first = np.append(np.flatnonzero(new), len(n))
    end = np.repeat(first[1:], np.diff(first))
    later = end - np.arange(len(n)) - 1
    done = np.concatenate([[0], np.cumsum(later)])
    found, lo = [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 20), "right")) - 1)
        x = np.repeat(np.arange(lo, hi), later[lo:hi])
        y = take_ragged(np.arange(lo, hi) + 1, later[lo:hi])
        ok = 100 * n[x] >= percent * n[y]
        ok &= (rows["kind"][x] == 2) | (n[y] > boundary) | (_need(n[y], percent) < PICK)
        a, b = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
        ok &= a != b
        if second:
            ok &= rows["comp"][x] != rows["comp"][y]
            ok &= (rows["role"][x] == 2) | (rows["role"][x] != rows["role"][y])
        else:
            ok &= _drawn(a, b) < _share(m[x], block)
        x, y, a, b = x[ok], y[ok], a[ok], b[ok]
        alpha = -(-percent * (n[x] + n[y]) // (100 + percent))
        most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
        ok = (rows["kind"][x] == 2) | (most >= alpha)
        x, y, a, b, alpha = x[ok], y[ok], a[ok], b[ok], alpha[ok]
        for k in range(0, len(x), 1 << 16):
            s = slice(k, k + (1 << 16))
            apart = np.bitwise_count(rows["bits"][x[s]] ^ rows["bits"][y[s]]).sum(1, dtype=np.int64)
            ok = apart <= n[x[s]] + n[y[s]] - 2 * alpha[s]
            found.append(np.stack([a[s][ok], b[s][ok]], 1))
        lo = hi
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pairs(lists: DataFrame, boundary: int, percent: int, block: int, second: bool) -> DataFrame:
    """a, b of the pairs that a scan of the lists (with part, comp and role) leaves, each once."""
    names = ["kind", "key", "part", "m", "sid", "n", "pos", "comp", "role"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pieces: list[dict]) -> pa.RecordBatch:
            rows = {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
            a, b = _scan(rows, boundary, percent, block, second)
            return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

        held, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in names}
            new["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            same = (new["key"] == new["key"][-1]) & (new["kind"] == new["kind"][-1]) & (new["part"] == new["part"][-1])
            cut = int(np.argmax(same))  # the last list may go on
            goes_on = held and all(held[-1][c][-1] == new[c][0] for c in ("kind", "key", "part"))
            if many > 1 << 16 and (cut or not goes_on):
                yield done([*held, {c: x[:cut] for c, x in new.items()}])
                held, many, new = [], 0, {c: x[cut:] for c, x in new.items()}
            held.append(new)
            many += len(new["sid"])
        if held:
            yield done(held)

    dealt = lists.select(*names, "bits").repartition("kind", "key", "part").sortWithinPartitions("kind", "key", "part", "n", "sid")
    return dealt.mapInArrow(scan, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""
    side = lambda k: sets.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("hashes").alias(f"h_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("h_a", "h_b")))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def links_of(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """a, b of links between sets: enough of them to connect all that are linked."""
    lists, boundary = entries(sets, percent, block)
    parts = F.ceil(F.col("m") / block).cast("int")
    # Longer lists are dealt out twice, so that their parts' components meet.
    # In longer lists a set takes part where most others are: the first scan only has to find components.
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("m").desc(), "kind", "key"))
    deal = lambda salt: F.pmod(F.xxhash64("sid", F.lit(salt)), parts) + salt * parts
    dealt = F.when(F.col("m") <= block, F.array(F.lit(0))).otherwise(F.array(deal(0).cast("int"), deal(1).cast("int")))
    use = lists.withColumn("rank", rank).filter((F.col("m") <= FIRST + 1) | (F.col("rank") <= LISTS))
    whole = use.withColumns({"part": F.explode(dealt), "comp": F.col("sid"), "role": F.lit(2)})
    links = stored(_verified(stored(_pairs(whole, boundary, percent, block, False), "pairs"), sets, percent), "links")
    long = lists.filter(F.col("m") > FIRST + 1)
    if long.isEmpty():
        return links
    # The second scan: lists that hold sets of several components.
    roots = components(links).select(F.col("key").alias("sid"), F.col("root").alias("comp"))
    known = stored(long.join(roots, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "long")
    by_comp = known.groupBy("kind", "key", "comp").agg(F.count("*").alias("c"))
    several = stored(by_comp.groupBy("kind", "key").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), (F.sum("c") - F.max("c")).alias("few")).filter("comps > 1"), "several")
    open_ = known.join(several, ["kind", "key"])
    short = open_.filter(F.col("m") <= block).withColumns({"part": F.lit(0), "role": F.lit(2)})
    wide = open_.filter(F.col("m") > block).withColumns({"blocks": parts, "groups": F.ceil(F.col("few") / block).cast("int"), "draw": F.xxhash64("sid")})
    every = wide.withColumns({"mine": F.pmod("draw", F.col("blocks")).cast("int"), "role": F.lit(0)}).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("part", F.col("with") * F.col("blocks") + F.col("mine"))
    outer = wide.filter("comp <> top").withColumns({"mine": F.pmod("draw", F.col("groups")).cast("int"), "role": F.lit(1)}).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.col("mine") * F.col("blocks") + F.col("with"))
    cols = ["kind", "key", "part", "m", "sid", "n", "pos", "comp", "role", "bits"]
    rest = stored(_pairs(short.select(cols).unionAll(every.select(cols)).unionAll(outer.select(cols)), boundary, percent, block, True), "pairs")
    return links if rest.isEmpty() else links.unionAll(stored(_verified(rest, sets, percent), "links"))


def jaccard_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    members = stored(members_of(docs, size, id_col, text_col), "members")
    texts = docs.select(F.col(text_col).alias("text"))
    total = members.agg(F.sum("n")).first()[0] or 0
    sets = sets_of(texts, stored(linkable(texts, total, size, percent), "linkable"), size)
    roots = stored(components(stored(links_of(sets, percent, block), "links")), "roots")
    roots = roots.unionAll(roots.select("root", "root").distinct())  # a root is a key of its own
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id")))
    # Sets that several documents have, or that link: only they need an answer.
    own = members.filter("digest is not null").groupBy("digest").agg(least.alias("least"), F.count("*").alias("copies"))
    linked = sets.select("sid", "digest").join(roots.withColumnRenamed("key", "sid"), "sid").select("digest", "root")
    known = stored(own.join(linked, "digest", "left").filter("copies > 1 or root is not null"), "known")
    best = known.filter("root is not null").groupBy("root").agg(F.min("least").alias("best"))
    named = stored(known.join(best, "root", "left").select("digest", F.coalesce("best", "least")["doc_id"].alias("component_id"), F.lit(True).alias("found")), "named")
    out = members.join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
