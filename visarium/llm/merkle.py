"""A Merkle manifest of a dataset: a digest for every row, one for every source, one for all, and a proof for every row.

Rows of a source in order of their ids are the leaves of a tree; ARITY neighbours make a parent, level by level, until one
node remains: the source's root. These, in order of the sources, are the leaves of the last tree, whose root stands for all.

Trees grow by events, as combineByKey does: a digest arrives at its parent, which holds the digests that have come, by index. A node's
index and the size of its tree tell how many children its parent waits for; when they are there the parent is hashed and is
itself an event for its own parent. A task that reads a stretch of leaves so finishes all ancestors that lie within the stretch.
Nodes whose parents lack children (a few at either end of a stretch) are the frontier: they are dealt out by an ancestor CLIMB levels up
and climb on, until nothing waits. Every finished parent is a row with its children; going back down
from the roots, a run's proof is its parent's siblings and the proof of the parent's run, so a row is joined to at most ARITY others.

Defined results: a field that is null is hashed as `-`, so null and empty differ; null ids and null sources come first; rows that
repeat an id are ordered by their leaves, equal rows get equal leaves and proofs of their own; a source of one row has its leaf as
root; an empty table gives no rows; further columns, whatever their names, are neither hashed nor read; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.llm.tables import stored

#: Children of a node; levels that a reshuffled frontier can climb in one task.
ARITY, CLIMB = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the sources' roots.
TOP = -1
_PROOF = "array<struct<left:string,right:string>>"
_NODES = "tree bigint, size bigint, level int, idx bigint, digest string, children array<string>"


def record_digest(*fields: Column) -> Column:
    """Hex SHA-256 of fields, each `-` where null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def levels(size: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def _height() -> Column:
    """levels() of a tree with so many leaves as column size says."""
    return sum((F.when(F.col("size") > ARITY**k, 1).otherwise(0) for k in range(1, 15)), F.when(F.col("size") > 1, 1).otherwise(0))


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lets nodes (tree, size, level, idx, digest) arrive at their parents. Out come finished parents (children set, idx the
    parent's, level the children's), roots (the level of the root, one child: itself), and the nodes that wait."""
    waiting: dict[tuple[int, int, int, int], dict[int, str]] = {}
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tree", "size", "level", "idx", "digest", "children"])
        out.clear()
        return batch

    for batch in batches:
        for tree, size, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "level", "idx", "digest")), strict=True):
            height = levels(size)
            while True:
                if level == height:
                    out.append((tree, size, level, 0, None, [digest]))
                    break
                up = idx // ARITY
                at = waiting.setdefault((tree, size, level, up), {})
                at[idx % ARITY] = digest
                if len(at) < min(ARITY, -(-size // ARITY**level) - ARITY * up):
                    break
                children = [at[k] for k in sorted(at)]
                del waiting[tree, size, level, up]
                out.append((tree, size, level, up, None, children))
                level, idx, digest = level + 1, up, hashlib.sha256("".join(children).encode()).hexdigest()
        if len(out) > 10_000:
            yield table()
    for (tree, size, level, up), at in waiting.items():
        out.extend((tree, size, level, up * ARITY + k, d, None) for k, d in at.items())
    yield table()


def grown(nodes: DataFrame) -> DataFrame:
    """All finished parents and the roots of the trees over leaves (tree, size, idx, digest)."""
    events = nodes.select("tree", "size", F.lit(0).alias("level"), "idx", "digest").sortWithinPartitions("tree", "idx")
    done = []
    while True:
        found = stored(events.mapInArrow(climb, _NODES), "climb")
        done.append(found.filter("children is not null"))
        frontier = found.filter("children is null")
        lowest = frontier.agg(F.min("level")).first()[0]
        if lowest is None:
            return reduce(DataFrame.unionAll, done)
        # Nodes below one node of the level to reach meet in one task: at most ARITY ** CLIMB of the lowest level.
        ancestor = F.expr(f"shiftright(idx, {ARITY.bit_length() - 1} * greatest(0, {lowest + CLIMB} - level))")
        events = frontier.drop("children").withColumn("up", ancestor).repartition("tree", "up").sortWithinPartitions("tree", "level", "idx").drop("up")


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, written in order of the group and then of the columns, with a running number `at`; and the spans
    (part, group, start, n, before, size) that tell a row's place in its group: at - start + before. A group may lie in any number of
    parts; what is summed over parts is one row a part."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    tie = F.col("__tie").asc()  # rows equal in all keys may part
    ordered = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop("__tie")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    spans = ordered.groupBy(F.shiftright("at", 33).alias("part"), group).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    own = Window.partitionBy(group)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ordered, stored(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("size", F.sum("n").over(own)), "spans")


def _beside(children: Column, pos: Column) -> Column:
    """What stands left and right of a child, as a step of a proof."""
    return F.struct(F.array_join(F.slice(children, 1, pos), "").alias("left"), F.array_join(F.slice(children, pos + 2, ARITY), "").alias("right"))


def _proved(runs: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """The lowest runs (tree, idx, children) of all trees with `above`: the proof from the run's parent on. tops: tree, above
    and further columns that belong to the tree's root; without them the roots are the last. A tree of one leaf has a run without children."""
    runs = runs.withColumn("height", _height())
    highest = runs.agg(F.max("height")).first()[0] or 0
    names = ["above"] if tops is None else [c for c in tops.columns if c != "tree"]
    begun = lambda rows: rows.withColumn("above", F.array().cast(_PROOF)) if tops is None else rows.join(tops, "tree")
    none = F.lit(None).cast("array<string>")
    single = begun(runs.filter("height = 0").select("tree", "idx", none.alias("children")))
    below = None
    for level in range(highest - 1, -1, -1):
        here = runs.filter((F.col("level") == level) & (F.col("height") > level))
        out = begun(here.filter(F.col("height") == level + 1).select("tree", "idx", "children"))
        if below is not None:
            link = here.filter(F.col("height") > level + 1).select("tree", "idx", "children", F.shiftright("idx", 4).alias("up"), F.col("idx").bitwiseAND(F.lit(ARITY - 1)).cast("int").alias("pos"))
            over = below.select("tree", F.col("idx").alias("up"), F.col("children").alias("row"), *names)
            step = link.join(over, ["tree", "up"]).withColumn("above", F.concat(F.array(_beside(F.col("row"), F.col("pos"))), "above"))
            out = out.unionByName(step.select("tree", "idx", "children", *names))
        below = out
    return single if below is None else single.unionByName(below)


def _with_proofs(leaves: DataFrame, proved: DataFrame) -> DataFrame:
    """leaves (tree, idx, ...) with `proof`: the steps from the leaf to the last root."""
    run = proved.withColumnRenamed("idx", "run")
    pos = F.col("idx").bitwiseAND(F.lit(ARITY - 1)).cast("int")
    proof = F.when(F.col("children").isNull(), F.col("above")).otherwise(F.concat(F.array(_beside(F.col("children"), pos)), "above"))
    return leaves.withColumn("run", F.shiftright("idx", 4)).join(run, ["tree", "run"]).withColumn("proof", proof).drop("run", "children", "above")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all digests of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def merkle_manifest(docs: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof (array of left and right), and claimed: an expression over docs,
    such as the digest that somebody else has of the row."""
    leaf = record_digest(*(F.col(f) for f in fields))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed")), "leaves")
    ordered, spans = placed(rows, "source", ["doc_id", "leaf"])
    # The trees in order of their sources, numbered in the same way; a source may be null.
    some, parts = placed(spans.groupBy("source").agg(F.first("size").alias("size")).withColumn("all", F.lit(0)), "all", ["source"])
    place = (F.col("at") - F.col("start") + F.col("before")).alias("tree")
    trees = stored(some.join(parts.drop("all").withColumnRenamed("size", "trees"), F.shiftright("at", 33) == F.col("part")).select(F.col("source").alias("name"), place, "trees"), "trees")
    spans = stored(spans.join(trees, F.col("source").eqNullSafe(F.col("name"))).select("part", F.col("source").alias("of"), "start", "before", "size", "tree"), "spans")
    numbered = ordered.join(spans, (F.shiftright("at", 33) == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    leaves = stored(numbered.select("doc_id", "source", "leaf", "claimed", "tree", "size", (F.col("at") - F.col("start") + F.col("before")).alias("idx")), "numbered")
    runs = stored(grown(leaves.select("tree", "size", "idx", F.col("leaf").alias("digest"))), "runs")
    ends = runs.filter(F.col("level") == _height())
    subroots = stored(ends.select("tree", F.col("children")[0].alias("subroot")).join(trees.select("tree", "trees"), "tree"), "subroots")
    last = stored(grown(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("trees").alias("size"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))), "runs")
    top = last.orderBy(F.col("level").desc()).select(F.col("children")[0]).first()  # one digest
    root = F.lit(top[0] if top else None)
    above = _with_proofs(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "subroot"), _proved(last))
    tops = stored(above.select(F.col("idx").alias("tree"), F.col("proof").alias("above"), "subroot"), "tops")
    return _with_proofs(leaves.drop("size"), _proved(runs, tops)).select("doc_id", "source", "leaf", "subroot", root.alias("root"), "proof", "claimed")


def tampered_digest(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row as somebody would have it who lower-cases A-Z in the text of every row with crc32(doc_id) divisible by 5."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(hit, F.translate(F.col(text_col), upper, lower)).otherwise(F.col(text_col))
    return record_digest(*(text if f == text_col else F.col(f) for f in fields))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Every row's proof, checked against a copy in which some texts were tampered with: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified."""
    found = merkle_manifest(docs, tampered_digest())
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
