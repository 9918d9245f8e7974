"""Exact deduplication by a tree-merge of sorted digest runs.

Every document becomes a row of 32 digest bytes; rows form runs (a hash of the row, so a hot text spreads over all
runs). In each binomial round runs whose numbers agree but for their last bits are exchanged, digest range by digest
range, sorted, and merged into one run that holds a digest once: with the best row seen and the number of rows. After
the last round one run remains, still dealt over its digest ranges. No task ever holds more than FAN_IN rows of a
digest, however many copies there are.

Defined results: null text is the empty text; null doc_id loses against any doc_id; of rows that repeat both doc_id
and text one stays; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visarium.llm.tables import stored

#: Runs at the start, and runs that one round merges into one (a power of two each).
RUNS, FAN_IN = 256, 16
#: Leading digest bytes that name a digest range.
SPAN_BYTES = 2
#: Columns that a filter adds for a while beside those that come in.
KEY, GONE = "__visarium_key", "__visarium_gone"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256), verify (length and a second hash), uid; written once, so uid is stable."""
    norm = normalised(F.col(text_col))
    return stored(
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("_n")).select(
            "doc_id",
            F.unhex(F.sha2("_n", 256)).alias("digest"),
            F.struct(F.octet_length("_n").alias("size"), F.xxhash64("_n").alias("h")).alias("verify"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )


def tree_merge(rows: DataFrame, keep: str = "min", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per digest: digest, verify, best (doc_id, uid of the row that stays), n (rows)."""
    # The second part orders rows of one doc_id; the flag puts null ids last whichever end is kept.
    known = F.col("doc_id").isNotNull()
    best = F.min(F.struct((~known).alias("no"), F.col("doc_id"), F.col("uid"))) if keep == "min" else F.max(F.struct(known.alias("no"), F.col("doc_id"), F.col("uid")))
    span = F.substring("digest", 1, SPAN_BYTES)
    level = rows.withColumns({"node": F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("int"), "span": span}).groupBy("node", "span", "digest", "verify").agg(best.alias("best"), F.count("*").alias("n"))
    bits, left = fan_in.bit_length() - 1, runs
    pick = F.min if keep == "min" else F.max
    while left > 1:
        left = max(1, left // fan_in)
        # The exchange deals each parent run over its digest ranges; the external sort merges the children's pieces.
        moved = level.withColumn("node", F.shiftright("node", bits)).repartition("node", "span").sortWithinPartitions("node", "span", "digest", "verify")
        level = moved.groupBy("node", "span", "digest", "verify").agg(pick("best").alias("best"), F.sum("n").alias("n"))
    return level.select("digest", "verify", "best", "n")


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: the group's "min" or "max" doc_id stays."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    rows = digests(docs, id_col, text_col)
    final = tree_merge(rows, keep, runs, fan_in)
    # Groups of one need no answer from the tree: only digests that met a second row travel back.
    many = stored(final.filter("n > 1"), "groups")
    joined = rows.join(many, ["digest", "verify"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, all columns as they came.

    Rows that go are told by doc_id and digest; where a doc_id comes twice with the same text, one of its rows stays.
    """
    groups = stored(exact_groups(docs, keep, id_col, text_col), "exact")
    key = F.struct(F.col(id_col).alias("a"), F.sha2(normalised(F.col(text_col)), 256).alias("b"))
    same = F.struct(F.col("doc_id").alias("a"), F.col("text_sha256").alias("b"))
    twice = groups.filter("group_size > 1").groupBy(same.alias("same")).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = twice.filter(~F.col("kept")).select(F.col("same").alias(GONE))
    keyed = docs.withColumn(KEY, key)
    left = keyed.join(gone, F.col(KEY).eqNullSafe(F.col(GONE)), "left_anti")
    if not twice.filter("kept and n > 1").isEmpty():
        left = left.dropDuplicates([KEY])
    return left.drop(KEY)
