"""How filters of a corpus interact: what each removes, alone and behind the others, in every order.

A filter's effect at a step depends on the set of filters applied before, not on their order: an edge (filters already applied, next
filter) of the lattice of subsets. Five filters have 80 edges, and their 120 orders are 120 paths of 5 edges. So documents
are counted once by (part, failed filters, labels); each such class contributes to its 80 edges; the summed edges are joined to
the 600 steps of all orders, and weighted by the number of orders through an edge for the Shapley sums.

The filters here: A fewer than 200 words; B distinct words under half; C more than 3 % of code points in A-Z; D one of
#$%&*|; E the text of a smaller doc_id. Words are maximal runs without ASCII white space, told apart by case.

Defined results: null text is the empty text; null lang is the part ''; a null doc_id is not smaller than any, never fails E
and has no labels; of several labels of a doc_id one with the value is enough; rows that repeat a doc_id and its text are
documents each, none the copy of the other; a part without documents has no rows; an empty table gives no rows; further
columns, whatever their names, are not read. Texts are compared by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visarium.llm.arrays import binary_array, runs, steps
from visarium.llm.tables import stored
from visarium.llm.toxicity import first_in_text

FILTERS = "ABCDE"
#: Bounds of the filters A, B and C: words, per cent of distinct words, per cent of capitals.
WORDS, DISTINCT, CAPITALS = 200, 50, 3

_WORD, _SIGN = np.ones(256, bool), np.zeros(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SIGN[list(b"#$%&*|")] = True


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offs[1:]] - total[offs[:-1]]


def words_in(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text."""
    starts, ends = runs(_WORD[data], offs)
    before = np.searchsorted(starts, offs)
    if not len(starts):
        return np.diff(before), np.diff(before)
    at = np.append(np.stack([starts, ends], 1).ravel(), len(data))  # words and gaps in turn
    index = pc.dictionary_encode(binary_array(data, at)[::2]).indices.to_numpy().astype(np.int64)[: len(starts)]
    return np.diff(before), np.diff(np.concatenate([[0], np.cumsum(first_in_text(index, before))])[before])


def text_failures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 for the filters A to D that each text fails."""
    words, distinct = words_in(data, offs)
    capitals, points = _per_text((data >= 65) & (data <= 90), offs), _per_text((data & 0xC0) != 0x80, offs)
    fails = (words < WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, _per_text(_SIGN[data], offs) > 0)
    return sum(x.astype(np.int32) << k for k, x in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, part, fails (bits in order of FILTERS) of every document."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = few.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "part": part.column("part"), "digest": part.column("digest"), "fails": pa.array(text_failures(data, offs), pa.int32())})

    rows = stored(few.mapInArrow(scan, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, part string, digest binary, fails int"), "failures")
    # Only texts that come more than once travel back to their documents.
    first = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))


def classes(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, fails, good, toxic and n (documents). Rows are summed by doc_id before they meet their labels."""
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")
    known = failed.groupBy("doc_id", "part", "fails").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    return known.groupBy("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def edges(counted: DataFrame, filters: int) -> DataFrame:
    """part, done (bits of the filters applied), next (filter) and the counts of every edge of the lattice."""
    all_edges = F.array(*(F.struct(F.lit(s).alias("done"), F.lit(f).alias("next")) for f in range(filters) for s in range(1 << filters) if not s >> f & 1))
    rows = counted.withColumn("edge", F.explode(all_edges)).select("*", "edge.done", "edge.next", F.call_function("shiftleft", F.lit(1), F.col("edge.next")).alias("bit"))
    fails, gone = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("done")) != 0
    count = lambda ok, name: F.sum(F.when(ok, F.col("n")).otherwise(0)).alias(name)
    lost = fails & ~gone
    return rows.groupBy("part", "done", "next").agg(
        count(~fails & ~gone, "kept"), count(lost, "removed"), count(fails & gone, "redundant"), count(F.col("fails") == F.col("bit"), "unique_fails"),
        count(lost & (F.col("good") == 1), "good_lost"), count(lost & (F.col("toxic") == 1), "toxic_lost"),
    )


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from classes of documents: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost at the step, and shapley: what its filter removes, summed over all orders."""
    spark, n = counted.sparkSession, len(filters)
    lattice = stored(edges(counted, n), "edges")  # 80 rows a part
    # |S|! (n - 1 - |S|)! orders go through the edge from S.
    ways: Column = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("done") + 1)
    shapley = lattice.groupBy("part", "next").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    paths = [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(n)) for k, f in enumerate(order)]
    table = spark.createDataFrame(paths, "filter_order string, step int, done int, next int")
    # The steps are as many as the filters' orders have, whatever the corpus.
    found = lattice.join(shapley, ["part", "next"]).join(F.broadcast(table), ["done", "next"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The interactions of the filters A to E on documents, part by part (lang)."""
    return interactions(classes(failures(docs, id_col, text_col, lang_col), labels, id_col))
