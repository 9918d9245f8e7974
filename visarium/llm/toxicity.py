"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give each word the probability of its bytes one after another. A byte's
probability after its context (the up to CONTEXT bytes before it in the word, with the word's start) is the class's
own discounted count plus what the discounts leave, times a backoff that both classes share: continuation counts
(in how many different longer contexts something was seen) over shorter and shorter contexts. So a byte or a word that is rare
in both classes gets nearly the same probability from either, and an expression that only toxic documents hold stands
out, in spellings never seen as well.

A text's figures are the difference of log-likelihoods per word: over all its words, over its most toxic stretch of
STRETCH words, and over its most toxic stretch of different words. The counts take a word once from each document, so repeated lines don't weigh. A logistic function, fitted on a bounded sample of labelled rows (CALIBRATE of
each class), turns them into the score: each sample row is scored by counts of the other fold only.

The counts cover every labelled row with crc32(doc_id) mod 3 other than 1, at every size with the same context. They
are summed by Spark; the table of distinct byte strings goes to the driver and the workers while it has at most GRAMS
rows (24 bytes each). A larger one stays in the shared folder: the models are then tables too, and each step of
texts is joined with the strings behind its own contexts. Both ways give the same scores.

Defined results: null and wordless text has figures 0 and the score that follows; labels that are null are not read;
of several labels of a doc_id the largest counts; of rows that repeat a doc_id all are counted and one, the least by a hash of
its text, is in the calibration sample; null doc_id is not held out and never trains; without labels of both
classes every score is 0; repeated rows are scored each; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visarium.llm.arrays import as_bytes, binary_array, lowered, runs, steps
from visarium.llm.language import remainder
from visarium.llm.tables import stored

#: Bytes of context, words of a stretch, discount, threshold of `predicted`.
CONTEXT, STRETCH, DISCOUNT, THRESHOLD = 5, 32, 0.75, 0.7
#: Rows of the count table that are sent around; labelled rows that fit the score, of each class; labels joined by broadcast.
GRAMS, CALIBRATE, BROADCAST_LABELS = 6_000_000, 2000, 1_000_000

_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = _WORD[0x80:] = True
#: The byte before every word and the one behind it.
START, END = 0x02, 0x03


def words_of(data: np.ndarray, offs: np.ndarray, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (bytes and offsets), the number of each word in order, and the words before each text.

    once: a text's word counts where it stands first, so a line that repeats adds nothing."""
    low = lowered(data)
    starts, ends = runs(_WORD[low], offs)
    before = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), before
    at = np.stack([starts, ends], 1).ravel()  # words and gaps in turn
    at = np.concatenate([at, [len(data)]]) if at[-1] < len(data) else at
    coded = pc.dictionary_encode(binary_array(low, at)[::2])
    own, cuts = as_bytes(coded.dictionary)
    index = coded.indices.to_numpy().astype(np.int64)
    if not once:
        return own, cuts, index, before
    new = first_in_text(index, before)
    return own, cuts, index[new], np.concatenate([[0], np.cumsum(new)])[before]


def first_in_text(index: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which words stand in their text for the first time."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    return ~pd.Series(text * (int(index.max(initial=0)) + 1) + index).duplicated().to_numpy()


def grams(own: np.ndarray, cuts: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every word and its end: the packed string of context and byte, and the word.

    A string of up to 7 bytes is one integer: its bytes from the high end, so strings with one context are neighbours.
    """
    size = np.diff(cuts)
    word = np.repeat(np.arange(len(size)), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    place = np.arange(len(word)) - first[word]  # the byte's place in its word
    text = np.full(len(word), END, np.int64)
    text[place < size[word]] = own
    key = text.copy()
    for k in range(1, context + 1):
        prev = np.where(place - k >= 0, text[np.maximum(np.arange(len(text)) - k, 0)], np.where(place - k == -1, START, 0))
        key |= prev << (8 * k)
    return key, word


class Model:
    """Log-likelihood ratios of words, from counts by packed string: toxic (n1) and ordinary (n0)."""

    def __init__(self, keys: np.ndarray, n1: np.ndarray, n0: np.ndarray, context: int = CONTEXT, discount: float = DISCOUNT):
        order = np.argsort(keys)
        keys, counts = keys[order], (n1[order].astype(float), n0[order].astype(float))
        self.context = context
        shared = self._shared(keys, context)
        ctx, where = np.unique(keys >> 8, return_inverse=True)
        p, rest = [], []
        for n in counts:
            total, kinds = np.bincount(where, n, len(ctx)), np.bincount(where, n > 0, len(ctx))
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.where(total[where] > 0, np.maximum(n - discount, 0) / np.maximum(total[where], 1), 0.0)
            p.append(own + left[where] * shared)
            rest.append(left)
        self.keys, self.ctx = keys, ctx
        self.ratio = np.log(p[0] / p[1]).astype(np.float32)
        self.unseen = np.log(rest[0] / rest[1]).astype(np.float32)

    @classmethod
    def of(cls, keys: np.ndarray, ratio: np.ndarray, unseen: np.ndarray, context: int) -> Model:
        """The part of a model that its strings with some of the contexts make; unseen: of each string's context."""
        m = cls.__new__(cls)
        order = np.argsort(keys)
        m.context = context
        m.keys, m.ratio = np.append(-1, keys[order]), np.append(np.float32(0), ratio[order])  # never empty
        m.ctx, first = np.unique(m.keys >> 8, return_index=True)
        m.unseen = np.append(np.float32(0), unseen[order])[first]
        return m

    @staticmethod
    def _shared(keys: np.ndarray, context: int, discount: float = DISCOUNT) -> np.ndarray:
        """Backoff probability of each string's last byte after its context less the first byte: Kneser-Ney over both classes."""
        # At each level: the distinct strings, and in how many strings of the level above each ends.
        level, links = [keys], []
        for k in range(context, 0, -1):
            short, to = np.unique(level[-1] & ((1 << (8 * k)) - 1), return_inverse=True)
            level.append(short)
            links.append(to)
        below = np.full(len(level[-1]), 1 / 256)
        for k in range(len(links) - 1, -1, -1):
            strings, n = level[k + 1], np.bincount(links[k], minlength=len(level[k + 1])).astype(float)
            _, where = np.unique(strings >> 8, return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            # `below` is for the strings without their first byte.
            p = np.maximum(n - discount, 0) / total[where] + discount * (kinds / total)[where] * below
            below = p[links[k]]
        return below

    def of_words(self, own: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each distinct word."""
        key, word = grams(own, cuts, self.context)
        if not len(key):
            return np.zeros(len(cuts) - 1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ctx = np.minimum(np.searchsorted(self.ctx, key >> 8), len(self.ctx) - 1)
        value = np.where(self.keys[at] == key, self.ratio[at], np.where(self.ctx[ctx] == key >> 8, self.unseen[ctx], 0))
        return np.bincount(word, value, len(cuts) - 1)

    def figures(self, data: np.ndarray, offs: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Of each text: the difference per word over all words, over the most toxic stretch, and over the most toxic
        stretch of different words (divided by a whole stretch's words)."""
        own, cuts, index, before = words_of(data, offs)
        out = np.zeros((len(offs) - 1, 3))
        if not len(index):
            return out
        value = self.of_words(own, cuts)
        n = np.diff(before)
        full = np.flatnonzero(n)
        total = np.concatenate([[0], np.cumsum(value[index])])
        out[full, 0] = ((total[before[1:]] - total[before[:-1]]) / np.maximum(n, 1))[full]
        out[full, 1] = (_best_stretch(value[index], before, stretch) / np.minimum(stretch, np.maximum(n, 1)))[full]
        new = first_in_text(index, before)
        out[full, 2] = (_best_stretch(value[index[new]], np.concatenate([[0], np.cumsum(new)])[before], stretch) / stretch)[full]
        return out


def _best_stretch(values: np.ndarray, before: np.ndarray, stretch: int) -> np.ndarray:
    """The largest sum of so many neighbours in each text, or of the whole text if it is shorter; 0 without words."""
    total = np.concatenate([[0], np.cumsum(values)])
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    i = np.arange(len(values))
    end = np.minimum(i + stretch, before[1:][text])
    some = total[end] - total[i]
    some[(end - i < stretch) & (i > before[:-1][text])] = -np.inf
    out = np.zeros(len(before) - 1)
    full = np.flatnonzero(np.diff(before))
    out[full] = np.maximum.reduceat(some, before[:-1][full])
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, text, toxic, fold of rows that may train: a label, and crc32(doc_id) mod 3 other than 1."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.filter(remainder(F.col("doc_id")) != 1)
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(remainder(F.col("doc_id")) != 1)
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return few.join(marks, "doc_id").select("doc_id", "text", "toxic", remainder(F.col("doc_id")).alias("fold"))


def counts(rows: DataFrame, context: int) -> DataFrame:
    """gram and its counts by class and fold: t0, t2 of toxic, o0, o2 of ordinary rows."""
    names = ["t0", "t2", "o0", "o2"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            own, cuts, index, before = words_of(data, offs, once=True)
            kind = np.where(part.column("toxic").to_numpy() > 0, 0, 2) + (part.column("fold").to_numpy() == 2)
            key, word = grams(own, cuts, context)
            if not len(key):
                continue
            cells = np.bincount(index * 4 + np.repeat(kind, np.diff(before)), minlength=4 * (len(cuts) - 1)).reshape(-1, 4)[word]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            sums = np.add.reduceat(cells[order], first, axis=0)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(key[order][first])} | {c: pa.array(sums[:, k].astype(np.int64)) for k, c in enumerate(names)})

    found = rows.select("text", "toxic", F.col("fold").cast("int").alias("fold")).mapInArrow(scan, "gram bigint, t0 bigint, t2 bigint, o0 bigint, o2 bigint")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and intercept by Newton's method with a small ridge, both classes weighing the same."""
    a = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(a.shape[1]), np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w = w - move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
    return w


def _model_table(table: DataFrame, n1: Column, n0: Column, context: int, discount: float = DISCOUNT) -> DataFrame:
    """What Model holds, as a table of any size: gram, ctx, ratio, unseen. A context has 256 strings at most."""
    keys = table.select("gram", n1.alias("n1"), n0.alias("n0")).filter("n1 + n0 > 0")
    # The levels of Model._shared: the distinct strings of k bytes, and in how many of k + 1 bytes each ends.
    levels = [keys.select(F.col("gram").alias("s"))]
    for k in range(context, 0, -1):
        levels.append(stored(levels[-1].groupBy(F.col("s").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("s")).agg(F.count("*").cast("double").alias("n")), "level"))
    below = None
    for k, level in enumerate(reversed(levels[1:])):  # strings of k + 1 bytes
        of = Window.partitionBy(F.shiftright("s", 8))
        sums = level.withColumn("total", F.sum("n").over(of)).withColumn("kinds", F.count("*").over(of))
        if below is None:
            sums = sums.withColumn("below", F.lit(1 / 256))
        else:
            sums = sums.withColumn("end", F.col("s").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(below, "end")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * (F.col("kinds") / F.col("total")) * F.col("below")
        below = sums.select(F.col("s").alias("end"), p.alias("below"))
    of = Window.partitionBy("ctx")
    rows = keys.withColumn("ctx", F.shiftright("gram", 8)).withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << (8 * context)) - 1))).join(below, "end")
    p, rest = [], []
    for n in ("n1", "n0"):
        total, kinds = F.sum(n).over(of), F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).over(of)
        left = F.when(total > 0, discount * kinds / F.greatest(total, F.lit(1))).otherwise(1.0)
        own = F.when(total > 0, F.greatest(F.col(n) - discount, F.lit(0.0)) / F.greatest(total, F.lit(1))).otherwise(0.0)
        p.append(own + left * F.col("below"))
        rest.append(left)
    return stored(rows.select("gram", "ctx", F.log(p[0] / p[1]).cast("float").alias("ratio"), F.log(rest[0] / rest[1]).cast("float").alias("unseen")), "model")


def _by_join(rows: DataFrame, model: DataFrame, context: int, out: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """out of rows (with a column text) and their figures, by a model that is a table. A step asks once for each context."""
    few = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for k, (part, _, _) in enumerate(steps(batches)):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, first + k, np.int64))], [*few, "step"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            step = part.column("step").to_numpy()
            cut = np.concatenate([np.flatnonzero(np.diff(step, prepend=-1)), [len(step)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own, ends, _, _ = words_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ctx = np.unique(grams(own, ends, context)[0] >> 8)
                yield pa.RecordBatch.from_pydict({"step": pa.array(np.full(len(ctx), step[a])), "ctx": pa.array(ctx)})

    def answer(part: pa.Table, near: pa.Table) -> pa.Table:
        gram, first = np.unique(near.column("gram").to_numpy(), return_index=True)  # a step that was read in two pieces asks twice
        m = Model.of(gram, near.column("ratio").to_numpy()[first], near.column("unseen").to_numpy()[first], context)
        return out(part, m.figures(*as_bytes(part.column("text"))))

    placed = stored(rows.mapInArrow(number, rows.withColumn("step", F.lit(0).cast("long")).schema), "steps")
    near = placed.select("step", "text").mapInArrow(ask, "step bigint, ctx bigint").join(model, "ctx").select("step", "gram", "ratio", "unseen")
    return placed.groupBy("step").cogroup(near.groupBy("step")).applyInArrow(answer, schema)


def fit(docs: DataFrame, labels: DataFrame, context: int = CONTEXT, most: int = GRAMS) -> tuple[Model | DataFrame, np.ndarray] | None:
    """The model of all counts, as a table if it has more than so many strings, and the weights of the score; None without
    rows of both classes."""
    rows = labelled(docs, labels)
    table = stored(counts(rows, context), "grams")
    toxic, plain, *by_fold = table.agg(*(F.sum(F.expr(x)) for x in ("t0 + t2", "o0 + o2", "t0 + o0", "t2 + o2"))).first()
    if not toxic or not plain:
        return None
    # The sample is drawn by a hash of doc_id, one row an id however often it comes; its bound holds for either class, whatever the
    # corpus' size.
    keyed = rows.withColumn("row", F.xxhash64("text"))
    ids = stored(keyed.groupBy("doc_id").agg(F.min(F.struct("row", "toxic")).alias("one")).select("doc_id", "one.*"), "calibration")
    sizes = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20))
    bound = lambda k: int(min(1, CALIBRATE / max(sizes.get(k, 1), 1)) * (1 << 20)) + 1
    drawn = ids.filter(draw < F.when(F.col("toxic") > 0, bound(1)).otherwise(bound(0))).select("doc_id", "row")
    own = keyed.join(F.broadcast(drawn), ["doc_id", "row"]).groupBy("doc_id", "row").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold"))
    sample = own.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))
    kind = "a double, b double, c double, toxic int"
    if table.count() > most:
        whole = _model_table(table, F.col("t0") + F.col("t2"), F.col("o0") + F.col("o2"), context)
        out = lambda part, x: pa.table({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "toxic": part.column("toxic")})
        found = None
        for fold, other, n in ((0, "2", by_fold[1]), (2, "0", by_fold[0])):
            part = _model_table(table, F.col(f"t{other}"), F.col(f"o{other}"), context) if n else whole
            scored = _by_join(sample.filter(F.col("fold") == fold), part, context, out, kind)
            found = scored if found is None else found.unionAll(scored)
        return whole, _weights(found.toArrow())
    table = table.toArrow()
    c = {k: table.column(k).to_numpy() for k in ("gram", "t0", "t2", "o0", "o2")}
    whole = Model(c["gram"], c["t0"] + c["t2"], c["o0"] + c["o2"], context)
    parts = {}
    for fold, other in ((0, "2"), (2, "0")):
        seen = (c[f"t{other}"] + c[f"o{other}"]) > 0
        parts[fold] = Model(c["gram"][seen], c[f"t{other}"][seen], c[f"o{other}"][seen], context) if seen.any() else whole
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            fold = part.column("fold").to_numpy()
            x = np.where((fold == 0)[:, None], sent.value[0].figures(data, offs), sent.value[2].figures(data, offs))
            yield pa.RecordBatch.from_pydict({"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1]), "c": pa.array(x[:, 2]), "toxic": part.column("toxic")})

    return whole, _weights(sample.mapInArrow(scan, kind).toArrow())


def _weights(seen: pa.Table) -> np.ndarray:
    """The score's weights from the sample's figures and labels."""
    x, y = np.column_stack([seen.column("a"), seen.column("b"), seen.column("c")]), seen.column("toxic").to_numpy()
    order = np.lexsort((y, x[:, 2], x[:, 1], x[:, 0]))  # sums in one order, whichever task came first
    return _logistic(x[order], y[order])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, most: int = GRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    fitted = fit(docs, labels, context, most)
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    schema = f"doc_id {few.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def columns(part: pa.RecordBatch | pa.Table, score: np.ndarray) -> dict:
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    def scored(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))

    if fitted is not None and isinstance(fitted[0], DataFrame):
        model, weights = fitted
        return _by_join(few, model, context, lambda part, x: pa.table(columns(part, scored(x, weights))), schema)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            if sent.value is None:
                score = np.zeros(part.num_rows)
            else:
                model, w = sent.value
                score = scored(model.figures(data, offs), w)
            yield pa.RecordBatch.from_pydict(columns(part, score))

    return few.mapInArrow(scan, schema)
