"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions run through the whole text and label its every byte; the document's probabilities are the mean over
all its bytes. To work on many bytes at once a text is read in chunks of CHUNK bytes; each direction comes from WARM
bytes before the chunk (behind it, for the way back), so its state runs on from there, and a text's first and last
byte stand beside edges. Chunks of a step that are the same, with what stands around them, are read once.

The network is trained in numpy by backpropagation through time on a bounded sample of the labelled rows with
crc32(doc_id) mod 3 other than 1: PER_CLASS doc_ids of each language, with one row each. Training windows are drawn from their whole
texts: all windows, or where there are more than WINDOWS an even draw. Only text and lang of those rows are ever read for
it, and only text for a prediction.

Defined results: null text and text without a letter are `und` with score 0; without labelled rows all are `und`;
null doc_id is never used for training and is not held out; rows that repeat a doc_id are labelled each, and one of
them, the least by a hash of text and lang, may train; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visarium.llm.arrays import steps, take_ragged
from visarium.llm.gru import EDGE, BiGRU
from visarium.llm.tables import stored

UNDEFINED = "und"
#: Bytes of a chunk, and of the text around it that is read before it; chunks that are read at once, and
#: that are compared with each other.
CHUNK, WARM, BATCH, BLOCK = 256, 24, 4096, 8192
#: Training documents of a language and windows of all; bytes of a window; network units and training steps.
PER_CLASS, WINDOWS, WINDOW, UNITS, STEPS = 250, 40_000, 48, 8, 400
#: Documents whose best language has a lower mean probability hold no language.
LEAST_SCORE = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def chunked(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and bytes of the chunks of all texts: every byte lies in one."""
    n = -(-np.diff(offs) // size)
    text = np.repeat(np.arange(len(n)), n)
    start = offs[:-1][text] + size * take_ragged(np.zeros(len(n), np.int64), n)
    return text, start, np.minimum(start + size, offs[1:][text]) - start


def codes_of(data: np.ndarray, offs: np.ndarray, text: np.ndarray, start: np.ndarray, size: int, warm: int) -> np.ndarray:
    """Codes (chunks x warm + size + warm) of the bytes from before each chunk to behind it; edges outside of its text."""
    kind = np.int32 if len(data) < 1 << 30 else np.int64
    at = start[:, None].astype(kind) + np.arange(-warm, size + warm, dtype=kind)
    outside = (at < offs[:-1][text][:, None]) | (at >= offs[1:][text][:, None])
    out = data[np.clip(at, 0, len(data) - 1, out=at)].astype(np.int16)
    out[outside] = EDGE
    return out


def label_texts(net: BiGRU, data: np.ndarray, offs: np.ndarray, size: int = CHUNK, warm: int = WARM) -> np.ndarray:
    """Mean class probabilities over all bytes of each text; zeros for an empty text."""
    classes = len(net.p["bias"])
    total = np.zeros((len(offs) - 1, classes))
    if not len(data):
        return total
    text, start, lens = chunked(data, offs, size)
    sums, many = np.empty((len(text), classes), np.float32), max(64, min(BATCH, (1 << 22) // (size * classes)))
    for k in range(0, len(text), BLOCK):
        sums[k : k + BLOCK] = _chunk_sums(net, codes_of(data, offs, text[k : k + BLOCK], start[k : k + BLOCK], size, warm), lens[k : k + BLOCK], warm, many)
    full = np.flatnonzero(np.diff(offs))
    total[full] = np.add.reduceat(sums, np.searchsorted(start, offs[:-1][full]), axis=0, dtype=np.float64)
    return total / np.maximum(np.diff(offs), 1)[:, None]


def _chunk_sums(net: BiGRU, codes: np.ndarray, lens: np.ndarray, warm: int, many: int) -> np.ndarray:
    """Sums of the class probabilities over each chunk's own bytes; chunks with the same codes are read once."""
    raw = pa.Array.from_buffers(pa.binary(codes.shape[1] * 2), len(codes), [None, pa.py_buffer(codes)])
    which = pc.dictionary_encode(raw).indices.to_numpy()
    first = np.full(int(which.max()) + 1, len(which))
    np.minimum.at(first, which, np.arange(len(which)))
    distinct = np.empty((len(first), len(net.p["bias"])), np.float32)
    order = np.argsort(-lens[first], kind="stable")
    for k in range(0, len(order), many):
        some = first[order[k : k + many]]
        distinct[order[k : k + many]] = net.sums(np.ascontiguousarray(codes[some].T[: 2 * warm + lens[some[0]]]), lens[some], warm)
    return distinct[which]


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])
    out = plain[offs[1:]] > plain[offs[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for k in np.flatnonzero(~out & (wide[offs[1:]] > wide[offs[:-1]])):
        out[k] = any(c.isalpha() for c in data[offs[k] : offs[k + 1]].tobytes().decode())
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, training_steps: int = STEPS) -> tuple[list[str], BiGRU | None]:
    """Languages and network, from a bounded sample of the labelled rows that are not held out."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(F.col(id_col)) != 1)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.withColumn("row", F.xxhash64("text", "lang"))
    # A doc_id trains with one of its rows, however often it comes: ids are counted and drawn, not rows.
    ids = stored(known.groupBy("id").agg(F.min(F.struct("row", "lang", F.octet_length("text").alias("size"))).alias("one")).select("id", "one.*"), "trainable")
    counts = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}
    if not counts:
        return [], None
    langs = sorted(counts)
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40))
    # About 1.5 times the documents wanted of each language pass; of those the ones drawn first are taken.
    bound = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, int(min(1, 1.5 * (per_class + 20) / counts[k]) * (1 << 40)) + 1))), F.col("lang"))
    sizes: dict[str, list] = {k: [] for k in langs}
    for r in ids.select("lang", "row", "size", "id", draw.alias("draw")).filter(F.col("draw") < bound).collect():
        sizes[r.lang].append((r.draw, r.row, r.size, r.id))
    taken = {k: sorted(v)[:per_class] for k, v in sizes.items()}
    share = min(1.0, WINDOWS / max(1, sum(-(-n // WINDOW) for v in taken.values() for _, _, n, _ in v)))
    number = {k: i for i, k in enumerate(langs)}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            text, start, _ = chunked(data, offs, WINDOW)
            n = np.bincount(text, minlength=part.num_rows)
            drawn = [np.random.default_rng(k).random(m) for k, m in zip(part.column("draw").to_pylist(), n.tolist(), strict=True)]
            keep = np.flatnonzero(np.concatenate(drawn) < share)
            label = np.array([number[x] for x in part.column("lang").to_pylist()], np.int32)
            codes = codes_of(data, offs, text[keep], start[keep], WINDOW, WARM) if len(keep) else np.zeros((0, WINDOW + 2 * WARM), np.int16)
            yield pa.RecordBatch.from_pydict({"label": pa.array(label[text[keep]]), "codes": pa.array([x.tobytes() for x in codes], pa.binary())})

    # PER_CLASS rows of each language; equal rows of one id are the same row.
    wanted = docs.sparkSession.createDataFrame([(d, r, i) for v in taken.values() for d, r, _, i in v], T.StructType([T.StructField("draw", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", ids.schema["id"].dataType)]))
    rows = known.join(F.broadcast(wanted), ["id", "row"]).groupBy("id", "row", "lang", "draw").agg(F.first("text").alias("text"))
    drawn = rows.select("lang", "text", "draw").mapInArrow(windows, "label int, codes binary").toArrow()
    net = BiGRU(len(langs), UNITS)
    if len(langs) > 1 and drawn.num_rows:
        drawn = drawn.sort_by([("label", "ascending"), ("codes", "ascending")])
        x = np.frombuffer(b"".join(drawn["codes"].to_pylist()), np.int16).reshape(drawn.num_rows, -1)
        net.train(x, drawn["label"].to_numpy(), training_steps)
    return langs, net


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, training_steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    langs, net = fit(docs, id_col, text_col, lang_col, per_class, training_steps)
    sent = docs.sparkSession.sparkContext.broadcast((langs, net))  # some 30 KB, whatever the corpus
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches):
            lang, score = predict(*sent.value, data, offs)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return few.mapInArrow(scan, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def predict(langs: list[str], net: BiGRU | None, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    ok = has_letter(data, offs)
    if net is None:
        return [UNDEFINED] * len(ok), np.zeros(len(ok))
    p = label_texts(net, data, offs)
    best = p.argmax(1)
    return [langs[k] if yes else UNDEFINED for k, yes in zip(best, ok, strict=True)], np.where(ok, np.clip(p.max(1), 0, 1), 0.0)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The documents in which a language is found, all columns as they came. The rest are rejected: those without a letter,
    and those whose bytes the network ascribes to no language with a mean probability of least."""
    langs, net = fit(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast((langs, net))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in steps(batches, text_col):
            langs, net = sent.value
            if net is None:  # nothing was labelled: there is no language to tell
                yield part.filter(pa.array(has_letter(data, offs)))
                continue
            lang, score = predict(langs, net, data, offs)
            yield part.filter(pa.array([x != UNDEFINED and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
