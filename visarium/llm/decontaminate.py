"""Benchmark decontamination by suffix arrays over the training words.

A step's documents are one shard: their words, in order, are a sequence of numbers (the word's number among the
benchmark's words, 0 for any other word and behind each document). The shard's suffix array orders every suffix that
begins with a benchmark word, by as many words as the longest item has (a word that no item has ends a suffix: nothing
matches across it). It is sorted by prefix doubling. Every suffix of every benchmark item is then looked up: binary
searches narrow its stretch of the array word by word, down to its longest verbatim match. The stretch at the window's
length has all places of the window; the stretches below it tell how far each place goes on matching. Suffixes with the same
words are narrowed once, whatever number of items share them: what is held grows with the places and with the pairs of document and
item found, not with items times places. A document is never split, so what it holds is known where it was read: no shuffle.

The benchmark is the stated query set. Up to BLOCK_BYTES of it are looked up at a time; a larger benchmark is
taken in blocks, whose hits meet by row afterwards. A worker prepares a block once, not once a task.

Defined results: null or wordless text has no words, no hits and is clean; a null or wordless item has no windows;
of items that repeat an item_id each counts, the id once; a null item_id is not listed; of equally long matches with an
item the first in the document counts, then the first in the item; empty tables give no rows, or clean rows; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visarium.llm.arrays import runs, steps, take_ragged
from visarium.llm.simhash import ROW
from visarium.llm.tables import stored

#: Words of a window; the benchmark text that is looked up at once.
WINDOW, BLOCK_BYTES = 13, 16 << 20
#: A document is contaminated when its hit words are this share of all, or more: 1 / SHARE.
SHARE = 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(1 << 16)


def word_hashes(low: np.ndarray, offs: np.ndarray, salt: int = 0, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of every word of lower-cased bytes, and the number of words before each text. word: bytes that make one."""
    starts, ends = runs(word[low], offs)
    before = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, before
    lens = ends - starts
    mixed = np.zeros(len(starts), np.uint64)
    if lens.max() >= len(_POW):  # words of 64 KB and more: one by one
        for k in np.flatnonzero(lens >= len(_POW)):
            mixed[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little") ^ salt
    # Column by column: position j of all words that are longer than j.
    alive = np.flatnonzero(lens < len(_POW))
    h = np.full(len(alive), 0xCBF29CE484222325 ^ salt, np.uint64)
    at, left = starts[alive], lens[alive]
    order = np.argsort(-left.astype(np.int32), kind="stable") if len(left) else np.zeros(0, np.int64)
    at, left, alive = at[order], left[order], alive[order]
    counts = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for j, n in enumerate(counts):
        x = h[:n]
        x ^= low[at[:n] + j]
        x *= np.uint64(0x100000001B3)
        x ^= x >> np.uint64(29)
    mixed[alive] = h
    return mixed, starts, ends, before


def _same_bytes(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces of two byte arrays are equal; size: of both pieces."""
    k = np.repeat(np.arange(len(size)), size)
    other = x[take_ragged(x_at, size)] != y[take_ragged(y_at, size)]
    return np.bincount(k[other], minlength=len(size)) == 0


class Benchmark:
    """The items of one block: their words as numbers, and where their windows are."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.low = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        salt = 0
        while True:
            h, starts, ends, before = word_hashes(self.low, offs, salt)
            self.vocab, at, code = np.unique(h, return_index=True, return_inverse=True)
            self.word_at, self.word_size = starts[at], (ends - starts)[at]
            size = ends - starts
            if (size == self.word_size[code]).all() and _same_bytes(self.low, starts, self.low, self.word_at[code], size).all():
                break
            salt += 1  # two words with one hash: number them by another
        self.salt = salt
        self.code = (code + 1).astype(np.int64)
        self.before = before
        n = np.diff(before)
        self.item = np.repeat(np.arange(len(n)), n)
        #: Words from each place to the item's end, and the words of the window that begins there (0: none does).
        self.left = before[1:][self.item] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
        size = np.minimum(n, window)[self.item]
        self.window = np.where(self.left >= size, size, 0)
        self.depth = int(n.max(initial=0))
        self.bits = max(1, int(len(self.vocab)).bit_length())
        self.small = np.zeros(1 << 22, bool)
        self.small[(self.vocab & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The benchmark's number of each word, 0 if it has none."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.small[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(maybe) and len(self.vocab):
            at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
            ok = self.vocab[at] == h[maybe]
            out[maybe[ok]] = at[ok] + 1
        return out


class SuffixArray:
    """All suffixes of a shard that begin with a benchmark word, in order of their words."""

    def __init__(self, code: np.ndarray, before: np.ndarray, bits: int, depth: int):
        """code: number of each word, 0 for none; before: words before each text; depth: words that the order goes by."""
        n = np.diff(before)
        place = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
        self.seq = np.zeros(len(code) + len(n) + 1, np.int64)  # a 0 behind every text
        self.seq[place] = code
        self.word = np.full(len(self.seq), -1, np.int64)
        self.word[place] = np.arange(len(code))
        self.at = self._sorted(place[code > 0], bits, depth)
        self.first = np.searchsorted(self.seq[self.at], np.arange(1 << bits | 1))

    def _sorted(self, at: np.ndarray, bits: int, depth: int) -> np.ndarray:
        seq, h = self.seq, max(1, 62 // bits)
        # The first h words as one number; what stands behind a 0 is 0 as well.
        key, open_ = seq[at].copy(), np.ones(len(at), bool)
        for k in range(1, h):
            w = seq[np.minimum(at + k, len(seq) - 1)] * open_
            open_ &= w > 0
            key = (key << bits) | w
        order = np.argsort(key, kind="stable")
        at, key, open_ = at[order], key[order], open_[order]
        rank, dead = np.zeros(len(seq), np.int64), np.ones(len(seq), bool)
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at], dead[at] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) + 1, ~open_
        while h < depth:
            # Suffixes that share h words, none of them 0, are told apart by the h words behind.
            twin = ~new
            twin[:-1] |= ~new[1:]
            tied = np.flatnonzero(twin & ~dead[at])
            if not len(tied):
                break
            p = at[tied]
            behind = rank[p + h]
            gone = (behind == 0) | dead[np.minimum(p + h, len(seq) - 1)]
            group = rank[p]
            order = np.argsort(group * (len(seq) + 1) + behind, kind="stable")
            p, behind, gone, group = p[order], behind[order], gone[order], group[order]
            at[tied] = p
            fresh = np.ones(len(p), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
            new[tied] = fresh
            rank[p] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
            dead[p] = gone
            h *= 2
        return at

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within stretches of suffixes that share so many words: the stretch whose next word is the wanted one."""
        seq, at = self.seq, self.at
        ends = []
        for after in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = np.minimum((a + b) >> 1, len(at) - 1)
                w = seq[np.minimum(at[mid] + depth, len(seq) - 1)]  # closed stretches may point anywhere
                go = (w <= want) if after else (w < want)
                a = np.where(open_ & go, mid + 1, a)
                b = np.where(open_ & ~go, mid, b)
            ends.append(a)
        return ends[0], ends[1]

    def matches(self, bench: Benchmark, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Places and words of the windows found; and of each document and item the longest match that holds a window from its
        beginning on (document, item, place, word of the benchmark, words). doc: the document of each place of the sequence.

        Benchmark suffixes with the same words so far are one node, however many items share them; a node has its stretch of the array,
        and once one of its suffixes has had its window, the stretch's places in order of document and place. Suffixes part from a node
        in groups by their next word. A group's matches end with the node in those documents that its next node doesn't have."""
        docs, items = int(doc[-1]) + 1, len(bench.before) - 1
        word, of = np.unique(bench.code, return_inverse=True)
        p, node = np.arange(len(bench.code)), of
        lo, hi = self.first[word], self.first[word + 1]
        place, at_node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the nodes' places, in order of node, document and place
        known = np.zeros(len(lo), bool)
        windows: list[tuple] = []
        best = Longest(items)
        depth = 1
        while len(p):
            alive = (lo < hi)[node]
            p, node = p[alive], node[alive]
            begins = np.zeros(len(lo), bool)
            begins[node[bench.window[p] == depth]] = True
            if (fresh := np.flatnonzero(begins & ~known)).size:
                n = hi[fresh] - lo[fresh]
                more, owner = self.at[take_ragged(lo[fresh], n)], np.repeat(fresh, n)
                order = np.lexsort((more, owner))
                place, at_node = np.concatenate([place, more[order]]), np.concatenate([at_node, owner[order]])
                order = np.argsort(at_node, kind="stable")
                place, at_node = place[order], at_node[order]
                known[fresh] = True
            hit = begins[at_node]
            windows.append((place[hit], np.full(int(hit.sum()), depth)))
            # The next nodes: suffixes of a node that go on with the same word.
            on = bench.left[p] > depth
            want = np.where(on, bench.code[np.minimum(p + depth, len(bench.code) - 1)], 0)
            key, group = np.unique(node * (1 << bench.bits) + want, return_inverse=True)
            parent, want = key >> bench.bits, key & ((1 << bench.bits) - 1)
            new_lo, new_hi = self.narrowed(lo[parent], hi[parent], depth, want)
            new_hi = np.where(want > 0, new_hi, new_lo)
            # Where a place goes on: to the node of its parent and its next word, if any suffix does.
            after = at_node * (1 << bench.bits) + self.seq[np.minimum(place + depth, len(self.seq) - 1)]
            to = np.minimum(np.searchsorted(key, after), max(len(key) - 1, 0))
            goes = (key[to] == after) & (want[to] > 0) if len(key) else np.zeros(len(place), bool)
            started = np.zeros(len(key), bool)
            started[group[(bench.window[p] > 0) & (bench.window[p] <= depth)]] = True
            self._ended(bench, best, p, group, started, parent, depth, doc, docs, place, at_node, to, goes)
            order = np.argsort(to[goes], kind="stable")
            place, at_node = place[goes][order], to[goes][order]
            p, node = p[on], group[on]
            lo, hi, known = new_lo, new_hi, known[parent]
            depth += 1
        place, size = (np.concatenate(x) for x in zip(*windows, strict=True)) if windows else (np.zeros(0, np.int64),) * 2
        return place, size, best.rows()

    def _ended(self, bench: Benchmark, best: Longest, p, group, started, parent, depth, doc, docs, place, at_node, to, goes) -> None:
        """Hands best the matches that end with so many words: of each group of suffixes in the documents of its node, but for
        those that the group's next node has as well."""
        if not len(place):
            return
        # The first place of each document in each node; the documents of the next nodes.
        cell = at_node * docs + doc[place]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        owner, where, which = at_node[first], place[first], doc[place[first]]
        stays = np.unique(to[goes] * docs + doc[place[goes]])
        begin, end = np.searchsorted(owner, parent), np.searchsorted(owner, parent, "right")
        kept = np.bincount(stays // docs, minlength=len(parent))
        open_ = np.flatnonzero(started & (end - begin > kept))
        done = (bench.window[p] > 0) & (bench.window[p] <= depth)
        members, at_group = p[done], group[done]
        order = np.argsort(at_group, kind="stable")
        members, at_group = members[order], at_group[order]
        many = np.bincount(at_group, minlength=len(parent))
        from_ = np.cumsum(many) - many
        total = np.concatenate([[0], np.cumsum((end - begin)[open_])])
        k = 0
        while k < len(open_):
            j = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 18), "right")) - 1)
            some = open_[k:j]
            n = end[some] - begin[some]
            g, row = np.repeat(some, n), take_ragged(begin[some], n)
            cell = g * docs + which[row]
            if len(stays):
                out = stays[np.minimum(np.searchsorted(stays, cell), len(stays) - 1)] != cell
                g, row = g[out], row[out]
            size = np.cumsum(many[g])
            lo = 0
            while lo < len(g):
                base = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, base + (1 << 18), "right")))
                m = many[g[lo:hi]]
                who, r = members[take_ragged(from_[g[lo:hi]], m)], np.repeat(row[lo:hi], m)
                # A match that the words before it belong to as well is part of a longer one.
                at, before = where[r], np.maximum(who - 1, 0)
                inner = (who > bench.before[bench.item[who]]) & (at > 0) & (self.seq[np.maximum(at - 1, 0)] == bench.code[before])
                who, r, at = who[~inner], r[~inner], at[~inner]
                best.add(which[r], bench.item[who], at, who, depth)
                lo = hi
            k = j


class Longest:
    """The longest match of each document and item; of equally long ones the first in the document, then in the item."""

    def __init__(self, items: int):
        self.items, self.held, self.many = items, [np.zeros((0, 4), np.int64)], 0

    def add(self, doc: np.ndarray, item: np.ndarray, place: np.ndarray, who: np.ndarray, size: int) -> None:
        self.held.append(np.stack([doc * self.items + item, np.full(len(doc), -size), place, who], 1))
        self.many += len(doc)
        if self.many > 1 << 20:
            self._reduce()

    def _reduce(self) -> None:
        x = np.concatenate(self.held)
        x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
        x = x[np.concatenate([[True], x[1:, 0] != x[:-1, 0]])] if len(x) else x
        self.held, self.many = [x], 0

    def rows(self) -> tuple[np.ndarray, ...]:
        """document, item, place, word of the benchmark, words; in order of document and item."""
        self._reduce()
        x = self.held[0]
        return x[:, 0] // max(self.items, 1), x[:, 0] % max(self.items, 1), x[:, 2], x[:, 3], -x[:, 1]


def shard_hits(bench: Benchmark, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of a shard: words before each text; stretches of words (first and last + 1) that windows cover, apart from each other and each in
    one document; the longest match of each document and item (document, item, word of the document, word of the item, words)."""
    low = _LOWER[data]
    h, starts, ends, before = word_hashes(low, offs, bench.salt)
    none = np.zeros(0, np.int64)
    if not len(bench.code) or not len(h):
        return before, (none,) * 2, (none,) * 5
    code = bench.codes(h)
    while True:
        array = SuffixArray(code, before, bench.bits, bench.depth)
        if not len(array.at):
            return before, (none,) * 2, (none,) * 5
        n = np.diff(before)
        doc = np.append(np.repeat(np.arange(len(n)), n + 1), len(n) - 1)
        place, size, (of, item, at, who, words) = array.matches(bench, doc)
        first, at = array.word[place], array.word[at]
        # 64-bit word numbers found the places; the words themselves decide.
        step = np.zeros(len(h) + 1, np.int64)
        for begin, long in ((first, size), (at, words)):
            np.add.at(step, begin, 1)
            np.add.at(step, begin + long, -1)
        seen = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        word, length = code[seen] - 1, (ends - starts)[seen]
        wrong = length != bench.word_size[word]
        wrong[~wrong] = ~_same_bytes(low, starts[seen][~wrong], bench.low, bench.word_at[word][~wrong], length[~wrong])
        if not wrong.any():
            break
        code[seen[wrong]] = 0  # a word that only has the number of one of the benchmark's
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    inside = np.cumsum(step[:-1]) > 0
    edge = np.zeros(len(h) + 1, bool)
    edge[before[:-1]] = True  # windows of neighbouring documents may touch
    begin = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    end = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    return before, (np.flatnonzero(begin), np.flatnonzero(end) + 1), (of, item, at - before[of], who - bench.before[item], words)


def covered(first: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Words of each text that lie in any of the stretches."""
    doc = np.searchsorted(before, first, "right") - 1
    return np.bincount(doc, last - first, len(before) - 1).astype(np.int64)


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


MATCH = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The benchmark in blocks of a bounded size, one at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if block and size + len(r.t or "") * 2 > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t or "") * 2
    yield block


#: The block that this worker has prepared last, by its key.
_PREPARED: dict[str, Benchmark] = {}


def _prepared(key: str, sent: Broadcast, window: int) -> Benchmark:
    """The block of a broadcast, prepared once a worker."""
    if key not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[key] = Benchmark(sent.value, window)
    return _PREPARED[key]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and `matches`: of each item with
    an occurring window the longest verbatim match, and where it lies."""
    spark = docs.sparkSession
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    some = list(islice(blocks, 2))
    if len(some) > 1:
        return _by_blocks(few, chain(some, blocks), window, share)
    sent, key = spark.sparkContext.broadcast(some[0]), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _prepared(key, sent, window)
        nothing = _digest([])
        for part, data, offs in steps(batches):
            before, (first, last), longest = shard_hits(bench, data, offs)
            n_words, n_hit = np.diff(before), covered(first, last, before)
            ids: dict[int, set] = {}
            for d, i in zip(longest[0].tolist(), longest[1].tolist(), strict=True):
                if bench.ids[i] is not None:
                    ids.setdefault(d, set()).add(bench.ids[i])
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(ids.get(d, ())) for d in range(len(n_words))], pa.int64()),
                "items_sha256": pa.array([_digest(list(ids[d])) if d in ids else nothing for d in range(len(n_words))], pa.string()),
                "contaminated": pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                "matches": _matches(bench, longest, len(n_words)),
            })

    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches {MATCH}")


def _matches(bench: Benchmark, longest: tuple[np.ndarray, ...], n: int) -> pa.Array:
    """The longest matches of each of n documents, in order of the items."""
    doc, item, at, item_at, size = longest
    ids = pa.array([bench.ids[i] for i in item.tolist()], pa.string())
    rows = pa.StructArray.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (at, item_at, size))], ["item_id", "doc_word", "item_word", "n_words"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), rows)


def _by_blocks(few: DataFrame, blocks: Iterable[list], window: int, share: int) -> DataFrame:
    """A benchmark beyond one block: what all blocks hit, as stretches of words, meets by row. A block's hits are written before
    the next block is read; the first block tells every row's words, the others only rows that they hit. An item lies in one
    block, and so does its longest match."""
    spark = few.sparkSession
    kind = few.schema["doc_id"].dataType.simpleString()
    rows = stored(few.withColumn("uid", F.monotonically_increasing_id()), "rows")
    spans_type = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    parts = []
    for number, block in enumerate(blocks):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key, number=number) -> Iterator[pa.RecordBatch]:
            bench = _prepared(key, sent, window)
            for part, data, offs in steps(batches):
                before, (first, last), longest = shard_hits(bench, data, offs)
                n = np.diff(before)
                cut = np.searchsorted(first, before).astype(np.int32)
                doc = np.searchsorted(before, first, "right") - 1
                pairs = pa.StructArray.from_arrays([pa.array(first - before[doc]), pa.array(last - before[doc])], fields=list(spans_type))
                ids = [bench.ids[i] for i in longest[1].tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(longest[0], np.arange(len(n) + 1)), pa.int32()), pa.array(ids, pa.string()))
                out = pa.RecordBatch.from_pydict({
                    "uid": part.column("uid"), "n_words": pa.array(n, pa.int64()), "block": pa.array(np.full(len(n), number)),
                    "spans": pa.ListArray.from_arrays(pa.array(cut), pairs), "items": lists, "matches": _matches(bench, longest, len(n)),
                })
                yield out if not number else out.filter(pa.array(np.diff(cut) > 0))

        parts.append(stored(rows.mapInArrow(scan, f"uid bigint, n_words bigint, block bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>, matches {MATCH}"), "hits"))
        sent.destroy()
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    met = union.groupBy("uid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.collect_list(F.struct("block", "matches"))).alias("lists"))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("spans", zero, lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n")), lambda s: s["n"])
    items = F.array_sort(F.array_compact(F.array_distinct("items")))
    out = rows.select("uid", "doc_id").join(met, "uid").select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"), F.flatten("lists.matches").alias("matches"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns as they came: decided where a document is read.

    For a benchmark beyond one block the documents are written once with a number for each row, by which the rows that
    go are told; null and repeated doc_ids are rows like any other.
    """
    some = list(islice(_blocks(benchmark, "item_id", item_text_col, block_bytes), 2))
    if len(some) > 1:
        rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
        found = contamination(rows, benchmark, window, share, id_col=ROW, text_col=text_col, item_text_col=item_text_col, block_bytes=block_bytes)
        gone = stored(found.filter("contaminated").select(F.col("doc_id").alias(ROW)), "gone")
        return rows.join(gone, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    sent, key = docs.sparkSession.sparkContext.broadcast(some[0]), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _prepared(key, sent, window)
        for part, data, offs in steps(batches, text_col):
            before, (first, last), _ = shard_hits(bench, data, offs)
            n_hit = covered(first, last, before)
            yield part.filter(pa.array(~((n_hit > 0) & (share * n_hit >= np.diff(before)))))

    return docs.mapInArrow(scan, docs.schema)
