"""Token ids of whole texts, with each distinct chunk of text encoded once.

Texts are cut where no tokenizer of the two kinds used here can join what stands on both sides: around a lone white-space
byte between other characters, and between an ASCII letter and punctuation behind it (but the apostrophe, which
contractions use, and the bar, which special tokens hold). The library encodes each distinct chunk; whole texts' ids are
gathered from those. tests/llm compares this with the library on whole texts. A tokenizer of any other kind gets whole texts.
"""

from __future__ import annotations

import json
import re
from typing import Any

import numpy as np
import pyarrow.compute as pc

from visarium.llm.arrays import binary_array, take_ragged

#: Chunks and their token ids that a worker holds; beyond, it starts anew. Longer chunks are not held.
MEMO_CHUNKS, MEMO_IDS, LONG = 500_000, 6_000_000, 256

#: What a byte may be, as bits of one table: white space; part of a character that is no white space by itself; ASCII; letter;
#: punctuation; first byte of a character that may be white space outside ASCII (U+0085, U+00A0, U+1680, U+180E, U+2xxx, U+3000, U+FEFF).
_WHITE, _SOLID, _PLAIN_ASCII, _LETTER, _PUNCT, _MAYBE = (1 << k for k in range(6))


def _table() -> bytes:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= _WHITE
    out[0x21:] |= _SOLID
    out[0x7F] = 0
    out[:0x80] |= _PLAIN_ASCII
    out[0x41:0x5B] |= _LETTER
    out[0x61:0x7B] |= _LETTER
    out[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{}~']] |= _PUNCT
    out[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] |= _MAYBE
    return out.tobytes()


_TABLE = _table()
#: The pattern of words of one kind of tokenizer, a fixed value of its file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets of the chunks: every text's ends, and the places inside where it may be cut."""
    n = len(data)
    if n < 3:
        return np.unique(offs)
    kind = np.frombuffer(data.tobytes().translate(_TABLE), np.uint8)
    is_ = lambda bit: (kind & bit).view(bool) if bit == 1 else (kind & bit) != 0
    white, solid, maybe = is_(_WHITE), is_(_SOLID), is_(_MAYBE)
    # A byte before the space ends a solid character if it is ASCII, or if the character cannot be white space.
    tail = np.ones(n, bool)
    tail[1:] &= ~maybe[:-1]
    tail[2:] &= ~maybe[:-2]
    before = solid & (tail | is_(_PLAIN_ASCII))
    after = solid & ~maybe
    mark = np.zeros(n + 1, bool)
    lone = white[1:-1] & before[:-2] & after[2:]
    mark[1 : n - 1] |= lone
    mark[2:n] |= lone & (data[1:-1] != 0x20)
    mark[1:n] |= is_(_LETTER)[:-1] & is_(_PUNCT)[1:]
    mark[offs] = True
    return np.flatnonzero(mark)


_ASCII = re.compile(rb" [A-Za-z]+").fullmatch


def plain(chunk: bytes) -> bool:
    """A space and letters: one word to either tokenizer, whatever stands beside it."""
    if _ASCII(chunk):
        return True
    if chunk[0] != 0x20 or len(chunk) < 2 or chunk[1] < 0x80 and not chunk[1:2].isalpha():
        return False
    word = chunk[1:].decode()
    return word.isalpha() and word.lower().isalpha()


def _state(part: Any) -> dict:
    """A tokenizer's part as its file describes it."""
    return json.loads(part.__getstate__()) if part is not None else {}


def _kind(tok: Any) -> str | None:
    """The kinds whose texts may be cut: words that end in a mark, with white space dropped ("ends"), or bytes with the space before
    a word as part of it ("starts")."""
    normal, before, model = _state(tok.normalizer), _state(tok.pre_tokenizer), tok.model
    bpe = type(model).__name__ == "BPE" and not model.dropout and model.unk_token is None
    if not bpe or not tok.get_added_tokens_decoder():
        return None
    if not normal and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model.end_of_word_suffix:
        return "starts"
    parts, steps = before.get("pretokenizers", []), [x.get("type") for x in normal.get("normalizers", [])]
    split = parts[0] if len(parts) == 2 else {}
    words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern") == {"Regex": WORDS}
    if words and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space") and steps == ["NFC", "Replace", "Lowercase"] and model.end_of_word_suffix:
        return "ends"
    return None


class ChunkEncoder:
    """encode() gives the ids of many texts. Files are those of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = _kind(self.tok)
        if self.kind:
            self.special_id, special = max((k, v.content) for k, v in self.tok.get_added_tokens_decoder().items())
            self.special = special.encode()
            # Ids that end a word, or that begin one with its space.
            vocab, suffix = self.tok.get_vocab(), self.tok.model.end_of_word_suffix
            self.edge = np.zeros(max(vocab.values()) + 1, bool)
            self.edge[[k for t, k in vocab.items() if (t.endswith(suffix) if self.kind == "ends" else t.startswith("\u0120"))]] = True
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.store = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the chunks. A special token between chunks keeps them apart and shows where each ends."""
        if any(self.special in c for c in chunks):
            some = [e.ids for e in self.tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            return np.fromiter((x for one in some for x in one), np.uint32, int(sizes.sum())), sizes
        parts = [self.special.join(chunks[k : k + 500]) + self.special for k in range(0, len(chunks), 500)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.special_id)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _plain_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of plain words, one behind another; which id begins or ends a word shows where each ends."""
        parts = [b"".join(chunks[k : k + 500]).decode() for k in range(0, len(chunks), 500)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)])
        at = np.flatnonzero(self.edge[flat])
        if len(at) != len(chunks):  # a vocabulary with other marks
            return self._ids(chunks)
        return flat, np.diff(at, prepend=-1) if self.kind == "ends" else np.diff(at, append=len(flat))

    def _add(self, chunks: list[bytes], plain: bool = False) -> np.ndarray:
        """Places in the memo of chunks that are not in it yet."""
        flat, sizes = (self._plain_ids if plain else self._ids)(chunks)
        k, total = len(self.memo), len(flat)
        while k + len(chunks) > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        self.store[self.used : self.used + total] = flat
        self.start[k : k + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(chunks)] = sizes
        self.used += total
        self.memo.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        return np.arange(k, k + len(chunks))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if not self.kind:
            raw = data.tobytes()
            some = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate(some) if some else np.zeros(0, np.uint32), np.array([len(x) for x in some], np.int64)
        at = cuts(data, offs)
        if len(at) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        coded = pc.dictionary_encode(binary_array(data, at))
        index, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_CHUNKS or self.used > MEMO_IDS:
            self.clear()
        get = self.memo.get
        place = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(place < 0).tolist()
        kinds: tuple[list[int], ...] = ([], [], [])  # plain words, others, those that hold a special token's text
        for k in new:
            c = chunks[k]
            kinds[0 if plain(c) else 2 if self.special in c else 1].append(k)
        for kind, which in enumerate(kinds):
            for k in range(0, len(which), 50_000):
                part = which[k : k + 50_000]
                place[part] = self._add([chunks[j] for j in part], kind == 0)
        here = place[index]
        size = self.size[here]
        ids = self.store[take_ragged(self.start[here], size)]
        if max((len(chunks[j]) for j in new), default=0) > 64 * LONG:
            self.clear()  # a very long chunk is not kept
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.searchsorted(at, offs)
        return ids, ends[where[1:]] - ends[where[:-1]]


_LOADED: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
