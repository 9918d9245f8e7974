"""Exact dedup, SimHash, token files and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from visarium.llm.chunks import ChunkEncoder, tokenizer_path
from visarium.llm.exact_dedup import drop_exact_copies, exact_groups
from visarium.llm.packing import packed
from visarium.llm.simhash import drop_near_copies, fingerprint, near_duplicates
from visarium.llm.wavelet import WaveletFile, encode_file, read_tokens, shard_starts, write_tokens

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
ODD = ["", None, " ", "A", "a", "É", "é", "don't I'll", "x<|endoftext|>y", "a  b\n\nc", "日本 語、x", "b " * 3000, "z" * 5000]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Rain", "in", "Spain,", "falls", "mainly.", "on", "plain\n", "ß", "1984", "-", "don't"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    return base + [base[0]] * 40 + [b + " again" for b in base[:10]] + [b.upper() for b in base[:5]]


@pytest.fixture(scope="module")
def docs():
    return list(enumerate(texts(120) + ODD))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, docs, keep):
    got = {r.doc_id: r for r in exact_groups(frame(spark, docs), keep, runs=8, fan_in=2).collect()}
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(docs)
    for i, t in docs:
        g = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == ((min if keep == "min" else max)(g), len(g), i == (min if keep == "min" else max)(g))
        assert got[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_exact_nulls_repeats_and_empty(spark):
    rows = [(None, "a"), (None, "A"), (3, "a"), (3, "a"), (None, "q"), (7, None), (8, "")]
    got = exact_groups(frame(spark, rows), "max").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted([("None", "3", 4)] * 2 + [("3", "3", 4)] * 2 + [("None", "None", 1), ("7", "8", 2), ("8", "8", 2)])
    assert sum(r.kept for r in got) == 3
    left = drop_exact_copies(frame(spark, rows), "max")
    assert left.columns == SCHEMA.names and sorted(str(r.doc_id) for r in left.collect()) == ["3", "8", "None"]
    assert exact_groups(frame(spark, []), "max").count() == 0 and drop_exact_copies(frame(spark, [])).count() == 0


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_simhash(spark, docs):
    rng = random.Random(5)
    long = " ".join(rng.choices("abcdefgh", k=600)).split()
    near = [" ".join(long[:k] + ["zz"] + long[k + 1 :]) for k in range(0, 600, 9)]
    rows = docs + [(1000 + k, t) for k, t in enumerate(near)]
    fps = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    roots = brute_components(fps)
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and len({roots[k] for k in range(len(docs), len(rows))}) < len(near)
    for k, i in enumerate(ids):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fps[k]:016x}", ids[roots[k]])


def test_simhash_many_homes(spark, monkeypatch):
    import visarium.llm.simhash as s

    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))]))
    want = brute_components(fps.tolist())
    for most in (512, 2):
        monkeypatch.setattr(s, "MANY_HOMES", most)
        row, anchor, home = s.Covering().anchors(fps)
        assert home.sum() == len(fps)
        o = np.lexsort((~home, anchor))
        first = np.concatenate([np.flatnonzero(np.diff(anchor[o], prepend=anchor[o][0] - 1)), [len(o)]])
        a, b = s.anchor_links(fps[row][o], home[o], first, 2)
        place = {int(x): k for k, x in enumerate(fps)}
        parent = list(range(len(fps)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[max(find(place[x]), find(place[y]))] = min(find(place[x]), find(place[y]))
        assert [find(k) for k in range(len(fps))] == want


def test_simhash_nulls_and_empty(spark):
    got = near_duplicates(frame(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None), (None, " ")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("4", 4), ("4", 4), ("9", 9), ("None", 4), ("None", 9)]
    assert near_duplicates(frame(spark, [])).count() == 0
    assert fingerprint(b"") == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_equal_library(name):
    import pyarrow as pa

    from visarium.llm.arrays import as_bytes

    rng = random.Random(1)
    signs = "ab A'.,|<>\n\t  é1١2́　​!\x1c\x85İΣ x"
    some = [t or "" for t in ODD + texts(50)] + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]
    some += [" ".join(rng.choice("éèñßÀÇ日本ıİºªǅक़ͅa") * rng.randint(1, 4) + "b" * rng.randint(0, 2) for _ in range(30)) for _ in range(40)]
    some += ["<|endoftext|>", "a<|startoftext|> b<|endoftext|>", "<|endoftext |>"]
    path = tokenizer_path(name)
    lib, enc = Tokenizer.from_file(path), ChunkEncoder(path)
    data, offs = as_bytes(pa.array(some))
    for _ in range(2):  # the second time from memory
        ids, n = enc.encode(data, offs)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [x.ids for x in lib.encode_batch(some, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A file of another kind - here one that joins over spaces - gives the library's ids as well."""
    import json

    import pyarrow as pa

    from visarium.llm.arrays import as_bytes

    with open(tokenizer_path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    for name, change in {"bare": {"added_tokens": [], "post_processor": None}, "loose": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}}}.items():
        (tmp_path / name).write_text(json.dumps(spec | change))
        enc, lib = ChunkEncoder(str(tmp_path / name)), Tokenizer.from_file(str(tmp_path / name))
        some = [t or "" for t in ODD[:11] + texts(5)]
        ids, n = enc.encode(*as_bytes(pa.array(some)))
        assert enc.kind is None and np.split(ids, np.cumsum(n)[:-1])[3].tolist() == lib.encode("A", add_special_tokens=False).ids
        assert ids.tolist() == [i for x in lib.encode_batch(some, add_special_tokens=False) for i in x.ids]
    assert [ChunkEncoder(tokenizer_path(x)).kind for x in ("word_bpe_49k.json", "byte_bpe_50k.json")] == ["ends", "starts"]


def library_ids(name, rows, end):
    lib = Tokenizer.from_file(tokenizer_path(name))
    return {i: lib.encode(t or "", add_special_tokens=False).ids + [end] for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, tmp_path):
    want = library_ids("word_bpe_49k.json", docs, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    files = write_tokens(frame(spark, docs), tokenizer_path("word_bpe_49k.json"), 2, str(tmp_path / "t"), file_tokens=500)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = 0
    for r in sorted(read_tokens(files).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), crc(want[r.doc_id]))
        at += r.n_tokens
    assert at == sum(map(len, want.values()))
    shards = {(r.shard, r.part): r.n_tokens for r in files.select("shard", "part", "n_tokens").collect()}
    assert len(shards) > len({s for s, _ in shards})  # some shard has several files
    key = lambda r: (r.doc_id, r.start)
    assert sorted(read_tokens(files, broadcast=0).collect(), key=key) == sorted(read_tokens(files).collect(), key=key)
    sums, at = {}, 0
    for (s, _), n in shards.items():
        sums[s] = sums.get(s, 0) + n
    for r in shard_starts(files, together=2).orderBy("shard").collect():
        assert r.first == at
        at += sums[r.shard]
    empty = write_tokens(frame(spark, []), tokenizer_path("word_bpe_49k.json"), 2, str(tmp_path / "e"))
    assert read_tokens(empty).count() == 0


def test_token_files_of_null_and_repeated_ids(spark, tmp_path):
    """Null ids come first, rows that repeat an id stand side by side, texts beyond a step and clashing columns are no matter."""
    long = "rain in spain, " * 300_000
    rows = [(5, "b c"), (None, "a"), (5, "b c"), (None, None), (7, long), (5, "x")]
    docs = spark.createDataFrame([(i, t, 3, b"q") for i, t in rows], "doc_id long, text string, shard int, payload binary")
    got = sorted(read_tokens(write_tokens(docs, tokenizer_path("word_bpe_49k.json"), 2, str(tmp_path / "n"))).collect(), key=lambda r: r.start)
    want = library_ids("word_bpe_49k.json", [(k, t) for k, (_, t) in enumerate(rows)], 2)
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5, 7]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(want[k]), crc(want[k])) for k, (i, _) in enumerate(rows))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_wavelet_file():
    rng = np.random.default_rng(0)
    for n, most in ((1, 1), (7, 5), (3000, 40), (2000, 49408), (1500, 1 << 20)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        f = WaveletFile(encode_file(ids, np.array([n])))
        assert f.all().tolist() == ids.tolist() and f.offsets.tolist() == [0, n]
        for i in {0, n // 2, n - 1}:
            t = int(ids[i])
            where = np.flatnonzero(ids == t).tolist()
            assert f.access(i) == t and f.count(t) == len(where) and f.rank(t, i) == sum(w < i for w in where)
            assert f.occurrences(t) == where and f.count(t, 1, n) == sum(w >= 1 for w in where)
        assert f.count(most + 5) == 0


def test_wavelet_file_reads_only_the_chunks_it_needs(monkeypatch):
    import visarium.llm.wavelet as w

    monkeypatch.setattr(w, "CHUNK", 1024)
    ids = np.random.default_rng(1).integers(0, 3000, 9000).astype(np.uint32)
    raw = encode_file(ids, np.array([4000, 0, 5000]))
    f = WaveletFile(raw)
    assert f.access(7777) == ids[7777] and len(f._open) <= f.planes
    t = int(ids[123])
    assert f.occurrences(t) == np.flatnonzero(ids == t).tolist() and f.count(t, 100, 8000) == int((ids[100:8000] == t).sum())
    assert f.all().tolist() == ids.tolist() and f.offsets.tolist() == [0, 4000, 4000, 9000] and len(f._open) <= w.KEPT
    with pytest.raises(ValueError):
        WaveletFile(b"none" + raw[4:])


def test_packing(spark, docs):
    want = library_ids("byte_bpe_50k.json", docs, 0)
    rows = packed(frame(spark, docs), tokenizer_path("byte_bpe_50k.json"), open_windows=3, merge=2).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for parts, total in [(sorted(p), len(want[i])) for i, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        at = 0
        for start, n in parts:
            assert start == at
            at += n
        assert at == total if total else at <= 1024
    full = sum(map(len, want.values()))
    assert len(sequences) <= full // 1024 + 3
    assert packed(frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_null_ids(spark):
    rows = packed(frame(spark, [(None, "a b"), (None, "a b"), (5, None)]), tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("5", 1), ("None", 3), ("None", 3)]
    assert len({r.sequence_id for r in rows}) == 1


def test_texts_beyond_a_step(spark):
    """Two texts of more than a step, with others around them: fingerprints, groups, pieces and counts as of each alone."""
    import sentencepiece

    from visarium.llm.piece_counts import token_counts

    rng = random.Random(17)
    words = ["rain", "in", "Spain,", "falls", "mainly.", "don't", "ß", "1984\n"]
    long = " ".join(rng.choices(words, k=900_000))
    rows = [(1, "short one"), (2, long), (3, ""), (4, long.upper().replace("SS", "ß")), (5, long), (6, "short one")]
    assert len(long.encode()) > 4 << 20
    docs = spark.createDataFrame([(i, t, i, b"x") for i, t in rows], "doc_id long, text string, fp long, verify binary").coalesce(1)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert all(got[i].fingerprint == f"{brute_fingerprint(t):016x}" for i, t in rows if i != 5) and got[5].fingerprint == got[2].fingerprint
    assert [got[k].component_id for k in (2, 4, 5)] == [2, 2 if (brute_fingerprint(long) ^ brute_fingerprint(rows[3][1])).bit_count() <= 2 else 4, 2]
    same = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs, "max").collect()}
    assert same[2] == same[5] and same[1] == same[6] == (6, 2) and same[3] == (3, 1)
    want = library_ids("byte_bpe_50k.json", rows, 0)
    pieces = packed(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    for i, ids in want.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens and all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == {i: len(lib.encode(t)) for i, t in rows}
    kept = drop_near_copies(drop_exact_copies(docs, "max"))
    assert kept.columns == docs.columns and {1, 3} & {r.doc_id for r in kept.collect()} == {3}
