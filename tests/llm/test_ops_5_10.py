"""Language, token counts, shards, revisits, decontamination and toxicity against brute force or held-out rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_ops_1_4 import ODD, frame, lower, texts
from visarium.llm import language
from visarium.llm.arrays import as_bytes
from visarium.llm.chunks import tokenizer_path
from visarium.llm.decontaminate import Benchmark, SuffixArray, contamination, drop_contaminated, shard_hits, word_hashes
from visarium.llm.gru import EDGE, BiGRU
from visarium.llm.language import chunked, codes_of, drop_unidentified, label_texts, languages, predict
from visarium.llm.piece_counts import PieceCounter, token_counts
from visarium.llm.revisits import PERMITTED, canonical_url, resolve_revisits
from visarium.llm.sharding import jump_hash, shard_table
from visarium.llm.toxicity import Model, fit, grams, toxicity, words_of

# Language


def test_gru_gradients():
    net = BiGRU(3, 4)
    net.p = {k: x.astype(float) for k, x in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, 7)), rng.integers(0, 3, 7)
    x[0, :3], x[4:, 2] = EDGE, EDGE
    _, grad = net.gradients(x, y)
    for k in grad:
        at = (9, int(x[2, 1])) if k[0] == "w" else tuple(n // 2 for n in net.p[k].shape)
        was, e = net.p[k][at], 1e-3
        net.p[k][at] = was + e
        up = net.gradients(x, y)[0]
        net.p[k][at] = was - e
        down = net.gradients(x, y)[0]
        net.p[k][at] = was
        assert grad[k][at] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-6)


def test_chunks_cover_all_bytes():
    data, offs = as_bytes(pa.array(["ab, cd  é日本", "", "x" * 100, ", ,"]))
    text, start, lens = chunked(data, offs, 8)
    assert np.repeat(np.arange(4), np.diff(offs)).tolist() == np.repeat(text, lens).tolist()
    assert np.concatenate([np.arange(s, s + n) for s, n in zip(start, lens, strict=True)]).tolist() == list(range(len(data)))
    codes = codes_of(data, offs, text, start, 8, 3)
    assert codes[0].tolist() == [EDGE] * 3 + data[:11].tolist() and codes[-1].tolist() == [EDGE] * 3 + list(b", ,") + [EDGE] * 8


def brute_labels(net, raw, size, warm):
    """Mean probabilities byte by byte: one state after another, from the bytes around the byte's chunk on."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, total = net.units, np.zeros(len(net.p["bias"]))
    code = lambda k: raw[k] if 0 <= k < len(raw) else EDGE

    def state(d, places):
        h = np.zeros(n)
        for k in places:
            a, g = net.p[f"w{d}"][:, code(k)], net.p[f"u{d}"] @ h
            z, r = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
        return h

    for at in range(len(raw)):
        begin = at // size * size
        end = min(begin + size, len(raw))
        s = net.p["o"] @ np.concatenate([state("f", range(begin - warm, at + 1)), state("b", range(end + warm - 1, at - 1, -1))]) + net.p["bias"]
        total += np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    return total / max(len(raw), 1)


def test_labels_equal_a_pass_byte_by_byte():
    net = BiGRU(3, 4, seed=2)
    net.p = {k: (x * 2).astype(np.float32) for k, x in net.p.items()}
    some = ["", "a", "hello world, hello world", "é日本", "xyz" * 9, "hello world, hello world", "abcdefgh", "q" * 33]
    got = label_texts(net, *as_bytes(pa.array(some)), 8, 3)
    want = [brute_labels(net, t.encode(), 8, 3) for t in some]
    assert got == pytest.approx(np.array(want), abs=2e-6) and got[2].tolist() == got[5].tolist()
    whole = label_texts(net, *as_bytes(pa.array(some)), 64, 3)  # one chunk: the state runs through all of a text
    x = np.array([[EDGE] * 3 + list(b"xyz" * 9) + [EDGE] * 3]).T
    assert whole[4] == pytest.approx(net.probabilities(x)[3:30, :, 0].mean(0), abs=1e-5)


def test_languages_of_texts_beyond_a_step(spark):
    """Texts of more than one step get the labels that they get alone, and repeated rows one each."""
    long = "lo ma ra ti vo " * 400_000
    docs = spark.createDataFrame([*language_rows(90), (1000, long, None), (1001, "strk " * 9, None), (1001, "strk " * 9, None), (1002, long, None)], "doc_id long, text string, lang string").coalesce(1)
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages(docs, training_steps=120).collect() if r.doc_id >= 1000]
    assert sorted(x[:2] for x in got) == [(1000, "aa"), (1001, "bb"), (1001, "bb"), (1002, "aa")] and got[1][2] == got[2][2] and got[0][2] == got[3][2]


def test_drop_unidentified_by_score(spark):
    docs = spark.createDataFrame([*language_rows(240), (1000, " ".join(" ".join(x.split() * 6) for x in LANGS.values()), None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in drop_unidentified(docs, least=0.75).collect()}
    assert 1000 not in kept and len(kept) >= 235  # of three languages in equal shares none is found


LANGS = {"aa": "lo ma ra ti vo nesa kila", "bb": "strk blng zwpf krtz mxnt", "cc": "oué aieau èré ção ñez"}


def language_rows(n=240):
    rng = random.Random(3)
    return [(k, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(2, 30))), lang) for k in range(n) for lang in [sorted(LANGS)[k % 3]]]


def test_languages_held_out(spark):
    rows = language_rows() + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (None, "lo ma ra lo ma", None), (903, "日本語", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = languages(docs, training_steps=150).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [(by[k].lang_pred, lang) for k, _, lang in rows[:240] if by[k].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(240))
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902)) and by[903].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got) and not by[None].held_out
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_languages_ignore_held_out_labels_and_empty(spark):
    rows = [(k, t, lang if zlib.crc32(str(k).encode()) % 3 != 1 else "zz") for k, t, lang in language_rows(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in languages(docs, training_steps=20).collect()} <= set(LANGS)
    assert languages(docs.filter("false")).count() == 0
    nothing = languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# Token counts


def test_piece_counts_equal_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    signs = "ab AB'.,|<>\n\t  é1٢ 　​!\x1c\x85İΣ▁😀日本bcaabcanthe"
    some = [t or "" for t in ODD + texts(30)] + ["<s></s><unk><0x41>", "▁", "a▁b", "abcabcab" * 400, "the" * 2000, "日本語" * 300, " " * 900, "=" * 777, "".join(rng.choice("abcdeht") for _ in range(5000))]
    some += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    data, offs = as_bytes(pa.array(some))
    assert PieceCounter(path).count(data, offs).tolist() == [len(x) for x in lib.encode(some)]
    rows = list(enumerate(some[:200])) + [(None, None), (5, "x")]
    got = token_counts(frame(spark, rows), path, limit=20).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n, n > 20) for i, t in rows for n in [len(lib.encode(t or ""))])
    assert token_counts(frame(spark, []), path).count() == 0


# Shards


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, 17, -1, -(1 << 63), (1 << 63) - 1, *(random.Random(2).getrandbits(63) for _ in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *(jump_hash(F.col("k"), n).alias(f"s{n}") for n in (1, 8, 9))).collect()
    assert all((r.s1, r.s8, r.s9) == (0, jump(r.k, 8), jump(r.k, 9)) for r in got)
    assert all(r.s8 == r.s9 or r.s9 == 8 for r in got)


def test_shard_table(spark):
    rows = list(enumerate(texts(200) + ODD)) + [(None, "a"), (None, None), (3, "again"), (3, "again")]
    got = shard_table(frame(spark, rows), 8, buckets=5).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r.shard == jump(r.doc_id or 0, 8) and r.grown_shard == jump(r.doc_id or 0, 9) and r.law == "key" for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard_table(frame(spark, [])).count() == 0


# Revisits


def brute_url(u):
    if not u:
        return None
    u = u.strip().split("#")[0]
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)", u)
    scheme, host, rest = (m[1].lower(), m[2].lower(), m[3]) if m else ("", "", u)
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0"))
    path, _, query = rest.partition("?")
    keep = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|fbclid|gclid)(=|$)", p))
    out = host + path.rstrip("/") + ("?" + "&".join(keep) if keep else "")
    return ((scheme + "://") * bool(scheme) + out) if out else None


def brute_revisits(rows):
    out = []
    for i, url, kind, at, headers, *_ in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): x for k, x in (headers or {}).items()}
        key = brute_url(url)
        before = [r for r in rows if r[2] == "response" and key and brute_url(r[1]) == key and r[3] and at and (r[3], r[0]) < (at, i) and (len(r) < 6 or r[5] in (None, 200))]
        if not before:
            out.append((i, key, "no_response", None, None))
            continue
        r = max(before, key=lambda r: (r[3], r[0]))
        rh = {k.lower(): x for k, x in (r[4] or {}).items()}
        if "etag" not in h and "last-modified" not in h:
            out.append((i, key, "no_validator", None, None))
        elif ("etag" in h and rh.get("etag", "-").removeprefix("W/") == h["etag"].removeprefix("W/")) or ("etag" not in h and rh.get("last-modified") == h["last-modified"]):
            out.append((i, key, "resolved", r[0], rh | {k: x for k, x in h.items() if k in PERMITTED}))
        else:
            out.append((i, key, "mismatch", None, None))
    return sorted(out, key=str)


def test_revisits(spark):
    rng, t0, rows = random.Random(4), dt.datetime(2024, 1, 1, tzinfo=dt.UTC).replace(tzinfo=None), []
    urls = ["http://A.example.com/x/", "https://a.example.com:443/x#top", "http://a.example.com/x?b=2&a=1&utm_source=q", "http://a.example.com/x?a=1&b=2", "http://b.example.com", None, "", "odd"]
    for k in range(500):
        headers = {n: x for n, x in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"'])), ("Last-Modified", rng.choice("xy")), ("Date", str(k)), ("Content-Length", "5")) if rng.random() < 0.7}
        rows.append((k, rng.choice(urls), rng.choice(["response", "revisit", "request"]), t0 + dt.timedelta(minutes=rng.randint(0, 40)) if rng.random() < 0.97 else None, headers if rng.random() < 0.95 else None, rng.choice([200, 200, 200, None, 404])))
    rows += rows[:40]  # repeated records, and many at one time
    df = spark.createDataFrame([(*r, 9) for r in rows], "record_id long, url string, kind string, at timestamp, headers map<string,string>, status int, bucket int")
    got = sorted(((r.record_id, r.url_key, r.outcome, r.response_id, r.headers) for r in resolve_revisits(df, bucket=600).collect()), key=str)
    norm = lambda rs: [(*r[:4], sorted(r[4].items()) if r[4] is not None else None) for r in rs]
    assert norm(got) == norm(brute_revisits(rows)) and {r[2] for r in got} == {"resolved", "mismatch", "no_validator", "no_response"}
    assert resolve_revisits(df.filter("false")).count() == 0


def test_canonical_url(spark):
    urls = ["http://h.com:443/a", "https://h.com:80/a", "https://H.com:443/a", "ftp://h.com:80/a", "http://H.com:80/A//?", "https://h.com/a?ref=1&z=&gclid", " HTTP://x.y/?q=1#f ", "http://x.y?b&a", None, "", "/rel/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert [r.c for r in got] == [brute_url(u) for u in urls]
    assert len({brute_url(u) for u in ("http://h.com:443/a", "https://h.com:80/a", "https://h.com/a?ref=v2", "https://h.com/a")}) == 4
    loose = spark.range(1).select(*(canonical_url(F.lit(u), ("ref",), False) for u in ("http://h.com:80/a?ref=1", "https://h.com:443/a"))).first()
    assert list(loose) == ["h.com/a", "h.com/a"]


# Decontamination


def brute_contamination(rows, items, window=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, its = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    its |= {str(x) for x in wins[tuple(w[k : k + n])] if x is not None}
        out.append((str(i), len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def bench_rows():
    rng = random.Random(8)
    words = "the of rain in spain falls mainly on plain ß 1984 é x".split()
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 13, 14, 40])))) for k in range(30)] + [(90, None), (91, "THE of. Rain"), (None, "in spain on")]
    docs = list(enumerate(texts(60) + ODD))
    for k in range(40):
        t = rng.choice(items)[1] or ""
        docs.append((200 + k, " ".join(rng.choices(["q", "w", "zz"], k=rng.randint(0, 30))) + ", " + t.upper() + "! " + " ".join(rng.choices(["q", "the", "zz"], k=rng.randint(0, 60)))))
    return docs + [(None, "rain"), (200, docs[-1][1])], items


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_contamination(spark, bench_rows, block):
    docs, items = bench_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, docs), bench, block_bytes=block)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute_contamination(docs, items)


def test_contamination_longest_and_empty(spark, bench_rows):
    words = [f"w{k}" for k in range(30)]
    docs = [(1, "a b " + " ".join(words[5:25]) + " c"), (2, " ".join(words[:12]))]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(frame(spark, docs), bench).collect()}
    assert [tuple(m) for m in got[1].matches] == [("7", 2, 5, 20)] and not got[2].matches
    none = contamination(frame(spark, docs), bench.filter("false")).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)
    assert contamination(frame(spark, []), bench).count() == 0
    kept = drop_contaminated(frame(spark, docs), bench)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == ["doc_id", "text", "n", "digest"]


def test_drop_contaminated_by_rows_at_every_size(spark):
    """Rows are decided one by one, however large the benchmark: those that share an id with a contaminated one stay."""
    item = " ".join(f"w{k}" for k in range(15))
    rows = [(1, item), (1, "a clean text"), (None, item), (None, "another clean text"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    bench = spark.createDataFrame([(7, item), (8, "some other item")], "item_id long, text string")
    for block in (1 << 20, 20):
        kept = drop_contaminated(docs, bench, text_col="body", block_bytes=block)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_longest_matches_beyond_one_block(spark, bench_rows):
    """A benchmark in several blocks gives the same matches as in one."""
    docs, items = bench_rows
    words = [f"w{k}" for k in range(30)]
    docs = [*docs, (9001, "a b " + " ".join(words[5:25]) + " c"), (9001, " ".join(words[:14])), (None, " ".join(words))]
    bench = spark.createDataFrame([*items, (9007, " ".join(words)), (9008, " ".join(words[3:20])), (9007, " ".join(words[8:]))], "item_id long, text string").coalesce(1)
    one, more = (sorted((str(r.doc_id), r.n_words, r.n_hit, [tuple(m) for m in r.matches]) for r in contamination(frame(spark, docs), bench, block_bytes=b).collect()) for b in (1 << 26, 200))
    assert one == more and any(("9007", 2, 5, 20) in r[3] and len(r[3]) == 3 for r in more) and any(not r[3] for r in more)


def brute_longest(text, item, window=13):
    """Of the matches that hold a window of the item: the longest, the first in the document, the first in the item."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
    a, b, best = words(text), words(item), None
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= min(window, len(b)) and (best is None or n > best[2]):
                best = (i, j, n)
    return best


def test_longest_matches_by_brute_force(bench_rows):
    docs, items = bench_rows
    rng = random.Random(12)
    some = [" ".join(rng.choices("abc", k=60)) for _ in range(12)]
    docs = [*(t for _, t in docs), *some, "x " + some[3][:90] + " y", "W" * 70000 + " tail " + "v" * 70000]
    items = [(k, t) for k, (_, t) in enumerate(items)] + [(100 + k, t[20:80]) for k, t in enumerate(some)] + [(200, "w" * 70000 + " tail"), (201, "é " * 13)]
    bench = Benchmark([(str(i), t) for i, t in items])
    for salt in (0, 1):  # another numbering of the words changes nothing
        bench.salt = salt
        if salt:
            h = word_hashes(bench.low, np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in items])]), salt)[0]
            bench.vocab, at, code = np.unique(h, return_index=True, return_inverse=True)
            bench.word_at, bench.word_size, bench.code = bench.word_at[bench.code - 1][at], bench.word_size[bench.code - 1][at], code + 1
            bench.small[:] = True
        _, _, (doc, item, *place) = shard_hits(bench, *as_bytes(pa.array(docs)))
        got = {(d, i): tuple(x) for d, i, *x in zip(doc.tolist(), item.tolist(), *(x.tolist() for x in place), strict=True)}
        assert got == {(d, i): m for d, t in enumerate(docs) for i, (_, x) in enumerate(items) if (m := brute_longest(t or "", x or ""))}


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    code = np.concatenate([rng.integers(0, 4, 300), np.tile(rng.integers(1, 4, 25), 8)])
    before = np.array([0, 100, 100, 300, 400, 500])
    sa = SuffixArray(code, before, 2, 40)
    seq = sa.seq.tolist()

    def suffix(at):
        out = []
        while seq[at] and len(out) < 40:
            out.append(seq[at])
            at += 1
        return out

    keys = [suffix(at) for at in sa.at.tolist()]
    assert keys == sorted(keys) and sorted(sa.word[sa.at].tolist()) == np.flatnonzero(code).tolist()


def test_contamination_of_texts_beyond_a_step(spark):
    """Texts of more than one step, and many rows around them, are decided as alone; other columns' names do not matter."""
    item = " ".join(f"w{k}" for k in range(20))
    long = "filler words " * 400_000
    rows = [(1, "short", 1), (2, long + item, 1), (3, item, 1), (4, long, 1), (5, item + " " + "z " * 400, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, matches int").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, passage string")
    for block in (1 << 20, 10):
        got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated, [tuple(m) for m in r.matches]) for r in contamination(docs, bench, text_col="body", item_text_col="passage", block_bytes=block).collect()}
        assert got == {1: (1, 0, False, []), 2: (800_020, 20, False, [("7", 800_000, 0, 20)]), 3: (20, 20, True, [("7", 0, 0, 20)]), 4: (800_000, 0, False, []), 5: (420, 20, False, [("7", 0, 0, 20)])}
        assert sorted(r.doc_id for r in drop_contaminated(docs, bench, text_col="body", item_text_col="passage", block_bytes=block).collect()) == [1, 2, 4, 5]


# Toxicity


def test_kneser_ney_sums_to_one():
    own, cuts, index, _ = words_of(*as_bytes(pa.array(["abc abd xbc", "abc b cab"])))
    key, word = grams(own, cuts, 3)
    n = np.bincount(index, minlength=len(cuts) - 1)
    keys, where = np.unique(key, return_inverse=True)
    counts = np.bincount(where, n[word])
    shared = Model._shared(keys, 3)
    assert ((shared > 0) & (shared <= 1)).all()
    m = Model(keys, counts, np.zeros(len(keys)), 3)  # the other class has seen nothing: its words are the backoff's
    both = np.exp(m.ratio) * shared
    sums = np.bincount(np.unique(keys >> 8, return_inverse=True)[1], both)
    assert (sums <= 1 + 1e-6).all() and (sums > 0.2).all()


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = [a + b for a in ("lo", "ma", "ra", "ti", "ke") for b in ("ne", "sa", "ki", "vu", "")]
    bad = ["idiot", "moron", "scumbag"]
    rows, marks = [], []
    for k in range(900):
        toxic = k % 4 == 0
        w = rng.choices(plain, k=rng.randint(8, 60))
        for _ in range(max(1, len(w) // 15) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        marks.append((k, int(toxic), 7))
    rows += [(1000, None), (1001, ""), (None, "idiot moron idiot"), (1002, "idiot moron idiot"), (1003, "lo " * 500)]
    marks += [(5, None, 1), (4000, 1, 1), (None, 1, 1), (8, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    got = toxicity(frame(spark, rows), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [k for k in range(900) if by[k].held_out]
    assert sum(by[k].predicted for k in held if k % 4 == 0) >= 0.95 * sum(k % 4 == 0 for k in held)
    assert sum(by[k].predicted for k in held if k % 4) <= 0.02 * len(held)
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1003].predicted == 0 and by[1000].score == by[1001].score
    assert toxicity(frame(spark, []), labels).count() == 0
    assert {r.score for r in toxicity(frame(spark, rows[:20]), labels.filter("false")).collect()} == {0.0}


def test_toxicity_beyond_the_bound(spark):
    """Longer strings set the classes apart at every size: a model beyond the bound gives the scores of one within it."""
    rng = random.Random(9)
    rows, marks = [], []
    for k in range(300):
        w = ["".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(rng.randint(3, 40))]
        w += ["qwrxzab" if k % 3 == 0 else "rwqxzab"] * 2  # apart by a byte five before the last
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 3 == 0)))
    rows += [(1000, None), (1001, "12 34"), (None, "qwrxzab"), (1, rows[1][1]), (1002, "日本 ÿ zzzz")]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    key = lambda r: (str(r.doc_id), r.held_out, r.score)
    near, far = (sorted(toxicity(docs, labels, most=m).collect(), key=key) for m in (6_000_000, 10))
    assert len(near) == len(far) == len(rows)
    assert [(r.doc_id, r.held_out, r.predicted) for r in near] == [(r.doc_id, r.held_out, r.predicted) for r in far]
    assert [r.score for r in far] == pytest.approx([r.score for r in near], abs=1e-6)
    short = {str(r.doc_id): r.score for r in toxicity(docs, labels, context=2).collect()}
    assert max(abs(short[str(r.doc_id)] - r.score) for r in far) > 0.01  # a shorter context tells other scores


def plain_kneser_ney(toxic, ordinary, context):
    """Ratio of a byte after its context, by the definition, from counts of strings: dicts and tuples alone."""
    d = 0.75
    strings = {k for k in toxic if toxic[k]} | {k for k in ordinary if ordinary[k]}
    levels = [strings]  # distinct strings of each length, and in how many longer ones each ends
    ends = []
    for _ in range(context):
        n = {}
        for s in levels[-1]:
            n[s[1:]] = n.get(s[1:], 0) + 1
        ends.append(n)
        levels.append(set(n))

    def backoff(s):
        if not s:
            return 1 / 256
        n = ends[context - len(s)]
        same = [v for k, v in n.items() if k[:-1] == s[:-1]]
        return max(n[s] - d, 0) / sum(same) + d * len(same) / sum(same) * backoff(s[1:])

    def left(counts, ctx):
        same = [v for k, v in counts.items() if k[:-1] == ctx and v]
        return d * len(same) / sum(same) if same else 1.0

    def probability(counts, s):
        total = sum(v for k, v in counts.items() if k[:-1] == s[:-1])
        own = max(counts.get(s, 0) - d, 0) / total if total else 0.0
        return own + left(counts, s[:-1]) * backoff(s[1:])

    def ratio(s):
        if s in strings:
            return np.log(probability(toxic, s) / probability(ordinary, s))
        if any(k[:-1] == s[:-1] for k in strings):
            return np.log(left(toxic, s[:-1]) / left(ordinary, s[:-1]))
        return 0.0

    return ratio


def plain_strings(word, context):
    seq = [0] * (context - 1) + [2] + list(word) + [3]
    return [tuple(seq[k - context : k + 1]) for k in range(context, len(seq))]


def plain_words(text):
    return re.findall(rb"[a-z\x80-\xff]+", lower(text).encode())


def test_toxicity_figures_by_brute_force():
    """The model's ratios, word by word, and the three figures of a text, against the definitions."""
    rng = random.Random(21)
    docs = [(" ".join("".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))) + ". 12, ", rng.random() < 0.4) for _ in range(40)]
    for context in (2, 5):
        toxic, ordinary = {}, {}
        for t, bad in docs:
            for w in set(plain_words(t)):
                for s in plain_strings(w, context):
                    here = toxic if bad else ordinary
                    here[s] = here.get(s, 0) + 1
        ratio = plain_kneser_ney(toxic, ordinary, context)
        keys = sorted(set(toxic) | set(ordinary))
        packed = np.array([int.from_bytes(bytes(k), "big") for k in keys])
        model = Model(packed, np.array([toxic.get(k, 0) for k in keys]), np.array([ordinary.get(k, 0) for k in keys]), context)
        some = [t for t, _ in docs[:12]] + ["", "zz ab zzzz", "abcé " * 50 + "bb", "12", "Ab AB"]
        got = model.figures(*as_bytes(pa.array(some)), stretch=4)
        for t, x in zip(some, got, strict=True):
            values = [sum(map(ratio, plain_strings(w, context))) for w in plain_words(t)]
            if not values:
                assert x.tolist() == [0, 0, 0]
                continue
            best = lambda v: max(sum(v[k : k + 4]) for k in range(max(1, len(v) - 3)))
            first = [v for k, (w, v) in enumerate(zip(plain_words(t), values, strict=True)) if w not in plain_words(t)[:k]]
            assert x == pytest.approx([sum(values) / len(values), best(values) / min(4, len(values)), best(first) / 4], abs=1e-5)


def test_toxicity_of_long_and_repeated_rows(spark):
    """A text beyond a step has the score that it has alone, and rows that repeat have theirs each."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["lo", "ma", "ra", "tine"], k=20)) + (" idiot moron" if k % 3 == 0 else "")) for k in range(120)]
    long = "lo ma ra tine " * 400_000
    rows += [(500, long), (500, long), (501, long + "idiot moron " * 30), (502, "idiot moron"), (502, "idiot moron")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity(frame(spark, rows).coalesce(1), labels).collect() if r.doc_id >= 500]
    by = {k: [x[1:] for x in got if x[0] == k] for k in (500, 501, 502)}
    assert [len(by[k]) for k in (500, 501, 502)] == [2, 1, 2] and len(set(by[500])) == len(set(by[502])) == 1
    assert by[500][0][1] == 0 and by[501][0][1] == 1 and by[502][0][1] == 1


@pytest.mark.parametrize("hot", [0, 1, 2])
def test_languages_of_a_doc_id_that_repeats(spark, hot):
    """One doc_id in 100,000 rows, in the sample or out of it, leaves a language's other documents as they are told."""
    rows = language_rows(240)
    many = spark.range(100_000).select(F.lit(1000 + hot).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, rows[0][1]).otherwise(rows[3][1]).alias("text"), F.lit("aa").alias("lang"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionAll(many)
    langs, net = language.fit(docs, training_steps=150)
    right = [predict(langs, net, *as_bytes(pa.array([t])))[0][0] == lang for k, t, lang in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(right) >= 0.95 * len(right)
    few = language.fit(docs, per_class=5, training_steps=1)[1]
    assert few is not None


def test_toxicity_of_a_doc_id_that_repeats(spark):
    """The calibration sample has one row of an id, however often it comes."""
    rows = [(k, f"plain words here {k} " + ("stupid idiot " * 3 if k % 3 == 0 else "kind people ")) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = next(k for k in range(120) if zlib.crc32(str(k).encode()) % 3 == 0)
    many = docs.unionAll(docs.filter(f"doc_id = {hot}").crossJoin(spark.range(50_000)).select("doc_id", "text"))
    (_, alone), (_, among) = fit(docs, labels), fit(many, labels)
    assert np.allclose(alone, among, rtol=0.5, atol=1.5)  # counts differ, the sample does not
    got = {r.doc_id: r.score for r in toxicity(many, labels).filter(f"doc_id <> {hot}").collect()}
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in got) >= 0.95 * len(got)


def test_items_that_share_a_window_over_repeated_lines():
    """A thousand items with one preamble against a step of lines that hold it: memory follows the places and the pairs of
    document and item, not items times places."""

    preamble = " ".join(f"p{k}" for k in range(16))
    items = [(str(k), f"{preamble} item{k} its own words {k}") for k in range(1000)]
    docs = [f"{preamble} other end\n" * 400] * 40 + [f"x {preamble} item7 its own words 7 y", "nothing here"] + [f"{preamble}\n" * 8000]
    bench = Benchmark(items)
    data = as_bytes(pa.array(docs))
    assert len(data[0]) > 1 << 20
    tracemalloc.start()
    before, (first, last), (doc, item, at, at_item, size) = shard_hits(bench, *data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    n = np.bincount(doc, minlength=len(docs)).tolist()
    assert n == [1000] * 41 + [0, 1000]
    longest = {(d, i): (x, y, s) for d, i, x, y, s in zip(*(v.tolist() for v in (doc, item, at, at_item, size)), strict=True)}
    assert longest[0, 5] == (0, 0, 16) and longest[40, 7] == (1, 0, 21) and longest[40, 8] == (1, 0, 16)
    assert (last - first).sum() == 16 * 400 * 40 + 21 + 16 * 8000
