"""Jaccard join, filter audit and Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from visarium.llm import jaccard_join, merkle
from visarium.llm.arrays import as_bytes
from visarium.llm.filter_audit import filter_audit
from visarium.llm.jaccard_join import jaccard_classes, shingle_sets
from visarium.llm.merkle import folded, merkle_manifest, proof_digest, verified_manifest

SPACE = "[^\x20\x09-\x0d]+"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(SPACE, lower(t))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_jaccard(rows, percent=80):
    sets, root = brute_sets(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k in range(len(rows)):
        least.setdefault(top(k), []).append(rows[k][0])
    key = lambda v: (v is None, v or 0)
    return sorted(((rows[k][0], len(sets[k]), min(least[top(k)], key=key)) for k in range(len(rows))), key=repr)


def near_copies(seed, groups=12, copies=9):
    """Groups whose members differ from their base in some words: links, and pairs just beside them."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for g in range(groups):
        base = rng.choice(words, rng.integers(3, 90)).tolist()
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.integers(0, 1 + len(t) // 18)):
                t[rng.integers(len(t))] = str(rng.choice(words))
            if rng.random() < 0.3:
                t = t[: max(1, len(t) - int(rng.integers(0, 6)))]
            out.append(" ".join(t))
    return out


HOSTILE = ["", None, " \t\n", "one", "ONE", "one two three four", "one two three four five", "one two three four five six", "a  b\tc\nd\x0be f\x0cg", "é ü ß 漢字 x y z", "q " * 5000, "q " * 4999, "x" * 70_000, "same line of words here\n" * 40, "same line of words here\n" * 41]


@pytest.mark.parametrize("block", [3, 4096])
def test_jaccard(spark, block):
    """Small blocks send the lists through the ways for long ones."""
    some = near_copies(1) + HOSTILE + near_copies(2, 1, 45)
    rows = list(enumerate(some)) + [(1, some[1]), (1, some[30]), (None, some[0]), (None, "alone and only once here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard_classes(df, block=block).collect()]
    want = brute_jaccard(rows)
    assert sorted(got, key=repr) == want
    assert sum(a != c for a, _, c in want) > 60


def test_jaccard_longer_lists_than_first_scan(spark, monkeypatch):
    """The first scan looks at few pairs; the second finds the rest."""
    monkeypatch.setattr(jaccard_join, "FIRST", 1)
    rows = list(enumerate(near_copies(3, 2, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 4096):
        assert sorted(map(tuple, jaccard_classes(df, block=block).collect()), key=repr) == brute_jaccard(rows)


def test_jaccard_boundary_between_light_and_heavy(spark):
    """Many short sets with a common line: subsets are worth their rows, and sets on either side of the boundary link."""
    line = "the very same line that all of them have"
    rows = [(k, f"{line} {k} {k % 7}" if k % 3 else f"{line} {line} {k % 5} tail {k % 2}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(df).collect()), key=repr) == brute_jaccard(rows)


@pytest.mark.parametrize("percent", [50, 90])
def test_jaccard_other_similarities(spark, percent):
    rows = list(enumerate(near_copies(5, 6, 8) + HOSTILE[:8]))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_jaccard(rows, percent)


def test_shingle_sets():
    texts = [t or "" for t in HOSTILE]
    values, cuts = shingle_sets(*as_bytes(pa.array(texts)))
    want = brute_sets(list(enumerate(texts)))
    assert np.diff(cuts).tolist() == [len(x) for x in want]
    own = [set(values[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert all(len(own[i] & own[j]) == len(want[i] & want[j]) for i in range(len(own)) for j in range(i))


def test_jaccard_empty_and_clashing_columns(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = "sid digest n hashes bits h df key kind m pos part comp role a b root found span step".split()
    rows = [(k, t, *[k] * len(names)) for k, t in [(5, "a b c d e f"), (3, "A b c d e f"), (4, None), (4, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    assert sorted(map(tuple, jaccard_classes(df).collect())) == [(3, 2, 3), (4, 0, 4), (4, 0, 4), (5, 2, 3)]


def brute_audit(docs, labels):
    """Every order, one document after another."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        t = t or ""
        w = re.findall(SPACE, t)
        out = {"A"} if len(w) < 200 else set()
        out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        out |= {"D"} if re.search("[#$%&*|]", t) else set()
        return out | ({"E"} if i is not None and first[t] < i else set())

    every = [(i, p or "", fails(i, t)) for i, t, p in docs]
    found, total = {}, Counter()
    for part in {p for _, p, _ in every}:
        own = [(i, f) for i, p, f in every if p == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for k, f in enumerate(order):
                lost = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                again = sum(f in d[1] and bool(d[1] & set(order[:k])) for d in own)
                found[part, "".join(order), k + 1] = [len(alive), len(lost), again, sum(d[1] == {f} for d in own), sum(d[0] in good for d in lost), sum(d[0] in toxic for d in lost)]
                total[part, f] += len(lost)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_filter_audit(spark):
    rng = np.random.default_rng(0)
    docs = []
    for k in range(70):
        n = int(rng.choice([3, 150, 199, 200, 260]))
        words = [f"w{rng.integers(40 if rng.random() < 0.5 else 4000)}" for _ in range(n)]
        words = [w.upper() if rng.random() < 0.2 * (k % 2) else w for w in words]
        docs.append((k, " ".join(words) + (" 5 %" if k % 5 == 0 else ""), ["en", "de", None, ""][k % 4]))
    docs += [(100 + k, docs[k][1], "en") for k in range(20)] + [(7, docs[7][1], "de"), (None, docs[3][1], "en"), (None, None, "fr"), (200, "", "fr"), (201, None, "fr")]
    docs += [(300, "A" * 3 + "b" * 97, "x"), (301, "A" * 4 + "é" * 96, "x"), (302, "w " * 400, "x"), (303, " ".join(map(str, range(100))) + " " + "1 " * 100, "x"), (304, "long " * 60_000 + "|", "x")]
    labels = [(k, k % 2, (k % 7 == 0) + 0) for k in range(0, 110, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    frame = spark.createDataFrame([(*d, 1, 1, 1) for d in docs], "doc_id long, text string, lang string, fails long, part long, n long").repartition(3)
    got = filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == brute_audit(docs, labels)
    assert got.count() == 600 * len({p or "" for _, _, p in docs})


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    alone = filter_audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert alone.count() == 600 and {r.kept + r.removed + r.redundant for r in alone.filter("step = 1").collect()} == {1}


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def brute_merkle(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""

    def tree(nodes):
        """Root, and of each leaf its siblings (left, right) level by level."""
        proof, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                proof[k].append((run[: a % 16], run[a % 16 + 1 :]))
            nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
            at = [a // 16 for a in at]
        return nodes[0], proof

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        own[s] = tree([leaf_of(r) for r in by[s]])
    if not names:
        return []
    root, above = tree([own[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for r, proof in zip(by[s], own[s][1], strict=True):
            path = proof + up
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            d = leaf_of(r | {"text": lower(r["text"]) if hit and r["text"] is not None else r["text"]})
            for left, right in path:
                d = sha(*left, d, *right)
            out.append((r["doc_id"], leaf_of(r), own[s][0], root, sha(*(x for a, b in path for x in a + b)), d, d == root))
    return sorted(out, key=repr)


def rows_of(sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append({"doc_id": k if k % 11 else None, "text": [None, "", f"Text {k}", "É a\n" * (k % 9)][k % 4], "lang": None if k % 3 else "en", "source": source, "n_chars": k if k % 5 else None})
            k += 1
    return out


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 2}, {"a": 16, "b": 17}, {"hot": 600, "b": 33, "ä": 257, None: 1, "Z": 16, "": 15}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_merkle(spark, sizes):
    rows = rows_of(sizes)
    rows += [dict(rows[0]), dict(rows[0])]  # rows that are the same in everything
    df = spark.createDataFrame([tuple(r[n.split()[0]] for n in FIELDS.split(", ")) for r in rows], FIELDS).repartition(5)
    assert sorted(map(tuple, verified_manifest(df).collect()), key=repr) == brute_merkle(rows)


def test_merkle_climbs_over_several_rounds(spark, monkeypatch):
    """One level a round, from many small stretches."""
    monkeypatch.setattr(merkle, "CLIMB", 1)
    rows = rows_of({"a": 700, "b": 40})
    df = spark.createDataFrame([tuple(r[n.split()[0]] for n in FIELDS.split(", ")) for r in rows], FIELDS).repartition(7)
    assert sorted(map(tuple, verified_manifest(df).collect()), key=repr) == brute_merkle(rows)


def test_merkle_proofs_and_empty(spark):
    """The operator's own output: proofs that fold to the root, for further columns and no rows as well."""
    assert verified_manifest(spark.createDataFrame([], FIELDS)).count() == 0
    names = "tree size level idx digest children at part start n before above run up pos name trees leaf claimed proof".split()
    rows = rows_of({"a": 20, "b": 3})
    df = spark.createDataFrame([(*(r[n.split()[0]] for n in FIELDS.split(", ")), *[1] * len(names)) for r in rows], FIELDS + ", " + ", ".join(f"{n} long" for n in names))
    got = merkle_manifest(df).withColumn("end", folded(merkle.F.col("leaf"), merkle.F.col("proof"))).withColumn("p", proof_digest(merkle.F.col("proof"))).collect()
    assert len(got) == 23 and all(r["end"] == r["root"] and r["claimed"] == r["leaf"] for r in got)
    assert {len(r["proof"]) for r in got if r["source"] == "a"} == {3} and len({r["p"] for r in got}) > 20
    assert all(len(s["left"]) % 64 == 0 and len(s["right"]) % 64 == 0 for r in got for s in r["proof"])
