"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import types as T

import corpus_pipeline as cp
from tests.llm.test_ops_1_4 import brute_components, brute_fingerprint, lower, texts
from visarium.llm.tables import shared_dir

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def brute(rows, items):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in rows:
        last[lower(r[1])] = max(last.get(lower(r[1]), -1), r[0])
    rows = [r for r in rows if last[lower(r[1])] == r[0]]
    roots = brute_components([brute_fingerprint(r[1]) for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
    windows = {tuple(w[k : k + min(13, len(w))]) for w in map(words, items) for k in range(len(w) - min(13, len(w)) + 1) if w}
    out = []
    for r in rows:
        w, hit = words(r[1]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_pipeline(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    some = texts(80) + ["", "123 456", None, item + " and more", "short item here", f"{item} " + "other words follow " * 200]
    rows = sorted((k, t, "en" if k % 2 else "de", "s", 1) for k, t in enumerate(some))
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [item, "short item here", "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    want = brute(rows, [i or "" for i in items])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == SCHEMA.names
        out.write.parquet(f"{d}/s{k}")
        docs = spark.read.parquet(f"{d}/s{k}")
    assert sorted(map(tuple, docs.collect())) == want
    folder = Path(shared_dir(spark), "visarium")
    there = set(folder.iterdir())
    pieces = cp.run(spark, d).collect()
    # Of the stages before the last only what it reads is left; packing's own tables are the result's.
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - there} <= {"decontaminate", "pieces", "merged"}
    assert {p.doc_id for p in pieces} == {r[0] for r in want}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, tmp_path, k):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    """Filters return every column as it came, whatever its name, and one of rows that are the same."""
    names = "uid digest verify node span best n shard _key _row _gone fp keep fold a b".split()
    rows = [(k, t, "en", *([k] * len(names))) for k, t in [(1, "ab cd ef"), (1, "ab cd ef"), (2, "AB cd ef"), (3, "other words here"), (4, None), (5, "")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([(1, "other words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [sorted(r.doc_id for r in out.collect()) for k in range(4) for out in [cp.STAGES[k][1](spark, docs, str(tmp_path))] if out.columns == docs.columns]
    assert kept == [[1, 1, 2, 3], [2, 3, 5], [1, 3, 4], [1, 1, 2, 4, 5]]
    assert {r.doc_id for r in cp.STAGES[4][1](spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4, 5}
