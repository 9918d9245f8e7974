"""Links by buckets against the exact join."""

from __future__ import annotations

import numpy as np
import pytest

from visarium.operators import candidates
from visarium.operators.candidates import Plan, bucket_links, pairs_compared, plan_for, recall_of
from visarium.operators.links import vector_links


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def clustered(seed, n=40, copies=20, size=24, spread=0.12):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(n, size)), copies, 0) + spread * rng.normal(size=(n * copies, size))


def paired(seed, n=600, size=32, close=0.93):
    """Vectors without structure, each with one at about a given cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(n, size))
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = np.minimum(1, close + 0.06 * rng.random(n))[:, None]
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * other])


@pytest.mark.parametrize("kind, metric, threshold", [("clustered", "cosine", 0.92), ("unstructured", "cosine", 0.92), ("unstructured", "euclid", 0.45)])
def test_recall(spark, kind, metric, threshold):
    x = clustered(1) if kind == "clustered" else paired(2)
    df = frame(spark, x)
    found, every = recall_of(df, threshold, metric)
    assert every > 300 and found >= 0.9 * every
    exact = {(r.src, r.dst): r.value for r in vector_links(df, threshold, metric).collect()}
    got = bucket_links(df, threshold, metric, block=16)
    assert all(exact[r.src, r.dst] == pytest.approx(r.value) for r in got.collect())  # nothing else, each once
    assert got.count() == got.select("src", "dst").distinct().count()


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.8), ("euclid", 1.2)])
def test_recall_is_counted_without_the_links(spark, monkeypatch, metric, threshold):
    """The same counts as of the links themselves, of a plan that misses many, and no table of links to join."""
    df = frame(spark, clustered(4, 20, 12))
    plan = Plan(metric, 6, 2, 0.0 if metric == "cosine" else 1.5, 0.5)
    found, every = bucket_links(df, threshold, metric, plan=plan).count(), vector_links(df, threshold, metric).count()
    assert 0 < found < every
    monkeypatch.setattr(candidates, "bucket_links", None)
    monkeypatch.setattr(candidates.lk, "vector_links", None)
    assert recall_of(df, threshold, metric, plan=plan, block=16) == (found, every)
    assert recall_of(df.limit(0), threshold, metric) == (0, 0)


def test_work_falls_without_structure(spark):
    """A tenth of all pairs at most, where no bound of the exact join leaves anything out."""
    x = paired(3, 3000, 48)
    df, plan = frame(spark, x), plan_for(len(x), 0.92)
    assert pairs_compared(df, plan) < 0.1 * len(x) * (len(x) - 1) / 2
    assert plan.found >= 0.95


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.src, r.dst) for r in bucket_links(df, 0.9).collect()] == [(1, 2)]
    assert [(r.src, r.dst) for r in bucket_links(df, 0.5, "euclid").collect()] == [(1, 2)]
    assert bucket_links(df.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        bucket_links(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), 0.9)
    with pytest.raises(ValueError, match="buckets"):
        bucket_links(df, 0.5, "dot")
    hot = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(150)], "vec_id long, embedding array<double>")
    assert bucket_links(hot, 0.99, block=20).count() == 150 * 149 // 2  # equal vectors are each other's links
