"""Operators against plain loops, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visarium import tables
from visarium.functions import boxes, geometry, images, names, vectors
from visarium.functions.geometry import CropConfig, TrackConfig, smoothed
from visarium.operators import density, frames as fr, reconcile as rc, track
from visarium.operators import leader as leader_module
from visarium.operators.leader import leaders, ordered_leader
from visarium.operators.links import blocks_compared, nearest_distances, vector_links
from visarium.plans import pipelines as pl


def vecs(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v] if v is not None else None) for i, v in zip(ids or range(len(x)), x, strict=True)], "vec_id long, embedding array<double>")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def greedy(n, near):
    """The sequential rule: each unlabelled vertex leads and takes the unlabelled ones that it reaches."""
    label, k = [-1] * n, 0
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = k
        for j in range(i + 1, n):
            if label[j] < 0 and near(i, j):
                label[j] = k
        k += 1
    return label


@pytest.mark.parametrize("small", [10**6, 40, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_leader(spark, small, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08}
    want = greedy(n, lambda i, j: (i, j) in edges)
    v = spark.createDataFrame([(i, i * 3) for i in range(n)], "id long, ord long")
    got = ordered_leader(v, spark.createDataFrame(list(edges), "src long, dst long"), small=small)
    assert [r.label for r in got.orderBy("id").collect()] == want


def test_leaders_of_a_long_chain(spark):
    """Neighbours in a sequence: every second one leads. The end of the chain is decided in one task."""
    n = 300
    v = spark.range(n).select("id", F.col("id").alias("ord"))
    got = {r.id: r.leader for r in leaders(v, spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), small=295).collect()}
    assert got == {k: k - k % 2 for k in range(n)}


@pytest.mark.parametrize("metric, threshold, small", [("cosine", 0.3, 0), ("dot", 0.5, 500_000), ("euclid", 2.2, 500_000), ("adaptive", 2.6, 500_000), ("euclid", 0.3, 500_000)])
def test_leaders_by_prefixes(spark, monkeypatch, metric, threshold, small):
    """Vectors that a leader of a prefix reaches are in no list of links; labels are those of one vector after another."""
    rng = np.random.default_rng(3)
    x, tol = rng.normal(size=(150, 4)), rng.uniform(0.5, 2.6, 150)
    order = rng.permutation(150)
    listed, links = [], leader_module.lk.vector_links
    monkeypatch.setattr(leader_module.lk, "vector_links", lambda rows, *a: listed.append(rows.count()) or links(rows, *a))
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], int(order[k]), float(tol[k])) for k in range(150)], "id long, v array<double>, ord long, tol double").repartition(3)
    kind = "euclid" if metric == "adaptive" else metric
    got = {r.id: r.label for r in leader_module.vector_leaders(rows if metric == "adaptive" else rows.drop("tol"), threshold, kind, small, prefix=20).collect()}
    heads, want = [], {}
    for b in np.argsort(order):
        near = lambda a, b: {"cosine": lambda: x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= threshold, "dot": lambda: x[a] @ x[b] >= threshold, "euclid": lambda: np.linalg.norm(x[a] - x[b]) <= threshold, "adaptive": lambda: np.linalg.norm(x[a] - x[b]) <= tol[a]}[metric]()
        found = next((k for k, a in enumerate(heads) if near(a, b)), None)
        if found is None:
            heads.append(b)
            found = len(heads) - 1
        want[int(b)] = found
    assert got == want
    assert listed[0] == 20 and (threshold == 0.3 and metric == "euclid" or max(listed) < 75)


def test_leader_is_one_hop_and_empty(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, ord int")
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {r.id: r.leader for r in leaders(v, chain).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert ordered_leader(v.filter("false"), chain).count() == 0


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.6), ("dot", 1.0), ("euclid", 1.2)])
@pytest.mark.parametrize("block", [7, 1000])
def test_vector_links(spark, metric, threshold, block):
    x = np.random.default_rng(3).normal(size=(60, 4))
    x[5] = x[4]
    x[6] = 0
    x = [None if k == 9 else v for k, v in enumerate(x)]
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            if x[i] is None or x[j] is None:
                continue
            d = np.linalg.norm(x[i] - x[j]) if metric == "euclid" else x[i] @ x[j] / (max(np.linalg.norm(x[i]), 1e-12) * max(np.linalg.norm(x[j]), 1e-12) if metric == "cosine" else 1)
            if d <= threshold if metric == "euclid" else d >= threshold:
                want.add((i, j))
    assert {(r.src, r.dst) for r in vector_links(vecs(spark, x), threshold, metric, block=block).collect()} == want
    left, right = vecs(spark, x).filter("vec_id < 20"), vecs(spark, x).filter("vec_id >= 20")
    both = vector_links(left, threshold, metric, other=right, block=block)
    assert {(r.src, r.dst) for r in both.collect()} == {p for p in want if p[0] < 20 <= p[1]}
    assert vector_links(left.filter("false"), threshold, metric).count() == 0
    assert vector_links(left.filter("false"), threshold, metric, other=right).count() == vector_links(left, threshold, metric, other=right.filter("false")).count() == 0


def test_bounds_leave_clusters_apart_out(spark):
    """Narrow clusters are compared with themselves alone; vectors without structure cannot be told apart and all are."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([c + rng.normal(0, 0.01, (40, 16)) for c in centres])[rng.permutation(320)]
    kept, every = blocks_compared(vecs(spark, x), 0.9, block=10)
    assert kept < 0.4 * every
    assert vector_links(vecs(spark, x), 0.9, block=10).count() == 8 * 40 * 39 // 2
    kept, every = blocks_compared(vecs(spark, rng.normal(size=(320, 64))), 0.9, block=10)
    assert kept == every
    with pytest.raises(Exception, match="length|shape|dimension"):
        vector_links(vecs(spark, [[1, 2], [1, 2, 3]]), 0.5).count()


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.8), ("euclid", 0.5)])
def test_links_of_clustered_vectors_in_many_groups(spark, metric, threshold):
    rng = np.random.default_rng(13)
    x = np.concatenate([c + rng.normal(0, 0.2, (25, 3)) for c in rng.normal(size=(6, 3))] + [np.ones((20, 3))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = u @ u.T >= threshold if metric == "cosine" else d <= threshold
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    got = [(r.src, r.dst) for r in vector_links(vecs(spark, x), threshold, metric, block=6, group=2).collect()]
    if metric == "cosine":  # values on the threshold may fall either way in another order of sums
        unsure = {(i, j) for i, j in zip(*np.nonzero(np.abs(u @ u.T - threshold) < 1e-9), strict=True)}
        assert set(got) - unsure == want - unsure
    else:
        assert set(got) == want
    assert len(got) == len(set(got))
    core = np.sort(d, axis=1)[:, 4]
    assert np.allclose([r.core for r in nearest_distances(vecs(spark, x), 5, block=6, group=2).orderBy("vec_id").collect()], core)


def test_thresholds_are_inclusive(spark):
    assert vector_links(vecs(spark, [[0, 0], [3, 4]]), 5.0, "euclid").count() == 1
    assert vector_links(vecs(spark, [[1, 0], [0.5, 0]]), 0.5, "dot").count() == 1


def test_nearest_distances(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    x[20:35] = x[20]
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 2]
    got = [r.core for r in nearest_distances(vecs(spark, x), 3, block=8).orderBy("vec_id").collect()]
    assert np.allclose(got, d)


def test_leaders_by_vectors(spark):
    x = np.random.default_rng(5).normal(size=(70, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = [r.label for r in pl.cosine_leaders(vecs(spark, x), 0.7).orderBy("vec_id").collect()]
    assert got == greedy(70, lambda i, j: u[i] @ u[j] >= 0.7)
    copies = np.concatenate([x, x[:30], x[:30]])
    uc = np.concatenate([u, u[:30], u[:30]])
    got = [r.label for r in pl.cosine_leaders(vecs(spark, copies), 0.7).orderBy("vec_id").collect()]
    assert got == greedy(130, lambda i, j: uc[i] @ uc[j] >= 0.7)
    assert len(set(r.label for r in pl.cosine_leaders(vecs(spark, [[0, 0], [0, 0], [1, 1], [2, 2]]), 0.7).collect())) == 3
    rows = [None if k == 3 else v for k, v in enumerate(x)]
    real = [k for k in range(70) if k != 3]
    want = greedy(69, lambda i, j: np.linalg.norm(x[real[i]] - x[real[j]]) <= 0.9)
    assert [r.label for r in pl.euclid_leaders(vecs(spark, rows), 0.9).orderBy("vec_id").collect()] == want[:3] + [-1] + want[3:]
    q = 1 / (1 + np.linalg.norm(x - x.mean(0), axis=1))
    order = sorted(range(70), key=lambda k: (-q[k], k))
    lab = greedy(70, lambda i, j: np.linalg.norm(x[order[i]] - x[order[j]]) <= 0.55 * (1 + (1 - q[order[i]]) * 0.3))
    assert [r.label for r in pl.adaptive_leaders(vecs(spark, x)).orderBy("vec_id").collect()] == [lab[order.index(k)] for k in range(70)]
    assert [r.label for r in pl.cosine_leaders(vecs(spark, x[:1])).collect()] == [0]


def test_density_methods(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 4, (5, 8))
    x = np.concatenate([c + rng.normal(0, 0.05, (20, 8)) for c in centers] + [rng.uniform(-8, 8, (15, 8))])
    label = lambda n, *a, **kw: density.cluster(vecs(spark, x[:n]), *a, **kw).orderBy("vec_id").toPandas()
    got = label(115, "hdbscan")
    assert set(got["label"]) - {-1} == set(range(5)) and got["probability"].between(0, 1).all()
    assert all(len(set(got["label"][20 * k : 20 * k + 20])) == 1 for k in range(5))
    for name, options in (("agglomerative", {"clusters": 5}), ("spectral", {"clusters": 5}), ("chinese_whispers", {"tolerance": 1.0})):
        got = label(100, name, **options)["label"]
        assert len(set(got)) == 5 and all(len(set(got[20 * k : 20 * k + 20])) == 1 for k in range(5))
    got = label(100, "affinity_propagation")["label"]
    assert all(len(set(got[:20]) & set(got[20 * k : 20 * k + 20])) == 0 for k in range(1, 5))
    for name in density.METHODS:
        for n in (0, 1):
            assert label(n, name)["label"].tolist() == [0] * n
    out, failed = pl.cluster_methods(vecs(spark, x), ["hdbscan", "nothing"])
    assert list(failed) == ["nothing"] and out.count() == len(x)


def test_ordinal_in_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "k int")
    for most in (1000, 10):
        assert all(r.n == r.k for r in fr.ordinal(df, [F.col("k")], "n", one_task=most).collect())


def test_boxes_and_names(spark):
    b = boxes.box(F.lit(5), F.lit(5), F.lit(5), F.lit(9))
    assert not one(spark, boxes.valid(b))
    with pytest.raises(ValueError):
        boxes.box_from("odd", *[F.lit(1)] * 4)
    for raw, want in (("a/b:c ", "a_b_c"), ("...", ""), ("", ""), (" .x. ", "x")):
        assert one(spark, names.sanitised(F.lit(raw))) == want
    assert one(spark, names.face_name(F.lit("f.jpg"), F.lit(123456))) == "f_face_123456.jpg"
    assert one(spark, names.cluster_name(F.lit(1234))) == "person_1234" and one(spark, names.cluster_name(F.lit(-1))) == "unknown"
    assert one(spark, names.annotation(F.lit("x_1.5_7_face_2_(1, 2,3, 4).png")))["bbox"]["bottom"] == 4
    assert one(spark, names.annotation(F.lit("x_face_2.png"))) is None
    assert one(spark, names.is_image(F.lit("A.JPG"))) and not one(spark, names.is_image(F.lit("a.txt")))
    for raw, want in (("frame_12.34s_1.jpg", 12.34), ("frame_12_3.jpg", 12.0), ("x.jpg", None)):
        assert one(spark, names.seconds_of(F.lit(raw))) == want


def test_confidence_falls_back(spark):
    rows = [("f", [((0, 0, 2, 2), [1.0], None, 0.7), ((0, 0, 2, 2), None, None, None), ((3, 3, 3, 9), None, 0.5, None)])]
    df = spark.createDataFrame(rows, "frame_name string, faces array<struct<bbox:struct<left:int,top:int,right:int,bottom:int>,embedding:array<double>,confidence:double,score:double>>")
    assert [(r.face_id, r.confidence) for r in fr.explode_detections(df).orderBy("face_id").collect()] == [(0, 0.7), (1, 1.0)]


def test_resize(spark):
    for (w, h), want in {(1080, 1920): (1080, 1920, False), (1080, 1080): (1080, 1296, True), (608, 1080): (1080, 1920, False)}.items():
        assert tuple(one(spark, geometry.resize_dims(F.lit(w), F.lit(h)))) == want
    assert one(spark, geometry.crop_left(F.lit(300), F.lit(500), 1080)) == -580


def test_smoothers(spark):
    c, t = CropConfig(), TrackConfig()
    at = 960
    for _ in range(300):
        at = smoothed(1500, at, c.alpha, c.deadzone, c.max_jump)
    assert at == 1481
    assert smoothed(13, 13, t.alpha, t.deadzone, t.max_jump) == 12
    pairs = [(random.Random(k).randint(0, 2000), random.Random(-k).randint(0, 2000)) for k in range(200)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", geometry.smoothed_column(F.col("a"), F.col("b"), c.alpha, c.deadzone, c.max_jump).alias("x")).collect()
    assert all(r.x == smoothed(r.a, r.b, c.alpha, c.deadzone, c.max_jump) for r in got)
    assert track.step_person(None, None, 500) == 250 and track.step_person(700.0, 250, 500) == 256 and track.step_person(None, 0, 500) == 40 * 3 // 20


def test_missing_and_candidates(spark):
    rows = [(1, k, k == 3, k == 20) for k in range(25)]
    runs = track.missing_runs(spark.createDataFrame(rows, "video_id long, frame_idx long, has_face boolean, scene boolean"))
    got = [r.missing for r in runs.orderBy("frame_idx").collect()]
    assert got == [1, 2, 3, 0, *range(1, 17), 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(None, 5, 6, None, 14), (None, 5, 6, None, 15), (4, 5, 6, None, 15), (None, None, None, 9, 15)], "face_x int, person_x int, object_x int, motion_x int, missing long")
    assert [r.cand for r in track.crop_candidates(df).collect()] == [None, 5, 4, 9]


def test_rasters(spark):
    rng = np.random.default_rng(1)
    tile = rng.integers(0, 256, (5, 7))
    pad = np.pad(tile, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * tile
    col = F.array(*(F.lit(int(v)) for v in tile.ravel()))
    assert one(spark, images.laplacian(col, 7, 5)) == lap.ravel().tolist()
    assert one(spark, images.variance(col)) == pytest.approx(tile.var())
    assert one(spark, images.face_quality(F.lit(None).cast("array<int>"), 7, 5, F.lit(1))) == 0.0
    oval = np.array(one(spark, images.oval_mask(9, 9, 0.3, 0.4))).reshape(9, 9)
    assert oval[4, 4] == 255 and oval[0, 0] == 0 and (oval == oval[::-1]).all()
    assert one(spark, images.gray(F.lit(10), F.lit(20), F.lit(30))) == round(0.114 * 10 + 0.587 * 20 + 0.299 * 30)


def test_vectors(spark):
    assert one(spark, vectors.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)
    s = vectors.standardise(vecs(spark, [[1, 5], [3, 5]]), "vec_id", "embedding").orderBy("vec_id").collect()
    assert [r.scaled for r in s] == [[-1.0, 0.0], [1.0, 0.0]]
    p = vectors.pca(vecs(spark, np.random.default_rng(0).normal(size=(4, 9))), "vec_id", "embedding")
    assert {len(r.reduced) for r in p.collect()} == {3}


def people(spark, rows):
    return spark.createDataFrame(rows, "face_id long, cluster string, embedding array<double>, quality double, ts double")


def test_regroup(spark):
    rows = [(1, "person_000", [1.0, 0.0], 1.0, 0.0), (2, "person_001", [0.99, 0.1], 1.0, 0.0), (3, "person_002", [0.0, 1.0], 1.0, 5.0), (4, "unknown", [0.05, 1.0], 1.0, 0.0), (5, "unknown", [-1.0, -1.0], 1.0, 0.0)]
    out, stats = rc.regroup(people(spark, rows))
    assert {r.face_id: r.cluster for r in out.collect()} == {1: "person_000", 2: "person_000", 3: "person_001", 4: "person_001", 5: "unknown"}
    assert stats["successful_merges"] == 1 and stats["assigned"] == 1
    out, _ = rc.regroup(people(spark, rows), "temporal_context")
    assert {r.face_id: r.cluster for r in out.collect()}[2] == "person_000"
    with pytest.raises(ValueError):
        rc.regroup(people(spark, rows), "other")
    alone, _ = rc.regroup(people(spark, [rows[2], rows[3]]))
    assert {r.cluster for r in alone.collect()} == {"person_000"}
    lost, _ = rc.regroup(people(spark, [*rows, (6, None, [1.0, 0.01], 1.0, 0.0), (7, None, [-1.0, 0.0], 1.0, 0.0)]))
    assert {r.face_id: r.cluster for r in lost.collect() if r.face_id > 5} == {6: "person_000", 7: "unknown"}


def test_folder_similarity_takes_the_first_face_whatever_its_quality(spark):
    faces = people(spark, [(1, "a", [1.0, 0.0], 0.0, 0.0), (2, "b", [1.0, 0.0], 0.0, 0.0)])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert sorted((r.b, r.sim) for r in rc.cluster_similarity(faces, pairs).collect()) == [("b", 1.0), ("c", 0.0)]


def test_overlap_is_strict(spark):
    # 3 shared of 10 times: exactly 0.3 is not over it.
    rows = [(k, "a", [1.0], 1.0, float(k)) for k in range(6)] + [(100 + k, "b", [1.0], 1.0, float(k)) for k in range(3, 10)]
    assert rc.time_overlap(people(spark, rows)).count() == 0
    assert rc.time_overlap(people(spark, rows), 0.29).count() == 1


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.9])
def test_overlap_by_brute_force(spark, least):
    rng = random.Random(3)
    sets = {f"c{k:02d}": {0.0} | {float(rng.randint(1, 12)) for _ in range(rng.randint(0, 9))} for k in range(25)}
    sets["x"] = set(sets["c03"])
    rows = [(i, c, [1.0], 1.0, t) for i, (c, t) in enumerate((c, t) for c, ts in sets.items() for t in ts)] + [(900, "c01", [1.0], 1.0, None)]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r.a, r.b): r.jaccard for r in rc.time_overlap(people(spark, rows), least).collect()}
    assert got == {k: v for k, v in want.items() if v > least}


def test_a_time_that_all_clusters_have_makes_no_pairs(spark):
    rows = [(k, f"c{k % 60:02d}", [1.0], 1.0, 0.0 if k < 60 else float(k)) for k in range(60 * 6)]
    faces = people(spark, rows)
    with tables.scope(spark):
        assert rc.time_overlap(faces).count() == 0
        met = [p for p in tables._SCOPES[-1] if "/met-" in p]
        assert len(met) == 1 and spark.read.parquet(met[0]).count() == 0


def test_unknown_needs_positive_similarity(spark):
    reps = people(spark, [(1, "b", [1.0, 0.0], 1.0, 0.0), (2, "a", [1.0, 0.0], 1.0, 0.0)])
    ask = people(spark, [(7, "unknown", [0.0, 1.0], 1.0, 0.0), (8, "unknown", [-1.0, 0.0], 1.0, 0.0), (9, "unknown", [2.0, 0.0], 1.0, 0.0)])
    assert [(r.face_id, r.cluster) for r in rc.assign_unknown(ask, reps, 0.0).collect()] == [(9, "a")]
    assert rc.move_rate(ask.filter("false"), ask.filter("false")).first().percent == 0.0


def test_marks_take_form_once_a_time(spark):
    """A form of the annotations is worked out for each time, not for each frame that meets it."""
    from visarium.operators.frames import annotate_at

    frames = spark.createDataFrame([(v, k, k / 25.0) for v in range(40) for k in range(3)], "video_id long, frame_idx long, ts_sec double")
    box = F.struct(*(F.col("x").alias(s) for s in ("left", "top", "right", "bottom")))
    marks = spark.createDataFrame([(k / 25.0, f, f) for k in range(2) for f in (7, 5)], "seconds double, frame long, x int").select("seconds", "frame", box.alias("bbox"), F.lit("p").alias("label"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def form(found):
        calls.add(1)
        return ";".join(f"{a.label}:{a.bbox.left}" for a in found)

    got = {(r.video_id, r.frame_idx): r.annotations for r in annotate_at(frames, marks, form("annotations")).collect()}
    assert got == {(v, k): "p:5;p:7" if k < 2 else None for v in range(40) for k in range(3)} and calls.value == 2


def test_texts_of_a_time_are_written_once(spark, tmp_path):
    """Frames of all videos share a time's text: written tables grow with the texts, not with texts times frames."""
    from visarium.operators.frames import annotate_at

    rng = np.random.default_rng(3)
    marks = spark.createDataFrame([(k / 25, 1, rng.bytes(40_000).hex()) for k in range(20)], "seconds double, frame long, label string").withColumn("bbox", F.struct(F.lit(1).alias("left")))
    frames = spark.range(600).select((F.col("id") / 30).cast("long").alias("video_id"), (F.col("id") % 30).alias("frame_idx")).withColumn("ts_sec", F.round(F.col("frame_idx") / 25, 2))
    drawn = annotate_at(frames, marks, F.array_join(F.transform("annotations", lambda a: a["label"]), ";")).select("video_id", "frame_idx", "annotations")
    drawn.write.parquet(f"{tmp_path}/drawn")
    assert sum(f.stat().st_size for f in (tmp_path / "drawn").glob("*.parquet")) < 10_000_000
    label = {r.seconds: r.label for r in marks.collect()}
    got = {(r.video_id, r.frame_idx): r.annotations for r in spark.read.parquet(f"{tmp_path}/drawn").collect()}
    assert got == {(v, k): label.get(k / 25) for v in range(20) for k in range(30)}


def test_own_tolerances_bound_the_links(spark, monkeypatch):
    """Leaders with tolerances of their own list links within the largest of these, not within the caller's wide bound."""
    x = np.random.default_rng(4).normal(0, 1, (40, 3))
    rows = spark.createDataFrame([(k, v.tolist(), k, 0.3 + k / 100) for k, v in enumerate(x)], "id long, v array<double>, ord long, tol double")
    asked, links = [], leader_module.lk.vector_links
    monkeypatch.setattr(leader_module.lk, "vector_links", lambda df, threshold, *a: asked.append(threshold) or links(df, threshold, *a))
    got = {r.id: r.label for r in leader_module.vector_leaders(rows, 50.0, "euclid").collect()}
    heads, want = [], {}
    for k, v in enumerate(x):
        near = [i for i, h in enumerate(heads) if np.sqrt(((v - x[h]) ** 2).sum()) <= 0.3 + h / 100]
        want[k] = near[0] if near else len(heads)
        heads += [] if near else [k]
    assert got == want and asked == [0.69]
