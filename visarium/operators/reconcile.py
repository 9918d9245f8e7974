"""Reconciling clusters: representatives, consensus and time overlap, merges, and faces without a cluster.

Tables: faces (face_id, cluster, embedding, quality, and ts where time is used). Merges are rows (src, dst), applied by a
join; no files move.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visarium.functions.vectors import cosine, doubles, l2_normalise
from visarium.operators.frames import ordinal
from visarium.operators.leader import leaders
from visarium.operators.links import vector_links
from visarium.tables import stored

log = logging.getLogger(__name__)
#: Usual numbers: representatives of a cluster, similarity of two faces, share of similar pairs, overlap in time.
REPRESENTATIVES, SIMILARITY, CONSENSUS, OVERLAP = 5, 0.9, 0.9, 0.3


def top_reps(faces: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """The n faces of the best quality in each cluster, with their rank; of equal ones the smaller face_id."""
    best = Window.partitionBy("cluster").orderBy(F.desc("quality"), "face_id")
    return faces.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def best_face(faces: DataFrame) -> DataFrame:
    """cluster, face_id of the best quality above 0; of equal ones the smaller face_id. Clusters without one have none."""
    return faces.filter("quality > 0").groupBy("cluster").agg(F.min_by("face_id", F.struct(-F.col("quality"), F.col("face_id"))).alias("face_id"))


def consensus_pairs(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b (a < b), consensus, mean_sim, max_sim of clusters with some pair of representatives this similar.

    consensus is the share of similar pairs; the mean over all pairs is the dot product of the sums of unit vectors, so
    pairs that are not similar are never made."""
    unit = reps.select("cluster", "face_id", l2_normalise(doubles(F.col("embedding"))).alias("unit"))
    links = vector_links(reps, similarity, "cosine", "face_id", "embedding")
    whose = reps.select("face_id", "cluster")
    named = links.join(whose.toDF("src", "ca"), "src").join(whose.toDF("dst", "cb"), "dst").filter("ca <> cb")
    found = named.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"), F.max("value").alias("max_sim"))
    parts = unit.select("cluster", F.posexplode("unit").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("s"))
    size = unit.groupBy("cluster").agg(F.count("*").alias("k"))
    per = stored(sums.join(size, "cluster"), "sums")
    full = found.join(per.toDF("a", "sa", "ka"), "a").join(per.toDF("b", "sb", "kb"), "b")
    total = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return full.select("a", "b", (F.col("n") / (F.col("ka") * F.col("kb"))).alias("consensus"), (total / (F.col("ka") * F.col("kb"))).alias("mean_sim"), "max_sim")


def merges_of(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst of each cluster that an earlier one (by name) takes in; clusters(cluster), edges(a, b)."""
    vertices = clusters.select(F.col("cluster").alias("id"), F.col("cluster").alias("ord")).distinct()
    pairs = edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return leaders(vertices, pairs).filter("id <> leader").select(F.col("id").alias("src"), F.col("leader").alias("dst"))


def consensus_merges(faces: DataFrame, n: int = REPRESENTATIVES, similarity: float = SIMILARITY, consensus: float = CONSENSUS) -> DataFrame:
    reps = stored(top_reps(faces, n), "reps")
    return merges_of(faces, consensus_pairs(reps, similarity).filter(F.col("consensus") >= consensus))


def time_overlap(faces: DataFrame, least: float = OVERLAP) -> DataFrame:
    """a, b (a < b), jaccard of clusters whose sets of times overlap by more than this share.

    Two clusters that overlap so much share one of their rarest times already: of n times, in order of how many clusters
    have them, all but the last ceil(least * n) - 1 (prefix filtering; Chaudhuri, Ganti and Kaushik, 2006). Clusters meet in
    those alone, so a time that all clusters have makes no pairs of them; only the pairs that met are counted."""
    times = stored(faces.filter(F.col("ts").isNotNull()).select("cluster", "ts").distinct(), "times")
    size = stored(times.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    held = times.groupBy("ts").agg(F.count("*").alias("held"))
    rare = Window.partitionBy("cluster").orderBy("held", "ts")
    first = times.join(held, "ts").join(size, "cluster").withColumn("place", F.row_number().over(rare))
    # A little less than the share itself, for rounding.
    first = stored(first.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (least - 1e-9)) + 1).select("cluster", "ts"), "rarest")
    met = stored(first.toDF("a", "ts").join(first.toDF("b", "ts"), "ts").filter("a < b").select("a", "b").distinct(), "met")
    both = met.join(times.toDF("a", "ts"), "a").join(times.toDF("b", "ts"), ["b", "ts"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    full = both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return full.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") > least)


def cluster_similarity(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with sim, the cosine of the two clusters' first representatives, whatever their quality; 0 where one has
    none. Gate first, compare then."""
    best = top_reps(faces, 1).select("cluster", doubles(F.col("embedding")).alias("v"))
    full = pairs.join(best.toDF("a", "va"), "a", "left").join(best.toDF("b", "vb"), "b", "left")
    return full.withColumn("sim", F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0))).drop("va", "vb")


def temporal_merges(faces: DataFrame, similarity: float = SIMILARITY, least: float = OVERLAP, relief: float = 0.9) -> DataFrame:
    """Merges of clusters that overlap in time and whose best faces are similar (by a threshold relieved a little)."""
    pairs = stored(time_overlap(faces, least), "overlap")
    return merges_of(faces, cluster_similarity(faces, pairs).filter(F.col("sim") >= similarity * relief))


def apply_merges(faces: DataFrame, merges: DataFrame) -> DataFrame:
    moved = faces.join(merges.toDF("cluster", "_dst"), "cluster", "left")
    return moved.withColumn("cluster", F.coalesce("_dst", "cluster")).drop("_dst").select(*faces.columns)


def renumber(faces: DataFrame) -> DataFrame:
    """Clusters named person_000, person_001 ... in the order of their names; other names stay."""
    names = faces.filter(F.col("cluster").startswith("person_")).select("cluster").distinct()
    numbered = ordinal(names, [F.col("cluster")], "_n").select("cluster", F.format_string("person_%03d", "_n").alias("_new"))
    return faces.join(numbered, "cluster", "left").withColumn("cluster", F.coalesce("_new", "cluster")).drop("_new").select(*faces.columns)


def assign_unknown(unknown: DataFrame, reps: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """face_id, cluster, sim of the unknown faces whose most similar representative reaches the threshold (above 0).

    Of equal similarities the first cluster by name."""
    # Thresholds of 0 and less still ask for more than 0.
    links = vector_links(unknown, max(threshold, 1e-300), "cosine", "face_id", "embedding", other=reps, other_id="face_id")
    named = links.join(reps.select(F.col("face_id").alias("dst"), "cluster"), "dst").groupBy("src", "cluster").agg(F.max("value").alias("sim"))
    best = named.groupBy("src").agg(F.min_by(F.struct("cluster", "sim"), F.struct(-F.col("sim"), F.col("cluster"))).alias("best"))
    return best.select(F.col("src").alias("face_id"), F.col("best.cluster").alias("cluster"), F.col("best.sim").alias("sim"))


def destination_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster")


def move_rate(unknown: DataFrame, assigned: DataFrame) -> DataFrame:
    """total, moved, percent; 0 percent of nothing."""
    full = unknown.agg(F.count("*").alias("total")).join(assigned.agg(F.count("*").alias("moved")))
    return full.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("moved") / F.col("total")).otherwise(0.0))


def _consensus(faces: DataFrame, n: int = REPRESENTATIVES, similarity: float = SIMILARITY, consensus: float = CONSENSUS) -> tuple[DataFrame, DataFrame]:
    return faces, consensus_merges(faces, n, similarity, consensus)


def _temporal(faces: DataFrame, similarity: float = SIMILARITY, least: float = OVERLAP) -> tuple[DataFrame, DataFrame]:
    return faces, temporal_merges(faces, similarity, least)


def _single(faces: DataFrame, similarity: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """One representative of each cluster, similar or not."""
    return faces, consensus_merges(faces, 1, similarity, 1.0)


STRATEGIES: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"multiple_representatives": _consensus, "temporal_context": _temporal, "single_representative": _single}


def regroup(faces: DataFrame, method: str = "multiple_representatives", assign_threshold: float | None = None, **options) -> tuple[DataFrame, dict[str, float]]:
    """Faces with reconciled clusters, and the run's figures.

    Known clusters merge and are numbered anew; faces of unknown clusters then go to the reconciled cluster that is most
    similar, even if there is only one. A face without a cluster (null) is unknown. Unknown methods are a ValueError."""
    if method not in STRATEGIES:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(STRATEGIES)}")
    began = time.time()
    faces = faces.withColumn("cluster", F.coalesce("cluster", F.lit("unknown"))).select(*faces.columns)
    known, unknown = faces.filter(~F.col("cluster").startswith("unknown")), faces.filter(F.col("cluster").startswith("unknown"))
    known = stored(known, "known")
    _, merges = STRATEGIES[method](known, **options)
    merges = stored(merges, "merges")
    out = stored(renumber(apply_merges(known, merges)), "regrouped")
    assigned = stored(assign_unknown(unknown, top_reps(out, options.get("n", REPRESENTATIVES)), SIMILARITY if assign_threshold is None else assign_threshold), "assigned")
    moved = unknown.join(assigned.select("face_id", F.col("cluster").alias("_to")), "face_id", "left").withColumn("cluster", F.coalesce("_to", "cluster")).select(*faces.columns)
    reps = top_reps(known, 1 if method == "single_representative" else options.get("n", REPRESENTATIVES)).groupBy("cluster").agg(F.count("*").alias("n"), F.count("embedding").alias("ok"))
    # Pairs of representatives of two clusters, and those of them that lack a vector, from counts alone.
    n, n2, ok, ok2 = reps.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum("ok"), F.sum(F.col("ok") * F.col("ok"))).first()
    compared, sound = (((a or 0) ** 2 - (b or 0)) // 2 for a, b in ((n, n2), (ok, ok2)))
    stats = {"clusters": known.select("cluster").distinct().count(), "total_comparisons": compared, "failed_comparisons": compared - sound, "successful_merges": merges.count(), "assigned": assigned.count(), "processing_time": time.time() - began}
    log.info("regroup by %s: %s", method, stats)
    return out.unionByName(moved), stats
