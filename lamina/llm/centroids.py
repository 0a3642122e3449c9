"""Centroid clustering in integers: array expressions find the nearest centroid, sums of columns move the centroids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import stored

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, "2"


def scaled(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the embedding's components as integers floor(scale * x), of the rows that have them all, none null or not finite."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # a row without a vector is no vector, however and and or are ordered
    rows = rows.where(F.coalesce((F.size(x) == components) & whole, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """distance (squared) and cluster of the nearest centroid; of equal ones, that of the smaller number."""

    def product(v: Column, w: Column) -> Column:
        return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)

    # |v - c|^2 = |v|^2 + |c|^2 - 2 v c, the least work for each component; the table is one literal of the plan once constants are folded
    table = F.from_json(F.lit(json.dumps([{"norm": sum(x * x for x in c), "c": c} for c in centroids])), "array<struct<norm: bigint, c: array<bigint>>>")
    best = F.array_min(F.transform(table, lambda centre, number: F.struct((centre["norm"] - 2 * product(v, centre["c"])).alias("distance"), number.alias("cluster"))))
    return F.struct((best["distance"] + product(v, v)).alias("distance"), best["cluster"].alias("cluster"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`, in the order of these hashes; ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()]


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor(sum / count) of each cluster's vectors (v, cluster); a cluster without vectors keeps its centroid.

    Each task adds up its own vectors by cluster, one sum for each component; a row for each cluster reaches the driver.
    """
    size = len(centroids[0])
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.try_sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)])
    rows = sums.collect()
    if any(r[f"s{i}"] is None for r in rows for i in range(size)):
        raise ValueError("a sum of components passes 64 bits")
    found = {r.cluster: [r[f"s{i}"] // r.n for i in range(size)] for r in rows}
    return [found.get(i, c) for i, c in enumerate(centroids)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """One row per row of vectors (vec_id, v: as scaled makes them): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The vectors are stored as integers once and read in each round; only sums are shuffled: a row for each task and
    cluster. The driver holds the centroids alone, clusters x components integers, which are literals of the
    next round's plan.

    Defined cases: rows with null, short, long or unfinished embeddings are left out by scaled; rows that repeat a vec_id are vectors
    each; vectors without vec_id take part and come last among the first centroids; of equally near centroids the smaller number counts;
    fewer vectors than clusters make fewer clusters; an empty table gives an empty result; a sum beyond 64 bits is an error, as is a
    distance in ANSI mode, Spark's default; other columns are ignored.
    """
    vectors = vectors.select("vec_id", "v")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    if vectors.rdd.getNumPartitions() < cores:  # distances are slow work for few bytes: a small table is dealt out over all cores
        vectors = vectors.repartition(cores)
    vectors = stored(vectors, "vectors")
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")), centroids)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    near = nearest(F.col("v"), centroids)
    final = stored(vectors.select("vec_id", near.alias("near")).select("vec_id", "near.*"), "clusters")
    sums = {r.cluster: int(r.total) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    most = 2**63
    if sum(sums.values()) >= most:
        raise ValueError("the sum of distances passes 64 bits")
    hashes = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids])
    inertia = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))])
    return final.select(
        "vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), hashes[F.col("cluster")].alias("centroid_sha256")
    )
