"""Centroid clustering of integer vectors by column expressions of Spark only.

The distance to a centroid is ``aggregate(zip_with(vector, literal array))``, the nearest one is the ``array_min`` of (distance, number) structs, and a
round's update is one aggregation of plain column sums. Centroids are literals of the plan: k rows of ``width`` numbers, the only thing that passes the driver.
All arithmetic is in 64-bit integers, so results don't depend on partitions or order; an overflow raises Spark's ARITHMETIC_OVERFLOW.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import fresh_path

Centroids = list[list[int]]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(id, v) of the rows whose vector has exactly ``width`` components, none of them null, NaN or infinite; each x becomes floor(scale * x)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The k vectors with the least SHA-256 of ``seed:id``, in that order; equal hashes (repeated or null ids, null last) by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in vectors.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def literal_array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in values)})")


def nearest(vector: Column, centroids: Centroids) -> Column:
    """Struct (distance, cluster) of the nearest centroid by squared Euclidean distance; of equal ones that with the smaller number."""
    def distance(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(vector, literal_array(c), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda total, d: total + d)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids))))


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round: floor(sum / count) of their vectors, component by component; without vectors they stay."""
    width = len(centroids[0])
    assigned = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *(F.expr(f"sum(v[{i}])").alias(f"x{i}") for i in range(width)))
    out = list(centroids)
    for r in sums.collect():
        out[r.cluster] = [r[f"x{i}"] // r.n for i in range(width)]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Rows with a null, shorter or longer vector, or with a null, NaN or infinite component, have no row. Fewer than k kept vectors make fewer clusters, none give an
    empty table. Repeated rows are vectors of their own; null ids are kept. Rounds stop early where no centroid moves, as further ones would change nothing.
    """
    spark = vectors.sparkSession
    path = fresh_path(spark, "vectors")
    integer_vectors(vectors, id_col, vector_col, width, scale).write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        empty = kept.select(F.col("id").alias(id_col)).where(F.lit(False))
        return empty.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        before, centroids = centroids, moved(kept, centroids)
        if before == centroids:
            break
    placed = kept.select("id", nearest(F.col("v"), centroids).alias("near")).select("id", "near.cluster", "near.distance")
    inertia = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    told = [(inertia.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    by_number = lambda values: F.get(F.array(*values), F.col("cluster"))
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", by_number([F.lit(i).cast("long") for i, _ in told]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_number([F.lit(h) for _, h in told]).alias("centroid_sha256"))
