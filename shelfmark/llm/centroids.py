"""Clusters of integer vectors by Lloyd's rounds whose every step is a column expression of the JVM."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import saved

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Components are whole numbers of at most 2^27 in size; squares of their differences then sum up within 64 bits.
_LARGEST = 2**27

_DISTANCE = "aggregate(zip_with(x, array({}), (a, b) -> (a - b) * (a - b)), 0L, (sum, d) -> sum + d)"


def integer_vectors(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id and x, ``floor(scale * component)`` of each vector of the right length whose components are all finite numbers.

    A component that would be above 2^27 in size fails the job: distances would not fit 64 bits.
    """
    values = F.col(embedding).cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size(values) == components) & finite)

    def whole(v: Column) -> Column:
        scaled = F.floor(v * F.lit(float(scale)))
        too_large = F.raise_error(F.lit(f"a component is above {_LARGEST // scale} in size")).cast("long")
        return F.when(F.abs(v) <= _LARGEST / scale, scaled).otherwise(too_large)

    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(values, whole).alias("x"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``<seed>:<vec_id>``; repeated numbers are ordered by their components.

    Vectors without a number come last. Fewer vectors than clusters give fewer centroids.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = points.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(clusters)
    return [list(row["x"]) for row in chosen.collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the centroid nearest to ``x``, the smaller number of equally near ones."""
    found = [
        F.struct(F.expr(_DISTANCE.format(",".join(f"{c}L" for c in centroid))).alias("distance"), F.lit(i).alias("cluster"))
        for i, centroid in enumerate(centroids)
    ]
    return F.array_min(F.array(*found))


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: exact floors of the mean of each one's vectors; one without vectors stays.

    Column sums are taken per task first; one row per centroid reaches the driver.
    """
    width = len(centroids[0])
    assigned = points.select(nearest(centroids)["cluster"].alias("cluster"), "x")
    # The columns are spread out above the assignment, so that it is computed once per vector.
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)))
    after = list(centroids)
    for row in sums.collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def fitted(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after so many rounds over all rows of ``points`` (vec_id, x), which should be a written table."""
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(points, centroids)
    return centroids


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that can be clustered.

    Null vectors, those of another length and those with a component that is null or not
    finite are left out. Repeated rows are clustered each; a null vec_id is kept. Equally near
    centroids give the smaller number. A table without usable vectors gives no rows.
    """
    points = saved(integer_vectors(vectors, components, scale), "points")
    centroids = fitted(points, clusters, rounds, seed)
    if not centroids:
        return points.select(
            "vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
            F.lit("").alias("centroid_sha256"),
        )
    assigned = saved(points.select("vec_id", nearest(centroids).alias("best")).select("vec_id", "best.cluster", "best.distance"), "assigned")
    inertia = {row["cluster"]: row["sum"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = [F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(F.array(*by_cluster), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
