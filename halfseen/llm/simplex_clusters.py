"""Exact k-means on integer vectors: n-simplex projection onto pivots rules centroids out before any exact comparison."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import handover, query, table
from halfseen.llm.vectors import collected, finite, integers, matrix, summed

SLACK = 1e-7       # bounds are widened by this share of the squared lengths; their rounding stays far below
FLAT = 1e-3        # a pivot this close to the simplex before it (as a share of its distance) is left out


class Simplex:
    """Pivots as vertices of a simplex. Distances of a vector to them become the coordinates of an apex over it."""

    def __init__(self, pivots: np.ndarray):
        """Vertices one by one, each an apex over those before; pivots that add no dimension are left out."""
        self.pivots, self.base = pivots[:1], np.zeros((0, 0))
        for p in pivots[1:]:
            apex = self.apexes(p[None])[0]
            if apex[-1] > FLAT * np.sqrt(max(float(((p - pivots[0]) ** 2).sum()), 1.0)):
                base = np.zeros((len(apex), len(apex)))
                base[:-1, :-1], base[-1] = self.base, apex
                self.pivots, self.base = np.vstack([self.pivots, p]), base

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Rows: coordinates in the space of the base, and the altitude over it; by squared distances to the pivots alone."""
        square = np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(float)
        right = (square[:, :1] - square[:, 1:] + (self.base ** 2).sum(axis=1)) / 2
        flat = np.linalg.solve(self.base, right.T).T if len(self.base) else right
        return np.hstack([flat, np.sqrt(np.maximum(square[:, :1] - (flat ** 2).sum(axis=1, keepdims=True), 0))])


def bounds(apex: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of all distances: apexes on the same side of the base, and on opposite sides."""
    length = (apex ** 2).sum(axis=1)[:, None] + (other ** 2).sum(axis=1)[None]
    low = length - 2 * apex @ other.T
    return low - SLACK * (length + 1), low + 4 * apex[:, -1:] * other[None, :, -1] + SLACK * (length + 1)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared exactly) of each row; equal distances: the smaller number.

    Centroids whose lower bound exceeds the least upper bound are out. The one of the least
    lower bound is compared first; its distance rules out more of the others.
    """
    low, high = bounds(apex, other)
    open_ = low <= high.min(axis=1, keepdims=True)
    label = low.argmin(axis=1)
    best = ((x - centroids[label]) ** 2).sum(axis=1)
    compared = np.ones(len(x), np.int32)
    open_[np.arange(len(x)), label] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c] & (low[:, c] <= best))
        far = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        better = (far < best[rows]) | ((far == best[rows]) & (c < label[rows]))
        compared[rows] += 1
        best[rows[better]], label[rows[better]] = far[better], c
    return label, best, compared


def simplex_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16,
                     rounds: int = 3, seed: int = 1, pivots: int = 16) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared.

    Vectors of `dims` finite entries become floor(scale * entry). Centroids start as the k
    vectors with the smallest SHA-256 of seed:id and move `rounds` times to the exact floor of
    the mean. The first `pivots` starts are the pivots; every vector's apex over them is
    computed once and handed over with the integers in the shared folder, so a round reads
    both, filters centroids by the bounds and compares the rest exactly (`compared` of them in
    the last assignment). A task gives k * dims exact sums per round; the driver gets as many.

    Left out: null vectors, other lengths, null or non-finite entries (or of a million and
    more). Null ids are assigned as any and start only where ids are too few; repeated ids
    start by their vectors' order, so repeated rows may start several equal centroids, of
    which only the first is ever chosen. With fewer than k vectors there are fewer
    centroids. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} {dict(vectors.dtypes)[id_col]}, cluster int, distance long, compared int"
    kept = vectors.where(F.size(vector_col) == dims).where(finite(vector_col)).select(
        F.col(id_col).alias("id"), integers(vector_col, scale).alias("x"))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("x")]
    centroids = np.array([r["x"] for r in kept.orderBy(*order).limit(k).collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], schema).withColumns(
            {"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    simplex = Simplex(centroids[:pivots])
    width = len(simplex.pivots)

    def project(batches):
        for batch in batches:
            apex = simplex.apexes(matrix(batch.column("x"), dims))
            ends = pa.array(np.arange(0, apex.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x").cast(pa.list_(pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(apex.ravel()))], ["id", "x", "apex"])

    base = handover(kept.mapInArrow(project, f"id {dict(vectors.dtypes)[id_col]}, x array<int>, apex array<double>"))

    def assign(batch: pa.RecordBatch, centroids: np.ndarray, other: np.ndarray):
        x = matrix(batch.column("x"), dims).astype(np.int64)
        return x, nearest(x, matrix(batch.column("apex"), width), centroids, other)

    for _ in range(rounds):
        def sums(batch, centroids=centroids, other=simplex.apexes(centroids)):
            x, (label, _, _) = assign(batch, centroids, other)
            out = np.zeros((len(centroids), dims + 1), np.int64)
            for c in np.unique(label):
                out[c, :dims], out[c, dims] = x[label == c].sum(axis=0), (label == c).sum()
            return out.ravel()
        total = collected(summed(base.select("x", "apex"), sums, "long"), len(centroids) * (dims + 1), int).reshape(len(centroids), dims + 1)
        centroids = np.array([[int(v) // int(t[dims]) for v in t[:dims]] if t[dims] else c for t, c in zip(total, centroids.tolist())], np.int64)

    other = simplex.apexes(centroids)

    def final(batches):
        for batch in batches:
            _, (label, best, compared) = assign(batch, centroids, other)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label.astype(np.int32)), pa.array(best), pa.array(compared)],
                                             [id_col, "cluster", "distance", "compared"])

    found = handover(base.mapInArrow(final, schema))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()],
                                       "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")   # k rows at most
    return found.join(F.broadcast(of_cluster), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def oracle(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out; `compared` follows from the method alone and is not stated."""
    near = "arg_min(k, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := k))"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.x) AS x, {near} AS k FROM v, c{r} c GROUP BY v.vec_id),
m{r} AS (SELECT k, i, CAST(floor(CAST(sum(e) AS DOUBLE) / count(*)) AS BIGINT) AS e
  FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(any_value(n.x), any_value(c.x)) AS x FROM c{r} c LEFT JOIN (SELECT k, list(e ORDER BY i) AS x FROM m{r} GROUP BY k) n USING (k) GROUP BY c.k)""")
    return f"""WITH {", ".join(steps)},
f AS MATERIALIZED (SELECT v.vec_id, {near} AS k FROM v, c{rounds} c GROUP BY v.vec_id),
g AS (SELECT f.vec_id, f.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
  sha256(array_to_string(c.x, ',')) AS h FROM f JOIN v USING (vec_id) JOIN c{rounds} c USING (k))
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM g"""


@query("op13_simplex_clusters", oracle())
def op13_simplex_clusters(spark, d):
    return simplex_clusters(table(spark, d, "embeddings")).drop("compared")
