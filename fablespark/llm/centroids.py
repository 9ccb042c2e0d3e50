"""K-means on integer vectors: single-precision screening with proven error intervals, exact decisions.

Components become integers floor(SCALE * x). The nearest centroid of x has the least
h = |c|^2 / 2 - x . c, since the squared distance is |x|^2 + 2 h. A float32 matrix product gives
every x . c at once; whatever the order of its sums, it is off by at most
gamma * |x| * |c| with gamma = (d + 2) u / (1 - (d + 2) u) and u = 2^-24 (two roundings for the
conversions, d for products and sums). That makes an interval for every h. Centroids whose
interval reaches below the lowest upper end are the shortlist; where it holds more than one, their
distances are computed again in 64-bit integers, and of equal ones the lowest number wins. So the
result is that of exact arithmetic, on any hardware and for any split into tasks.

Each round is one pass over the staged integers. A task hands on one row a cluster (count and sums),
the driver gets one row a cluster in all. No vector is shuffled, so no key can be hot.

Edge cases: a vector that is null, has another number of components, or holds null or non-finite
ones is dropped; one with a component of MOST or more in size after scaling stays without a cluster
(its distances need not fit a long) and moves no centroid; a null vec_id is kept but starts no
centroid; repeated rows count as often as they occur, and start a centroid each; vectors that tie
for the start are taken in the order of their components; fewer vectors than centroids give fewer
centroids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, staged

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
#: Scaled components stay below this, so that squared distances of up to 256 components fit 64 bits.
MOST = 1 << 26
BLOCK = 4096
UNIT = 2.0**-24


def whole(embedding: Column) -> Column:
    """Whether every component is present and finite."""
    return F.coalesce(F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def scaled(embedding: Column, scale: int, most: int) -> Column:
    """floor(scale * component) in double precision; null where one is not below `most` in size."""
    fits = F.forall(embedding, lambda v: F.abs(v.cast("double") * scale) < most)
    return F.when(fits, F.transform(embedding, lambda v: F.floor(v.cast("double") * scale).cast("int")))


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of integers, and their positions in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return column.drop_null().flatten().to_numpy().astype(np.int64).reshape(-1, dims), at


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each x (rows) the centroids that may be nearest, by float32 products and their error intervals."""
    dims = x.shape[1]
    gamma = (dims + 2) * UNIT / (1 - (dims + 2) * UNIT)
    product = (x.astype(np.float32) @ centroids.T.astype(np.float32)).astype(np.float64)
    half = (centroids.astype(np.float64) ** 2).sum(axis=1) / 2
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(2 * half)[None, :]
    # The second term covers the double-precision roundings of norms, products and this very line.
    radius = gamma * size * (1 + 2.0**-30) + (half[None, :] + np.abs(product) + size) * dims * 2.0**-50
    h = half[None, :] - product
    return h - radius <= (h + radius).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each x, the lowest number among equals."""
    out = np.zeros(len(x), np.int64)
    for low in range(0, len(x), BLOCK):
        some = x[low : low + BLOCK]
        listed = shortlist(some, centroids)
        best = listed.argmax(axis=1)
        open_ = np.flatnonzero(listed.sum(axis=1) > 1)
        if len(open_):
            row, c = np.nonzero(listed[open_])
            exact = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
            exact[row, c] = ((some[open_[row]] - centroids[c]) ** 2).sum(axis=1)
            best[open_] = exact.argmin(axis=1)
        out[low : low + BLOCK] = best
    return out


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cluster that has vectors in this task."""
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x, _ = matrix(batch.column(0), dims)
            at = nearest(x, centroids)
            count += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dims, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch.column(1), centroids.shape[1])
            own = nearest(x, centroids)
            cluster, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            cluster[at], distance[at] = own, ((x - centroids[own]) ** 2).sum(axis=1)
            none = np.ones(len(batch), bool)
            none[at] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, mask=none), pa.array(distance, mask=none)], ["vec_id", "cluster", "distance"])

    return run


def moved(sums: DataFrame, before: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their vectors: sums(cluster, n, sums) of all tasks; unused ones stay."""
    after = before.copy()
    each = sums.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    totals = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for cluster, pos, n, s in totals.collect():  # as many rows as numbers in `before`
        after[cluster, pos] = int(s) // n
    return after


def digest(values: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, values.ravel().tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `dims` whole components."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    kept = staged(vectors.select(F.col("vec_id").cast("long"), "embedding").where((F.size(x) == dims) & whole(x)).select("vec_id", scaled(x, scale, MOST).alias("x")), "kmeans")
    first = kept.where("vec_id is not null and x is not null").orderBy(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if not first:
        assigned = kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    else:
        for _ in range(rounds):
            centroids = moved(kept.select("x").transform(in_arrow, _sums(centroids), "cluster long, n long, sums array<long>"), centroids)
        assigned = staged(kept.transform(in_arrow, _assigned(centroids), "vec_id long, cluster int, distance long"), "kmeans-assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(c, inertia[c], sum(inertia.values()), digest(centroids[c])) for c in sorted(inertia)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
