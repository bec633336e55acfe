"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so a vector's squared distance to a centroid is a
sum of squared differences of single integers. Each round every batch of
vectors tabulates the squared difference for each dimension, each integer that
occurs there and each centroid; distances are then table look-ups and sums, no
arithmetic on whole vectors. Vectors stay where they are: a task sends one sum
and one count for each centroid and dimension, so a round shuffles the same few
numbers at every size of the table, and sums of integers do not depend on order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

LARGEST = 1 << 27        # largest integer component: a distance over 64 dimensions then fits a long
TABLE_CELLS = 1 << 22    # spread of integers up to which a presence table finds the occurring ones
LOOKUPS = 1 << 20        # look-ups at a time


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int, scale: int) -> DataFrame:
    """Rows (vec_id, v array<bigint>) of the sound vectors: floor(scale * component)."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.size("x") == dimensions).where(sound)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v")))


def _occurring(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, value) of every table line, and each component's line."""
    low = v.min(axis=0)
    base = np.concatenate([[0], np.cumsum(v.max(axis=0) - low + 1)])
    if base[-1] <= TABLE_CELLS:
        place = v - low + base[:-1]
        seen = np.zeros(base[-1], bool)
        seen[place] = True
        at = np.flatnonzero(seen)
        lines = (np.cumsum(seen, dtype=np.int64) - 1)[place]
        dimension = np.searchsorted(base, at, side="right") - 1
        return dimension, at - base[dimension] + low[dimension], lines
    values, lines, n = [], np.empty(v.shape, np.int64), 0
    for d in range(v.shape[1]):
        own, code = np.unique(v[:, d], return_inverse=True)
        lines[:, d] = code + n
        values.append(own)
        n += len(own)
    return np.repeat(np.arange(v.shape[1]), [len(x) for x in values]), np.concatenate(values), lines


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids) of integer vectors, by table look-ups."""
    if len(v) and np.abs(v).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling: squared distances would not fit a long")
    if not len(v):
        return np.zeros((0, len(centroids)), np.int64)
    dimension, value, lines = _occurring(v)
    table = (value[:, None] - centroids[:, dimension].T) ** 2
    out = np.empty((len(v), len(centroids)), np.int64)
    step = max(1, LOOKUPS // (v.shape[1] * len(centroids)))
    for low in range(0, len(v), step):
        out[low:low + step] = table[lines[low:low + step]].sum(axis=1)
    return out


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray):
    """Sums and counts of a task's vectors by nearest centroid: (cluster, dimension, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        totals, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width)
            nearest = squared_distances(v, centroids).argmin(axis=1)
            for c in range(k):
                own = v[nearest == c]
                totals[c] += own.sum(axis=0)
                n[c] += len(own)
        c, d = np.divmod(np.arange(k * width), width)
        used = n[c] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[used]), pa.array(d[used]), pa.array(n[c][used]), pa.array(totals.ravel()[used])],
            names=["cluster", "dimension", "n", "total"])
    return run


def _assign(centroids: np.ndarray):
    """(vec_id, cluster, distance) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = squared_distances(_matrix(batch.column(1), centroids.shape[1]), centroids)
            nearest = distances.argmin(axis=1)  # the first of equal ones
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nearest.astype(np.int32)),
                 pa.array(distances[np.arange(len(nearest)), nearest])], names=["vec_id", "cluster", "distance"])
    return run


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash (ties: smallest vector), in order of the hash."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    rows = hashed.where("h is not null").orderBy("h", "v").limit(k).collect()  # k vectors
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = 8,
                    rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every sound vector.

    Sound vectors have ``dimensions`` components, none null, NaN or infinite;
    others (null vectors too) give no row. A component x becomes the integer
    floor(scale * x). The first centroids are the vectors of smallest sha256 of
    ``<seed>:<vec_id>``. Each round assigns every vector to its nearest
    centroid (ties: smaller number) and replaces every centroid that has
    vectors by their componentwise floor(sum / count), exactly; a last
    assignment follows. ``distance`` is squared, ``cluster_inertia`` and
    ``inertia`` are its sums over the cluster and over all rows, ``centroid``
    is the cluster's last centroid.

    Repeated rows count as often as they occur; vectors of one id that differ
    are separate rows, ordered by their components where hashes tie. A null id
    is clustered but never a first centroid; with fewer than ``centroids`` ids
    there are as many centroids as rows with an id, and with none the result
    is empty, as for an empty table. Other columns are ignored. Components
    beyond 2^27 after scaling raise: their distances would not fit a long.
    """
    spark = vectors.sparkSession
    held = stored(integer_vectors(vectors, id_col, vec_col, dimensions, scale), "centroids-vectors")
    kind = dict(held.dtypes)["vec_id"]
    at = _first_centroids(held, centroids, seed)
    if not len(at):
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        sums = held.select("v").mapInArrow(_sums(at), "cluster long, dimension long, n long, total long")
        moved = at.copy()
        # centroids x dimensions numbers
        for r in sums.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r["cluster"], r["dimension"]] = r["total"] // r["n"]
        if np.array_equal(moved, at):
            break  # every further round would give the same
        at = moved
    out = stored(held.select("vec_id", "v").mapInArrow(_assign(at), f"vec_id {kind}, cluster int, distance long"), "centroids-rows")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a number a centroid
    of = lambda values: F.array(*values)[F.col("cluster")]
    longs = lambda values: F.array(*[F.lit(int(x)).cast("long") for x in values])
    return out.select("*", of([F.lit(inertia.get(c, 0)).cast("long") for c in range(len(at))]).alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                      of([longs(c) for c in at]).alias("centroid"))
