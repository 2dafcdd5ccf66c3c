"""Centroid clustering (Lloyd's rounds) with Ptolemaic lower bounds.

For a vector x, a centroid c and two pivots p and q, Ptolemy's inequality says

    |x - c| * |p - q|  >=  | |x - p| * |c - q|  -  |x - q| * |c - p| |

A vector's distances from the pivots are computed once and kept beside it; those of the centroids are computed anew
each round. The largest bound over all pairs of pivots tells which centroids cannot be a vector's nearest; only
those that are left are measured. The bounds are computed in floating point and made smaller by more than the
rounding can amount to, so a nearest centroid, or one of several, is never ruled out. What is measured is measured in
whole numbers: the result is that of comparing every vector with every centroid.

Components are made whole, ``floor(scale * x)``. A vector goes to the nearest centroid, the smaller number among equals; then
every centroid with vectors becomes the floor of their mean. Sums are made within tasks before they are
shuffled, at most one row per centroid and task, so it does not matter how many vectors are in one cluster. The driver
holds the centroids alone.

Vectors of another length, and those with a null, NaN or infinite component, are left out. Repeated rows and ids are vectors of
their own. A row without id takes part with an empty id in the draw of first centroids; equal draws go by
the vectors. With fewer vectors than centroids each is a first centroid. An empty table gives no rows. Distances must
fit into a long: components beyond ``MOST`` (x beyond two thousand million over the scale) raise an error, as Spark's own sums do.
Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapfolio.sources.scratch import written

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
PIVOTS = 6
#: Largest component: the square of a distance in 64 dimensions is below 2 ** 62.
MOST = 1 << 27
#: Vectors whose distances are bounded at once, and pairs that are measured at once.
VECTORS, MEASURED = 4096, 1 << 15


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return rows.filter((F.size("x") == dimensions) & sound)


def components(x: np.ndarray, scale: int) -> np.ndarray:
    """Whole components of vectors given as rows."""
    scaled = np.floor(x * scale)
    if scaled.size and np.abs(scaled).max() > MOST:
        raise OverflowError(f"a component is beyond {MOST}: distances would not fit into a long")
    return scaled.astype(np.int64)


def first_rank(seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return F.sha2(text.cast("binary"), 256)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` from every row of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different ones, each far from those before it."""
    chosen = [0]
    least = squares(vectors, vectors[:1])[:, 0]
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squares(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


class Nearest:
    """Finds nearest centroids of vectors whose squared distances from the pivots are known."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.far = np.sqrt(squares(pivots, centroids).astype(np.float64))
        between = np.sqrt(squares(pivots, pivots).astype(np.float64))
        self.pairs = [(p, q, between[p, q]) for p, q in combinations(range(len(pivots)), 2)]

    def bounds(self, pivot_squares: np.ndarray) -> np.ndarray:
        """Numbers that no squared distance is below."""
        near = np.sqrt(pivot_squares.astype(np.float64))
        best = np.zeros((len(near), len(self.centroids)))
        for p, q, apart in self.pairs:
            gap = np.outer(near[:, p], self.far[q] / apart)
            gap -= np.outer(near[:, q], self.far[p] / apart)
            np.maximum(best, np.abs(gap, out=gap), out=best)
        # Each product is off by a few units in its 53rd bit at most.
        if self.pairs:
            largest = near.max(axis=1) * self.far.max() / min(apart for *_, apart in self.pairs)
            best -= (largest * 2.0**-46)[:, None]
        np.maximum(best, 0, out=best)
        return best * best * (1 - 2.0**-46)

    def _measured(self, x: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.int64)
        for a in range(0, len(rows), MEASURED):
            gap = x[rows[a : a + MEASURED]] - self.centroids[numbers[a : a + MEASURED]]
            out[a : a + MEASURED] = np.einsum("ij,ij->i", gap, gap)
        return out

    def __call__(self, x: np.ndarray, pivot_squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of the nearest centroid, the squared distance, and how many distances were measured."""
        number, distance = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
        measured = 0
        for a in range(0, len(x), VECTORS):
            part, known = x[a : a + VECTORS], pivot_squares[a : a + VECTORS]
            lower = self.bounds(known)
            rows = np.arange(len(part))
            guess = lower.argmin(axis=1)
            reach = self._measured(part, rows, guess)
            lower[rows, guess] = np.inf
            left, others = np.nonzero(lower <= (reach.astype(np.float64) * (1 + 2.0**-46))[:, None])
            exact = np.full(lower.shape, np.iinfo(np.int64).max)
            exact[rows, guess] = reach
            exact[left, others] = self._measured(part, left, others)
            # The first of equal ones.
            number[a : a + VECTORS] = exact.argmin(axis=1)
            distance[a : a + VECTORS] = exact.min(axis=1)
            measured += len(part) + len(left)
        return number, distance, measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), pa.int32()),
        pa.array(values.reshape(-1), kind),
    )


def with_pivots(rows: DataFrame, pivots: np.ndarray, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, v`` (whole components) and ``p``, the squared distances from the pivots."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = components(_matrix(batch.column("x"), dimensions), scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(v, pa.int32()), _lists(squares(v, pivots), pa.int64())],
                names=["vec_id", "v", "p"],
            )

    return rows.mapInArrow(prepared, "vec_id BIGINT, v ARRAY<INT>, p ARRAY<BIGINT>")


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    dimensions = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, pivots)
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions).astype(np.int64)
            number, _, _ = nearest(v, _matrix(batch.column("p"), len(pivots)))
            order = np.argsort(number, kind="stable")
            present, at = np.unique(number[order], return_index=True)
            if len(present):
                total[present] += np.add.reduceat(v[order], at, axis=0)
                count += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), _lists(total[some], pa.int64())],
            names=["cluster", "n", "s"],
        )

    parts = table.select("v", "p").mapInArrow(sums, "cluster INT, n BIGINT, s ARRAY<BIGINT>")
    places = parts.select("cluster", "n", F.posexplode("s").alias("place", "s"))
    found = places.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["place"]] = r["s"] // r["n"]
    return out


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, pivots)
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions).astype(np.int64)
            number, distance, _ = nearest(v, _matrix(batch.column("p"), len(pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return table.mapInArrow(assign, "vec_id BIGINT, cluster INT, distance BIGINT")


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
    n_pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """``vec_id, cluster, distance`` of every vector, and ``cluster, centroid`` for at most ``k`` clusters.

    The first centroids are the ``k`` vectors with the least SHA-256 of seed and id. The pivots are some of them, far apart.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, dimensions)
    drawn = rows.withColumn("rank", first_rank(seed)).orderBy("rank", "x").limit(k).collect()
    centroids = components(np.array([r["x"] for r in drawn], dtype=np.float64).reshape(-1, dimensions), scale)
    pivots = spread(centroids, n_pivots) if len(centroids) else centroids
    # The vectors and their distances from the pivots are read in every round.
    table = written(with_pivots(rows, pivots, dimensions, scale), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(table, centroids, pivots)
    final = spark.createDataFrame(
        [(c, row) for c, row in enumerate(centroids.tolist())], "cluster INT, centroid ARRAY<BIGINT>"
    )
    return written(_assigned(table, centroids, pivots), "assigned"), final


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """The vectors' clusters and distances with ``cluster_inertia, inertia`` and ``centroid_sha256``."""
    assigned, final = clusters(vectors, **options)
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    of = {r["cluster"]: r["s"] for r in sums}
    about = [(r["cluster"], of.get(r["cluster"], 0), sum(of.values()), digest(r["centroid"])) for r in final.collect()]
    facts = vectors.sparkSession.createDataFrame(
        about, "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING"
    )
    # A row per centroid.
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
