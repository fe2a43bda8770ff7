"""Centroid clustering with Ptolemaic lower bounds.

For two pivots p, s Ptolemy's inequality gives
``d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s)``. The pivots are fixed, so
the distances of every vector to them are computed once and kept beside it. In
each round the largest bound over the pivot pairs, rounded down by more than
the arithmetic's error, rules centroids out; the centroid with the smallest
bound is measured first, and only those whose bound does not exceed the best
exact distance so far are measured, in integers.

A round reduces every task to counts and sums per centroid; only the sums per
centroid and dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table, written
from wardflow.llm.vectors import integer_vectors, matrix, total

#: the bounds are lowered by this part, far beyond the error of a few double operations
MARGIN = 1e-9
PIVOTS = 5
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


@dataclass
class Pivots:
    """Fixed pivots (one per row) and the pairs of them that lie apart, with their distance."""

    at: np.ndarray
    pairs: list[tuple[int, int, float]]


def choose_pivots(start: np.ndarray, most: int = PIVOTS) -> Pivots:
    """The first distinct vectors of ``start``, and all their pairs."""
    seen: dict[bytes, np.ndarray] = {}
    for v in start:
        seen.setdefault(v.tobytes(), v)
    at = np.array(list(seen.values())[:most], np.int64).reshape(-1, start.shape[1])
    far = distances(at, at)
    return Pivots(at, [(i, j, float(far[i, j])) for i in range(len(at)) for j in range(i)])


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and of ``to`` (the squares are exact integers)."""
    return np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in to], axis=1).astype(np.float64)) if len(to) else np.zeros((len(x), 0))


def lower_bounds(to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Squared distances that no vector (rows) is nearer to a centroid (columns) than."""
    low = np.zeros((len(to_pivots), len(centroids)))
    c = distances(centroids, pivots.at)
    for i, j, apart in pivots.pairs:
        crossed = np.outer(to_pivots[:, i], c[:, j]) - np.outer(to_pivots[:, j], c[:, i])
        # the error of a difference follows its terms, not its size
        slack = MARGIN * (np.outer(to_pivots[:, i], c[:, j]) + np.outer(to_pivots[:, j], c[:, i]))
        np.maximum(low, (np.abs(crossed) - slack) / apart, out=low)
    return np.floor(low * low * (1 - MARGIN))


def assign(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many distances were measured."""
    low = lower_bounds(to_pivots, centroids, pivots)
    label = low.argmin(axis=1)
    best = ((x - centroids[label]) ** 2).sum(axis=1)
    first, measured = label.copy(), len(x)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero((low[:, c] <= best) & (first != c))
        measured += len(rows)
        d = ((x[rows] - centroid) ** 2).sum(axis=1)
        nearer = (d < best[rows]) | ((d == best[rows]) & (c < label[rows]))
        label[rows[nearer]], best[rows[nearer]] = c, d[nearer]
    return label, best, measured


def with_pivot_distances(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds ``p``, the distances of ``rows(vec_id, x)`` to the pivots."""
    width = pivots.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = pa.array(list(distances(matrix(b.column(1), width), pivots.at)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), p], names=["vec_id", "x", "p"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id bigint, x array<bigint>, p array<double>")


def cluster_sums(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """One row per centroid: sums per dimension of its vectors, their number, their summed squared distance."""
    k, width = centroids.shape

    def sums(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), width)
        label, d, _ = assign(x, matrix(b.column(1), len(pivots.at)), centroids, pivots)
        out = np.zeros((k, width + 2), np.int64)
        np.add.at(out, label, np.column_stack([x, np.ones(len(x), np.int64), d]))
        return out.ravel()

    return total(rows.select("x", "p"), k * (width + 2), sums).reshape(k, width + 2)


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64,
            scale: int = 1024, seed: str = "3", pivots: int = PIVOTS) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of ``width`` components.

    Components become floor(scale * component). Centroids start as the vectors
    with the k smallest sha256 of ``seed:vec_id`` (equal ids: smaller vector
    first; rows without an id last); a round replaces each by the floor of its
    vectors' mean. Vectors that are null, of another length, or hold null or
    non-finite components are dropped. Repeated rows are rows like others; fewer
    vectors than k give as many centroids; an empty table gives no rows. Other
    columns are ignored.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, vec_id, vector, scale).filter(F.size("x") == width)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.select("x", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r["x"] for r in start], np.int64)
    fixed = choose_pivots(centroids, pivots)
    kept = written(with_pivot_distances(rows, fixed))
    for _ in range(rounds):
        sums = cluster_sums(kept, centroids, fixed)
        filled = sums[:, width] > 0
        centroids = centroids.copy()
        centroids[filled] = sums[filled, :width] // sums[filled, width: width + 1]
    last = cluster_sums(kept, centroids, fixed)[:, width + 1]
    final = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label, d, _ = assign(matrix(b.column(1), width), matrix(b.column(2), len(fixed.at)), final, fixed)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.int32()), pa.array(d, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(i, int(v), digest[i]) for i, v in enumerate(last)], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    placed = kept.mapInArrow(run, "vec_id bigint, cluster int, distance bigint").join(F.broadcast(about), "cluster")
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(int(last.sum())).cast("long").alias("inertia"), "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _rounds_sql(rounds: int, k: int, width: int) -> str:
    """DuckDB SQL of the rounds, one pair of tables each."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {width}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x
  FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, min(s).d AS distance, min(s).cluster AS cluster
  FROM (SELECT v.r, v.vec_id, v.x, {{'d': CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT),
               'cluster': c.cluster}} AS s FROM v CROSS JOIN c{i} c)
  GROUP BY r, vec_id, x
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
      SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


OP13_SQL = _rounds_sql(10, 8, 64)
