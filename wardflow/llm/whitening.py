"""Embedding whitening by a covariance weighted with multiplicities.

Identical integer vectors are grouped first; a group's weight is its number of
rows (or one). The mean and the covariance come from the distinct vectors and
their weights: every task centres its vectors, multiplies the weighted matrix
with itself and adds up; Spark adds up the tasks, and only the matrix of
dimension x dimension numbers reaches the driver, whose eigenvectors are the
components. Each distinct vector is projected once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table, written
from wardflow.llm.vectors import integer_vectors, matrix, total

#: a group with more than this part of all rows is joined from a broadcast, of less than ``1 / HEAVY`` rows
HEAVY = 0.001
LONG_MAX = (1 << 63) - 1


@dataclass
class Whitening:
    """Fit of ``n`` rows: sums per dimension, components (one per column), their eigenvalues and shares of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Rows (x, copies) of ``rows(vec_id, x)``; copies are counted before the shuffle."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))


def common_length(groups: DataFrame) -> int:
    """The length most rows have (ties: the longer one; 0 without rows)."""
    best = (groups.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n"))
            .orderBy(F.col("n").desc(), F.col("d").desc()).first())
    return best["d"] if best else 0


def _centred(b: pa.RecordBatch, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors minus the mean (the difference n * x - S is exact) and their weights."""
    scaled = matrix(b.column(0), len(sums)) * n - sums
    return scaled / n, b.column(1).to_numpy().astype(np.float64)


def fit(groups: DataFrame, width: int, components: int = 8) -> Whitening:
    """Whitening of the vectors ``groups(x, copies)``, weighted by ``copies``, all of length ``width``.

    Directions without variance beyond rounding are left out.
    """
    groups = groups.select("x", "copies")

    def sums_of(b: pa.RecordBatch) -> np.ndarray:
        w = b.column(1).to_numpy()
        return np.concatenate([[w.sum()], w @ matrix(b.column(0), width)])

    got = total(groups, width + 1, sums_of)
    n, sums = int(got[0]), got[1:]

    def products(b: pa.RecordBatch) -> np.ndarray:
        c, w = _centred(b, n, sums)
        return ((c * w[:, None]).T @ c).ravel()

    cov = total(groups, width * width, products, "double").reshape(width, width) / max(n, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    spread = float(np.trace(cov))
    real = values > spread * width * np.finfo(np.float64).eps
    return Whitening(n, sums, vectors[:, real], values[real], values[real] / (spread or 1.0))


def _deviation(scaled: np.ndarray) -> list[int | None]:
    """Sums of squares per row, exact; null where 64 bits do not hold them."""
    if scaled.size and int(np.abs(scaled).max()) ** 2 * scaled.shape[1] > LONG_MAX:
        exact = [sum(int(v) ** 2 for v in row) for row in scaled.tolist()]
        return [v if v <= LONG_MAX else None for v in exact]
    return (scaled * scaled).sum(axis=1).tolist()


def whiten(groups: DataFrame, model: Whitening) -> DataFrame:
    """Rows (x, copies, deviation, whitened): every distinct vector projected on the components, once."""
    n, sums = model.n, model.sums
    weights = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scaled = matrix(b.column(0), len(sums)) * n - sums
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(_deviation(scaled), pa.int64()),
                     pa.array(list((scaled / n) @ weights), pa.list_(pa.float64()))], names=["x", "copies", "deviation", "whitened"])

    return groups.select("x", "copies").mapInArrow(run, "x array<bigint>, copies bigint, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the weighted covariance of ``whitened``, centred first, minus the identity."""
    k, n, z = len(model.eigenvalues), model.n, whitened.select("whitened", "copies")
    if not k:
        return 0.0
    mean = total(z, k, lambda b: b.column(1).to_numpy().astype(np.float64) @ matrix(b.column(0), k), "double") / n

    def products(b: pa.RecordBatch) -> np.ndarray:
        c = matrix(b.column(0), k) - mean
        return ((c * b.column(1).to_numpy().astype(np.float64)[:, None]).T @ c).ravel()

    cov = total(z, k * k, products, "double").reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten_rows(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024,
                add: int = 100_000, weighted: bool = True) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Components become x = floor(scale * component) + add. With ``weighted`` the
    fit counts every row, else every distinct vector once (``n`` and
    ``deviation`` follow). Vectors that are null, or hold null or non-finite
    entries, are dropped, and so are those of another length than most. Repeated
    rows and rows without an id are rows like others. Components without variance
    (more dimensions than distinct vectors, a single vector, an empty table) have
    no rows. ``deviation`` is null where 64 bits do not hold it. Other columns are ignored.
    """
    rows = integer_vectors(df, vec_id, vector, scale, add)
    groups = written(distinct_vectors(rows))
    width = common_length(groups)
    groups = groups.filter(F.size("x") == width)
    if not weighted:
        groups = groups.withColumn("copies", F.lit(1).cast("long"))
    model = fit(groups, width, components)
    unique = whiten(groups, model)
    error = identity_error(unique, model)
    # fewer than 1 / HEAVY groups can hold more than that part of the rows each
    heavy = (F.col("copies") > F.lit(HEAVY) * model.n) if weighted else F.lit(False)
    results = unique.select("x", "deviation", "whitened")
    frequent = F.broadcast(unique.filter(heavy).select("x", "deviation", "whitened"))
    rest = rows.join(F.broadcast(groups.filter(heavy).select("x")), "x", "left_anti").join(unique.filter(~heavy).select(*results.columns), "x")
    both = rows.join(frequent, "x").select("vec_id", "deviation", "whitened").union(rest.select("vec_id", "deviation", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return both.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight strongest components of all."""
    return whiten_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
