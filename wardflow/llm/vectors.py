"""Integer vectors of an embedding column, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: scaled components beyond this size are read as this size, so that products and their sums stay in 64 bits
BOUND = 1 << 26


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinite component."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int, add: int = 0) -> DataFrame:
    """Rows (vec_id, x) of the usable vectors, x = floor(scale * component) + add as array<bigint>."""
    v = F.col(f"`{vector}`")
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(float(BOUND))),
                                                   F.lit(float(-BOUND)))).cast("long") + F.lit(add).cast("long"))
    return df.filter(usable(v)).select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, all of length ``width``, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def total(df: DataFrame, width: int, fn: Callable[[pa.RecordBatch], np.ndarray], kind: str = "bigint") -> np.ndarray:
    """Sum over all batches of ``df`` of the ``width`` numbers that ``fn`` gives for one.

    A task adds up its batches; Spark adds up the tasks. ``width`` numbers reach the driver.
    """
    dtype = np.int64 if kind == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width, dtype)
        for b in batches:
            if b.num_rows:
                out += fn(b)
        yield pa.RecordBatch.from_arrays([pa.array([out])], names=["v"])

    parts = df.mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v").alias("i", "x"))
    out = np.zeros(width, dtype)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out
