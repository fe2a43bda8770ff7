"""Mixing sources to target weights by Pfair scheduling of blocks.

Weights are kept exactly, as integers ``a`` of sum ``total``. Block i of a
source may start at slot floor(i * total / a) and must run before slot
ceil((i + 1) * total / a); earliest deadline first gives every block a slot
inside that window. Before slot t, floor(t * a / total) blocks are due and
ceil(t * a / total) have been released, so after any number of slots a source is
less than one block from its target, however long the table.

A block is as long as the table asks for: at least ``BLOCK`` rows, and more once the
table would have over ``MOST_BLOCKS`` blocks. So the schedule is a bounded
sequence for any table; one task writes it out, and the documents, numbered by
Spark, join their blocks. The driver keeps one number per source.

Documents are ordered inside their source by a hash of the id. Their exact
ranks come from counts per (source, hash bin) and a window inside each bin, so
a source with a third of all rows is spread over all bins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.llm.common import table, written

BLOCK = 16
BINS = 1024
#: blocks of a table, at most (about; every source may have a last one that is not full)
MOST_BLOCKS = 1 << 20
#: sources, at most: each is a number in the driver and in the task that writes the schedule
MOST_SOURCES = 1 << 18


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of ``weights``."""
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError(f"weights have to be finite, not negative and not all 0, not {weights}")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: x // common for s, x in whole.items()}


def jobs(a: list[int], n: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of the ``n[k]`` blocks of every source k, by earliest deadline first.

    ``a`` are the exact weights. Blocks of a source of weight 0 follow after all others.
    """
    total, at, slot = sum(a), [0] * len(a), 0
    waiting = [(0, k) for k in range(len(a)) if a[k] and n[k]]
    ready: list[tuple[int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(at[k] + 1) * total // a[k]), k))
        k = heapq.heappop(ready)[1]
        yield k, at[k], slot
        at[k] += 1
        slot += 1
        if at[k] < n[k]:
            heapq.heappush(waiting, (at[k] * total // a[k], k))
    for k in range(len(a)):
        for i in range(n[k] if not a[k] else 0):
            yield k, i, slot
            slot += 1


def block_length(rows: int, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> int:
    """Rows per block: ``block``, or more where the table would have over ``most_blocks`` blocks."""
    return max(block, -(-rows // most_blocks))


def schedule(spark: SparkSession, names: list[str], a: list[int], n: list[int]) -> DataFrame:
    """Rows (__s, mix_block, mix_slot) of ``jobs``, written by one task: a bounded number, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for some in batched(jobs(a, n), 8192):
                    k, i, at = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in k], pa.string()), pa.array(i, pa.int64()),
                                                      pa.array(at, pa.int64())], names=["__s", "mix_block", "mix_slot"])

    return written(spark.range(1).coalesce(1).mapInArrow(run, "__s string, mix_block long, mix_slot long"))


def source_sizes(docs: DataFrame, source: str, most: int = MOST_SOURCES) -> dict[str, int]:
    """Rows per source (a null source is ``''``)."""
    rows = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources; mix by a coarser column")
    return {r["s"]: r["count"] for r in rows}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id",
        block: int = BLOCK, bins: int = BINS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Adds ``mix_block`` (number of the block in its source), ``mix_slot`` (its slot) and ``mix_position``.

    Sorting by ``mix_position`` gives the mixture. While every source lasts
    (``mix_slot < `` the column ``mix_lasts``), a source's blocks are within one
    of its weight's part of all slots; afterwards slots that only a used-up source
    could fill stay empty, and every source that lasts stays within one block of
    its weight. Every row keeps its place: no row is dropped or repeated. Sources
    that ``weights`` lacks get the smallest weight in it; those of weight 0 follow
    after all others. A null source is the source ``''``; null ids sort by the other
    columns' hash; equal rows are separate rows; an empty table stays empty.
    Input columns named like a result are replaced. More than ``MOST_SOURCES``
    sources raise a ``ValueError``: weights of single rows or hosts are no mixture.
    """
    sizes = source_sizes(docs, source)
    # unless given: sizes tempered by a root, so small sources count more
    found = {s: n**0.5 for s, n in sizes.items()}
    if weights:
        least = min(weights.values())
        found = {s: float(weights.get(s, least)) for s in found}
    results = ["mix_block", "mix_slot", "mix_position", "mix_lasts"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    if not found:
        zero = F.lit(0).cast("long")
        return docs.select("*", *[zero.alias(c) for c in results])
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__s", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    keyed = keyed.withColumn("__h", F.xxhash64(F.lit(7), F.col(f"`{doc_id}`")))
    keyed = keyed.withColumn("__bin", F.shiftrightunsigned("__h", 64 - (bins - 1).bit_length()).cast("int"))
    counts = keyed.groupBy("__s", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    block = block_length(sum(sizes.values()), block, most_blocks)
    before = Window.partitionBy("__s").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__s", "__bin").orderBy(F.shiftleft("__h", 10), F.xxhash64(*others))
    ranked = (keyed.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, ["__s", "__bin"])
              .withColumn("__r", F.col("__r") + F.col("__before"))
              .withColumn("mix_block", F.floor(F.col("__r") / block).cast("long")))
    whole = exact_weights(found)
    names = sorted(whole)
    a, full = [whole[s] for s in names], [sizes[s] // block for s in names]
    plan = schedule(spark, names, a, [x + 1 for x in full])  # the last block is partly or wholly empty
    ends = spark.createDataFrame([(s, f) for s, f in zip(names, full) if whole[s]], "__s string, mix_block long")
    lasts = plan.join(ends, ["__s", "mix_block"]).agg(F.min("mix_slot").alias("t")).first()["t"]
    return ranked.join(plan, ["__s", "mix_block"]).select(
        *others, "mix_block", "mix_slot",
        (F.col("mix_slot") * block + F.col("__r") % block).cast("long").alias("mix_position"),
        F.lit(lasts).cast("long").alias("mix_lasts"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "mix_lasts")
