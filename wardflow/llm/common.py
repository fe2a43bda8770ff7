"""Shared helpers of the operators: Arrow batch maps, checkpoints, components of a link table."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the cluster shares.

    A scratch folder is set only where the session names none (tests on one machine).
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="wardflow-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    release(df.sparkSession)
    return done


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so plans know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and plans that nothing refers to any more.

    Spark's cleaner acts when the driver collects garbage; operators of many
    rounds would otherwise hold the files of all rounds.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def add_columns(df: DataFrame, reads: list[str], schema: T.StructType,
                fn: Callable[..., list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Columns ``schema`` computed by ``fn(*arrays of reads)`` per Arrow batch, beside the columns ``keep``.

    A kept column whose name a new column has is replaced by it. ``fn`` returns
    one array per new column, with as many rows as it was given.
    """
    new = set(schema.names)
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    # a column that is read and replaced travels under a name of its own
    inner = [f"__read{i}" for i in range(len(reads))]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(a) for c, a in zip(reads, inner)])
    out = T.StructType([source.schema[c] for c in keep] + list(schema.fields))
    names, n = out.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(*[b.column(n + i) for i in range(len(inner))])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + got, names=names)

    return source.mapInArrow(run, out)


def unescaped(df: DataFrame, names: list[str]) -> list:
    return [F.col(f"`{c}`") for c in names]


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``: rows (node, component).

    Label propagation with pointer jumping: each round takes the smallest label
    among a node's neighbours, then the label of that label, and is written to
    the checkpoint folder. The number of rounds follows the logarithm of the
    longest path in common cases; the loop ends when no label changes.
    """
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        root = labels.select(F.col("node").alias("low"), F.col("component").alias("of_low"))
        new = checkpoint(step.join(root, "low", "left")
                         .select("node", F.least("low", F.coalesce("of_low", "low")).alias("component"),
                                 (F.least("low", F.coalesce("of_low", "low")) != F.col("component")).alias("moved")))
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels
