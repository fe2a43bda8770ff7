"""Vectorised row-level Poisson bootstrap of the AUC (used by ``metrics.bootstrap_auc``).

Rows are range-partitioned by (group, score, id) and sorted inside partitions,
so a partition holds a contiguous range of each group it touches, and a score
that a third of all rows share is spread over as many partitions as it fills. A
``mapInPandas`` task walks its rows in chunks; each chunk becomes a (rows x
replicates) matrix of Poisson(1) weights (the same integer-hash draws as
``functions.random.mixed_uniform``, so results equal the pure SQL form), reduced
per distinct score and folded into per-replicate running sums. A (group,
partition) segment emits, per replicate, the weights of its first and of its
last score (these may go on in the neighbouring partitions) and the AUC
numerator and weights of all scores strictly between. Spark adds up the parts
of each edge score, then the pairs across pieces with a window over that small
table in score order.

Work is rows x replicates in vectorised NumPy; memory is one chunk x replicates;
nothing is collected per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions.random import key_bits, mixed_uniform_np, poisson_cdf

CHUNK_ROWS = 2048

SEGMENT_SCHEMA = T.StructType([
    T.StructField("__gid", T.LongType()),
    T.StructField("__seg", T.DoubleType()),
    T.StructField("rep", T.IntegerType()),
    T.StructField("__within", T.DoubleType()),
    T.StructField("__pos", T.DoubleType()),
    T.StructField("__neg", T.DoubleType()),
    T.StructField("__edge", T.BooleanType()),
])


def _segments(n_boot: int, seed: int, chunk_rows: int = CHUNK_ROWS):
    """Per-partition walk over rows sorted by (group, score).

    State of the open segment (one group inside this partition): the completed
    first score (``edge``), sums over the completed scores after it (``num`` =
    AUC numerator among them, ``below`` = their negative weight, ``pos``) and the
    *open* tie group (last score seen), which may continue into the next chunk,
    batch or partition. Memory: one chunk x replicates.
    """
    cdf = np.array(poisson_cdf())
    reps = np.arange(n_boot, dtype=np.int64)

    def piece(gid, score, within, pos, neg, edge):
        return pd.DataFrame({
            "__gid": np.full(n_boot, gid, dtype=np.int64), "__seg": np.full(n_boot, score), "rep": reps.astype(np.int32),
            "__within": within, "__pos": pos, "__neg": neg, "__edge": np.full(n_boot, edge)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        st = None

        def close(state):
            out = [piece(state["gid"], state["open_s"], np.zeros(n_boot), state["open_pos"], state["open_neg"], True)]
            if state["edge"] is not None:
                out.append(piece(state["gid"], state["edge"][0], np.zeros(n_boot), *state["edge"][1:], True))
            if state["middle"] is not None:
                out.append(piece(state["gid"], state["middle"], state["num"], state["pos"], state["below"], False))
            return pd.concat(out)

        def complete(state, scores, pos, neg):
            """Scores (ascending) after which a larger one follows in the segment."""
            if not len(scores):
                return
            if state["edge"] is None:
                state["edge"] = (scores[0], pos[0].copy(), neg[0].copy())
                scores, pos, neg = scores[1:], pos[1:], neg[1:]
                if not len(scores):
                    return
            if state["middle"] is None:
                state["middle"] = scores[0]
            below = np.cumsum(neg, axis=0) - neg + state["below"][None, :]
            state["num"] += np.sum(pos * (below + neg / 2.0), axis=0)
            state["below"] += neg.sum(axis=0)
            state["pos"] += pos.sum(axis=0)

        def fold(state, keys, y, s):
            u = mixed_uniform_np(keys, reps, seed)
            w = np.searchsorted(cdf, u, side="left").astype(np.float64)
            bounds = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            pos = np.add.reduceat(w * y[:, None], bounds, axis=0)
            neg = np.add.reduceat(w * (1.0 - y)[:, None], bounds, axis=0)
            scores = s[bounds]
            if state["open_s"] is not None and scores[0] == state["open_s"]:
                pos[0] += state["open_pos"]
                neg[0] += state["open_neg"]
            elif state["open_s"] is not None:
                complete(state, np.array([state["open_s"]]), state["open_pos"][None, :], state["open_neg"][None, :])
            complete(state, scores[:-1], pos[:-1], neg[:-1])
            state["open_s"], state["open_pos"], state["open_neg"] = scores[-1], pos[-1].copy(), neg[-1].copy()

        for batch in batches:
            if batch.empty:
                continue
            gids = batch["__gid"].to_numpy()
            keys_all = batch["__key"].to_numpy()
            y_all = batch["__y"].to_numpy(dtype=np.float64)
            s_all = batch["__s"].to_numpy(dtype=np.float64)
            starts = np.flatnonzero(np.r_[True, gids[1:] != gids[:-1]])
            ends = np.r_[starts[1:], len(batch)]
            for a, b in zip(starts, ends):
                gid = int(gids[a])
                if st is None or st["gid"] != gid:
                    if st is not None:
                        yield close(st)
                    st = {"gid": gid, "edge": None, "middle": None, "open_s": None, "open_pos": None, "open_neg": None,
                          "num": np.zeros(n_boot), "below": np.zeros(n_boot), "pos": np.zeros(n_boot)}
                for c0 in range(a, b, chunk_rows):
                    c1 = min(b, c0 + chunk_rows)
                    fold(st, keys_all[c0:c1], y_all[c0:c1], s_all[c0:c1])
        if st is not None:
            yield close(st)

    return run


def replicate_aucs(base: DataFrame, label: str, score: str, key: str, *, n_boot: int, seed: int,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(__gid, rep, __auc) for every replicate with both classes. ``base`` has ``__gid``."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = base.select(
        "__gid", key_bits(F.col(key)).alias("__key"), F.col(label).cast("int").alias("__y"),
        F.col(score).cast("double").alias("__s"),
    ).repartitionByRange(parts, "__gid", "__s", "__key").sortWithinPartitions("__gid", "__s")
    seg = rows.mapInPandas(_segments(n_boot, seed, chunk_rows), SEGMENT_SCHEMA)
    seg = seg.groupBy("__gid", "rep", "__seg", "__edge").agg(*[F.sum(c).alias(c) for c in ("__within", "__pos", "__neg")])
    seg = seg.withColumn("__within", F.when(F.col("__edge"), F.col("__pos") * F.col("__neg") / 2.0).otherwise(F.col("__within")))
    w = Window.partitionBy("__gid", "rep").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("__negbefore", F.coalesce(F.sum("__neg").over(w), F.lit(0.0)))
    num = F.sum(F.col("__within") + F.col("__pos") * F.col("__negbefore"))
    p, n = F.sum("__pos"), F.sum("__neg")
    return seg.groupBy("__gid", "rep").agg(F.when((p > 0) & (n > 0), num / (p * n)).alias("__auc")).filter(
        F.col("__auc").isNotNull()
    )
