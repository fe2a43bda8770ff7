"""Bootstrap of the AUC with exactly n draws, by conditional binomials (used by ``metrics.bootstrap_auc``).

Drawing n rows with replacement and counting per (score, label) cell gives a
multinomial, so only the cells are needed: rows are never expanded, and a cell
costs one draw per replicate however many rows it holds. The n draws of a
replicate go down a tree. Cells in score order form leaves of ``LEAF`` cells, and
``FANOUT`` neighbouring nodes have one parent. A parent deals its draws to its
children one after the other: a child gets Binomial(draws left, its rows / rows
left), so the draws of every replicate add up to n.

Each node is one group of bounded size with random numbers of its own, keyed by
(seed, group, level, node); results depend neither on partitioning nor on the
order of tasks. A leaf walks its cells in score order and returns, per replicate,
its pairs and class sums; Spark adds the pairs across leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators.scan import float_bin, prefix_sum

LEAF = 4096
FANOUT = 1024


def _rng(seed: int, gid: int, level: int, node: int) -> np.random.Generator:
    words = [seed & (2**64 - 1), gid & (2**64 - 1), level, node]
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(words)))


def deal(rng: np.random.Generator, draws: np.ndarray, sizes: list[int]):
    """The draws of each replicate that every part of ``sizes`` gets, part after part; they add up to ``draws``."""
    left, rows = draws.copy(), int(sum(sizes))
    for size in sizes:
        got = left.copy() if size == rows else rng.binomial(left, size / rows) if size else np.zeros_like(left)
        left -= got
        rows -= int(size)
        yield got


def numbered_cells(hist: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``hist(__gid, score, pos, neg)`` with whole counts and ``__leaf``, the cells' place in score order divided by ``leaf``."""
    cells = hist.select("__gid", "score", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"),
                        F.lit(1).alias("one"))
    ranked = prefix_sum(cells, ["__gid"], ["score"], ["one"], float_bin("score"), inclusive=False, prefix="before_")
    return ranked.select("__gid", "score", "pos", "neg", F.floor(F.col("before_one") / leaf).cast("long").alias("__leaf"))


def _splitter(seed: int, level: int):
    """Function of a cogroup (children of a node, the node's draws) that deals the draws to the children."""

    def split(key, kids: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        kids = kids.sort_values("node")
        draws = np.array(parent["draws"].iloc[0], dtype=np.int64)
        got = list(deal(_rng(seed, int(key[0]), level, int(key[1])), draws, kids["size"].tolist()))
        return pd.DataFrame({"__gid": np.int64(key[0]), "node": kids["node"].to_numpy(), "draws": got})

    return split


def leaf_draws(cells: DataFrame, n_boot: int, seed: int, fanout: int = FANOUT) -> DataFrame:
    """Rows (__gid, node, draws): what each leaf gets of every replicate's n draws."""
    sizes = cells.groupBy("__gid", F.col("__leaf").alias("node")).agg(F.sum(F.col("pos") + F.col("neg")).alias("size"))
    levels = [sizes]
    deepest = sizes.agg(F.max("node").alias("m")).first()["m"] or 0
    while deepest:
        deepest //= fanout
        below = levels[-1].groupBy("__gid", F.floor(F.col("node") / fanout).cast("long").alias("node"))
        levels.append(below.agg(F.sum("size").alias("size")))
    top = levels.pop()
    draws = top.select("__gid", "node", F.array_repeat(F.col("size"), n_boot).alias("draws"))
    while levels:
        split = _splitter(seed, len(levels))
        children = levels.pop()
        kids = children.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).groupBy("__gid", "parent")
        parents = draws.toDF("__of", "parent_node", "draws").groupBy("__of", "parent_node")
        draws = kids.cogroup(parents).applyInPandas(split, "__gid long, node long, draws array<long>")
    return draws


def replicate_aucs_exact(hist: DataFrame, *, n_boot: int, seed: int, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(__gid, rep, __auc, __drawn) of every replicate with both classes from ``hist(__gid, score, pos, neg)``."""
    cells = numbered_cells(hist, leaf)
    draws = leaf_draws(cells, n_boot, seed, fanout).toDF("__of", "__node", "draws").groupBy("__of", "__node")

    def run(key, cells: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("score")
        within, above, below = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        sizes = np.column_stack([cells["pos"], cells["neg"]]).ravel().tolist()
        parts = deal(_rng(seed, int(key[0]), 0, int(key[1])), np.array(drawn["draws"].iloc[0], dtype=np.int64), sizes)
        for pos, neg in zip(parts, parts):
            within += pos * (below + neg / 2.0)
            above += pos
            below += neg
        return pd.DataFrame({"__gid": np.int64(key[0]), "__leaf": np.int64(key[1]), "rep": np.arange(n_boot, dtype=np.int32),
                             "__within": within, "__pos": above, "__neg": below})

    pieces = cells.groupBy("__gid", "__leaf").cogroup(draws).applyInPandas(
        run, "__gid long, __leaf long, rep int, __within double, __pos double, __neg double")
    w = Window.partitionBy("__gid", "rep").orderBy("__leaf").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__neg").over(w), F.lit(0.0)))
    p, n = F.sum("__pos"), F.sum("__neg")
    return pieces.groupBy("__gid", "rep").agg(
        F.when((p > 0) & (n > 0), F.sum(F.col("__within") + F.col("__pos") * F.col("__before")) / (p * n)).alias("__auc"),
        (p + n).cast("long").alias("__drawn")).filter(F.col("__auc").isNotNull())
