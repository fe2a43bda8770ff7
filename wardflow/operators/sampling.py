"""Reproducible sampling: exact stratified split, class-balanced few-shot
samples, shot ladders and folded example blocks (ops N1-N4, W3, W4).

The reference shuffles with library RNGs (not reproducible across engines).
Here every draw is an ``md5(key:seed)`` order, computed with ``hash_rank``, so
results are deterministic, independent of partitioning and checkable in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.random import hash_key
from wardflow.operators.scan import hash_rank

DEFAULT_SEED = 42


def stratified_split(
    df: DataFrame,
    entity: str,
    stratum: str,
    *,
    train_frac: float = 0.8,
    seed: int = DEFAULT_SEED,
    out: str = "split",
    train_label: str = "train",
    test_label: str = "test",
) -> DataFrame:
    """Exact-fraction split inside each stratum.

    ``df`` has one row per entity. In each stratum of n entities exactly
    ``round(train_frac * n)`` get ``train``: those first in ``md5(entity:seed)``
    order. Rank and stratum size are exact and distributed (``hash_rank``). A null
    stratum is a stratum of its own, as in the reference.
    """
    ranked = hash_rank(df, [stratum], entity, seed, rank_col="__rank", size_col="__n")
    return ranked.withColumn(
        out,
        F.when(F.col("__rank") < F.round(F.lit(train_frac) * F.col("__n")), F.lit(train_label)).otherwise(
            F.lit(test_label)
        ),
    ).drop("__rank", "__n")


def class_balanced_sample(
    df: DataFrame,
    label: str,
    key: str,
    n: int,
    *,
    seed: int = DEFAULT_SEED,
    rank_col: str = "sample_rank",
) -> DataFrame:
    """Up to ``n`` rows per class (all of a smaller class), seeded.

    Rows are the first ``n`` of each class in ``md5(key:seed)`` order. Raises for
    ``n <= 0`` like the reference (parameter check at plan time, S13).
    """
    if n <= 0:
        raise ValueError("n must be positive")
    return hash_rank(df, [label], key, seed, rank_col=rank_col, max_rank=n)


def sample_counts(df: DataFrame, label: str, n: int) -> DataFrame:
    """N2 companion: per class, rows available and rows used (the reference warns when short)."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("available"),
        F.least(F.count(F.lit(1)), F.lit(n)).alias("used"),
        (F.count(F.lit(1)) < n).alias("short"),
    )


def shots_ladder(
    df: DataFrame,
    label: str,
    key: str,
    shots: Sequence[int],
    *,
    seed: int = DEFAULT_SEED,
    shots_col: str = "num_shots",
    rank_col: str = "sample_rank",
) -> DataFrame:
    """The class-balanced sample for every n in ``shots`` from one ranking.

    Each row is expanded only into the ladder values it belongs to
    (``rank < n``) with ``explode`` - no join with the ladder.
    """
    shots = sorted({int(s) for s in shots if int(s) > 0})
    if not shots:
        raise ValueError("shots must contain a positive value")
    ranked = hash_rank(df, [label], key, seed, rank_col=rank_col, max_rank=shots[-1])
    ladder = F.array(*[F.lit(s) for s in shots])
    return ranked.withColumn(shots_col, F.explode(F.filter(ladder, lambda s: F.col(rank_col) < s)))


def fold_block(
    sample: DataFrame,
    group_cols: Sequence[str],
    key: str,
    text: Column | str,
    *,
    seed: int = DEFAULT_SEED,
    sep: str = "",
    out: str = "block",
) -> DataFrame:
    """Shuffle a (bounded) sample and fold it into one text per group.

    Only for samples whose size is bounded by construction (a few-shot sample
    has at most 2n rows per group). Order = ``md5(key:seed)``.
    """
    t = F.col(text) if isinstance(text, str) else text
    items = F.struct(hash_key(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k"), t.alias("x"))
    return sample.groupBy(*group_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda s: s["x"]), sep).alias(out),
        F.count(F.lit(1)).alias("n_examples"),
    )

