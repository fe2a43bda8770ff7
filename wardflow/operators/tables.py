"""Small table utilities: regex column selection, unseen-level mapping, stable
heads, first match (ops P11, P15, O3, O4, A13, X11)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.random import hash_key


def columns_matching(df: DataFrame, *patterns: str, literal_prefix: bool = True) -> list[str]:
    """Columns whose name matches any pattern (plan time, no data read).

    With ``literal_prefix`` a pattern is taken as a literal name prefix and
    escaped, so ``"Temp (C)"`` matches ``"Temp (C) max"`` (the reference's regex
    treated ``(C)`` as a group and matched nothing, quirk Q9)."""
    regs = [re.compile("^" + re.escape(p)) if literal_prefix else re.compile(p) for p in patterns]
    return [c for c in df.columns if any(r.search(c) for r in regs)]


def map_unseen(df: DataFrame, reference: DataFrame, col: str, *, unknown: str = "Unknown", out: str | None = None) -> DataFrame:
    """Values of ``col`` not present in ``reference`` (e.g. the training rows)
    become ``unknown``; nulls too. The level list is a distinct aggregate joined
    by key (AQE broadcasts it when it is measured small)."""
    levels = reference.select(F.col(col).cast("string").alias("__lvl")).distinct().withColumn("__seen", F.lit(True))
    j = df.join(levels, F.col(col).cast("string") == F.col("__lvl"), "left")
    return j.withColumn(out or col, F.when(F.col("__seen"), F.col(col).cast("string")).otherwise(F.lit(unknown))).drop(
        "__lvl", "__seen"
    )


def stable_head(df: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """O3: the first ``n`` rows in ``md5(key:seed), key`` order (a plain ``limit``
    is not stable across plans). A top-n: each task keeps n rows, the driver
    merges partition tops."""
    return df.withColumn("__h", hash_key(F.col(key), F.lit(seed))).orderBy("__h", key).limit(n).drop("__h")


def first_match(df: DataFrame, group_cols: Sequence[str], order: str, value: Column | str, *, out: str) -> DataFrame:
    """Per group, the value on the row with the smallest ``order`` (``min_by``)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*group_cols).agg(F.min_by(v, F.col(order)).alias(out))


def lenient_double(c: Column | str) -> Column:
    """X11: text to double, unparsable -> null (``try_cast``; ANSI cast would fail)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col.cast("string")).try_cast("double")
