"""Timeline alignment: relative time, series alignment, static attachment,
interval-containment flags (ops J1-J6, U1, F1, P6, P7).

Entity and time column names are parameters everywhere; time is seconds
(double) relative to the entity's origin, as in the reference data model.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(ts: Column | str, *, ntz: bool = False) -> Column:
    """Microseconds since the epoch. For ``timestamp_ntz`` input (``ntz=True``) the
    wall-clock value is read as UTC with an exact microsecond difference, so the
    result does not depend on the session time zone (no DST shifts)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c.cast("timestamp"))


def relative_seconds(
    df: DataFrame,
    entity: str,
    ts_col: str,
    *,
    out: str = "t",
    origins: DataFrame | None = None,
    origin_col: str = "origin_us",
) -> DataFrame:
    """Add ``out`` = seconds since the entity's origin (default: its first timestamp).

    The origin table is one row per entity (partial aggregation makes it cheap
    even for a hot entity); joining it back is planned by AQE: broadcast when
    the measured table is small, sort-merge join with skew splitting otherwise.
    """
    ntz = isinstance(df.schema[ts_col].dataType, T.TimestampNTZType)
    us = epoch_micros(ts_col, ntz=ntz)
    if origins is None:
        origins = df.groupBy(entity).agg(F.min(us).alias(origin_col))
    joined = df.join(origins, on=entity, how="inner")
    return joined.withColumn(out, (us - F.col(origin_col)) / F.lit(1e6)).drop(origin_col)


def time_bucket(t: Column | str, width: float) -> Column:
    """Bucket number ``floor(t / width)`` (a tumbling window over relative time)."""
    c = F.col(t) if isinstance(t, str) else t
    return F.floor(c / F.lit(float(width)))


def clip(x: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clamp into [lo, hi]; null stays null (``least``/``greatest`` skip nulls)."""
    c = F.col(x) if isinstance(x, str) else x
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def observation_window(df: DataFrame, t: str, start: float, end: float, *, clip_end: float | None = None) -> DataFrame:
    """F1 + P6: keep ``start <= t <= end`` (closed) and clip ``t`` to ``clip_end``.

    Apply it to every series *before* alignment: a filter on the coalesced key
    of a full outer join is not pushed below the join by the optimizer.
    """
    kept = df.filter(F.col(t).between(start, end))
    if clip_end is not None:
        kept = kept.withColumn(t, clip(t, start, clip_end))
    return kept


def align_full_join(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chained full outer joins on the keys; USING-joins coalesce the keys.

    Each join's output has no usable partitioning, so every further series adds
    shuffles; prefer ``align_union`` (one shuffle) when keys are unique per series.
    """
    return reduce(lambda a, b: a.join(b, on=list(keys), how="full"), series)


def align_union(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """J2 in union form (U1 + A1): one shuffle for any number of series.

    Equal to ``align_full_join`` when (keys) is unique inside each series and the
    series share no value columns: every value column has at most one non-null
    per key, which ``max`` picks.
    """
    keys = list(keys)
    values = []
    for s in series:
        values += [c for c in s.columns if c not in keys and c not in values]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), series)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def key_spine(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every key that some series holds, once; keys with a null part are left out."""
    stacked = reduce(DataFrame.unionByName, [s.select(*keys) for s in series])
    return stacked.dropna(subset=list(keys)).distinct()


def align_on_spine(spine: DataFrame, series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """J2 over stored tables: every series is left-joined to the spine of all keys.

    Equal to ``align_full_join`` on rows without null keys. A left join keeps the
    spine's partitioning, which chained full joins lose; with the spine and all
    series stored by ``write_bucketed`` on ``keys`` in as many buckets, any
    number of series aligns without a shuffle.
    """
    return reduce(lambda a, b: a.join(b, on=list(keys), how="left"), series, spine)


def attach(df: DataFrame, side: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Attach per-entity columns by key (AQE picks broadcast or SMJ)."""
    return df.join(side, on=on, how=how)


def restrict_to_universe(df: DataFrame, ids: DataFrame, entity: str) -> DataFrame:
    """Right join to the entity universe (entities without rows keep one null row)."""
    return df.join(ids.select(entity).distinct(), on=entity, how="right")


def flag_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    entity: str,
    t: str,
    start: str,
    end: str,
    *,
    out: str = "in_interval",
    bucket_width: float = 3600.0,
) -> DataFrame:
    """J5 + J6: add boolean ``out`` = the point lies in some interval of its entity,
    both ends closed. One row out per point row: overlapping intervals never
    multiply rows (the reference's fan-out, quirk Q3, is corrected).

    No entity x interval pairs are formed. A point at time t is covered iff the
    largest end among intervals starting at or before t is >= t. That running
    maximum is computed in two levels over time buckets of ``bucket_width``
    seconds: a carry-in (max end of intervals starting in earlier buckets of the
    entity, from a window over the small per-bucket table) and a running max
    inside (entity, bucket). A hot entity is therefore split by its buckets
    (default 1 h: 720 buckets per 30 days; the per-entity carry table has one
    row per non-empty bucket). Null bounds never match (``between`` with null
    is not true).
    """
    b = "__b"
    valid = F.col(entity).isNotNull() & F.col(t).isNotNull()
    unmatched = points.filter(~valid).withColumn(out, F.lit(False))
    points_all, points = points, points.filter(valid)
    iv = (
        intervals.select(F.col(entity), F.col(start).alias("__s"), F.col(end).alias("__e"))
        .filter(F.col("__s").isNotNull() & F.col("__e").isNotNull() & (F.col("__e") >= F.col("__s")))
        .withColumn(b, time_bucket("__s", bucket_width))
    )
    pts = points.withColumn(b, time_bucket(t, bucket_width))

    # carry-in per (entity, bucket) of the points
    per_bucket = iv.groupBy(entity, b).agg(F.max("__e").alias("__mx"))
    point_buckets = pts.select(entity, b).distinct().withColumn("__mx", F.lit(None).cast("double"))
    w_carry = Window.partitionBy(entity).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_bucket.unionByName(point_buckets)
        .groupBy(entity, b)
        .agg(F.max("__mx").alias("__mx"))
        .select(entity, b, F.max("__mx").over(w_carry).alias("__carry"))
    )

    # running max inside (entity, bucket); interval starts sort before points at equal time
    stacked = pts.withColumn("__time", F.col(t).cast("double")).withColumn("__kind", F.lit(1)).withColumn(
        "__e", F.lit(None).cast("double")
    )
    starts = iv.select(entity, b, F.col("__s").alias("__time"), F.lit(0).alias("__kind"), "__e")
    stacked = stacked.unionByName(starts, allowMissingColumns=True)
    stacked = stacked.join(carry, on=[entity, b], how="inner")
    w_in = Window.partitionBy(entity, b).orderBy("__time", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    flagged = stacked.withColumn("__run", F.max("__e").over(w_in)).filter(F.col("__kind") == 1)
    reach = F.greatest(F.col("__run"), F.col("__carry"))
    flagged = flagged.withColumn(out, F.coalesce(reach >= F.col(t), F.lit(False)))
    return flagged.select(*points_all.columns, out).unionByName(unmatched)


def minimum_stay(df: DataFrame, length: str, *, least: float = 1 / 3) -> DataFrame:
    """rows whose entity stayed longer than ``least`` (days; 8 hours), as the
    hourly and survival feature sets need. A missing length does not qualify."""
    return df.filter(F.col(length) > F.lit(float(least)))
