"""Per-entity feature tables (ops A1-A12, A15, W1, W2, P3, P4).

Feature sets ("conditions") of the reference:

* ``basic``   - max per measure                         (A4)
* ``minmax``  - min and max per measure                 (A5)
* ``stats``   - mean, sample std, min, max per measure  (A6)
* ``hourly``  - one column per (measure, time bucket)   (A8)
* ``forward_fill`` - ``hourly`` with values carried forward over existing buckets (A9)
* ``hourly_stats`` - ``hourly`` plus ``stats``          (A10, corrected: the
  reference's flag is ignored there, quirk Q6)

All aggregations are single hash aggregates (partial + final), so a hot entity
is combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.operators.scan import last_value
from wardflow.operators.timeline import time_bucket

KINDS = ("basic", "minmax", "stats")
# buckets of an entity that are filled in one window of the long table
LONG_BIN = 256


@dataclass(frozen=True)
class Measure:
    """One measured series: output ``alias`` of input column ``col``.

    ``how`` is the per-bucket statistic for bucketed formats (``mean`` or
    ``max``); ``decimals`` rounds that statistic (the reference rounds hourly
    means to 1 decimal and keeps maxima as they are).
    """

    alias: str
    col: str
    how: str = "mean"
    decimals: int | None = None


def round_half_up(x: Column, decimals: int) -> Column:
    """Round half away from zero, robust to the last-bit error of a mean.

    ``1e-9`` (scaled by sign) is added first so that a tie computed as
    ``12.249999999999998`` by one summation order and ``12.25`` by another
    rounds the same way in every engine (same rule in the oracle SQL).
    """
    return F.round(x + F.signum(x) * F.lit(1e-9), decimals)


def coalesce_fallback(*cols: Column) -> Column:
    """First non-null of the inputs (fallbacks are ordinary expressions)."""
    return F.coalesce(*cols)


def mean_arterial_pressure(
    mean_cols: Sequence[str],
    systolic_diastolic: Sequence[tuple[str, str]],
    *,
    weights: tuple[float, float] = (2.0, 1.0),
) -> Column:
    """P3 as used by the reference: a measured mean, else ``(w_s*sys + w_d*dia)/3``.

    The reference weights systolic twice (quirk Q1); the textbook formula is
    ``weights=(1.0, 2.0)``. The default keeps the reference's value.
    """
    ws, wd = weights
    derived = [(F.lit(ws) * F.col(s) + F.lit(wd) * F.col(d)) / F.lit(ws + wd) for s, d in systolic_diastolic]
    return F.coalesce(*[F.col(c) for c in mean_cols], *derived)


def row_sum_null_zero(*cols: str) -> Column:
    """Row-wise sum treating null as 0 (never null)."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def sum_or_zero(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0.0))


def stat_columns(
    measures: Sequence[Measure], kind: str, name_fmt: str = "{alias} {stat}"
) -> list[Column]:
    """Aggregate expressions of one feature kind."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    out: list[Column] = []
    for m in measures:
        c = F.col(m.col)
        if kind == "basic":
            out.append(F.max(c).alias(m.alias))
        elif kind == "minmax":
            out += [F.min(c).alias(name_fmt.format(alias=m.alias, stat="min")),
                    F.max(c).alias(name_fmt.format(alias=m.alias, stat="max"))]
        else:
            out += [F.avg(c).alias(name_fmt.format(alias=m.alias, stat="mean")),
                    F.stddev_samp(c).alias(name_fmt.format(alias=m.alias, stat="std")),
                    F.min(c).alias(name_fmt.format(alias=m.alias, stat="min")),
                    F.max(c).alias(name_fmt.format(alias=m.alias, stat="max"))]
    return out


def entity_features(
    df: DataFrame,
    entity: str,
    measures: Sequence[Measure],
    kind: str = "basic",
    *,
    sums: dict[str, str] | None = None,
    flags: dict[str, str] | None = None,
    extra: Sequence[Column] = (),
    name_fmt: str = "{alias} {stat}",
) -> DataFrame:
    """A4/A5/A6 (+A7, MechVent-style flags): one row per entity.

    ``sums`` maps output name -> column summed with 0 for none; ``flags`` maps
    output name -> boolean column reduced with ``bool_or``. Static columns are
    attached afterwards by key (quirk Q2 corrected), not taken with ``first``.
    """
    aggs = stat_columns(measures, kind, name_fmt)
    aggs += [sum_or_zero(c).alias(name) for name, c in (sums or {}).items()]
    aggs += [F.bool_or(F.col(c)).alias(name) for name, c in (flags or {}).items()]
    aggs += list(extra)
    return df.groupBy(entity).agg(*aggs)


def _bucket_stat(m: Measure, in_bucket: Column) -> Column:
    v = F.when(in_bucket, F.col(m.col))
    if m.how == "max":
        s = F.max(v)
    elif m.how == "mean":
        s = F.avg(v)
    else:
        raise ValueError(f"unknown bucket statistic {m.how!r}")
    return round_half_up(s, m.decimals) if m.decimals is not None else s


def bucket_wide(
    df: DataFrame,
    entity: str,
    t: str,
    measures: Sequence[Measure],
    *,
    width: float = 3600.0,
    n_buckets: int = 24,
    forward_fill: bool = False,
    densify: bool = False,
    name_fmt: str = "{alias} Hour {h}",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """A8 (and A9 with ``forward_fill``): per-bucket statistics pivoted wide.

    Rows are first reduced to one row per (entity, bucket) (partial + final
    aggregation on both keys, so a hot entity is split by its buckets), then
    pivoted with fixed values ``0..n_buckets-1`` (fixed schema, no extra job to
    find the values). Rows outside those buckets are ignored. ``extra``
    aggregates (e.g. whole-entity stats, A10) are computed from the rows by
    entity and joined on the entity key (both sides already hash-partitioned
    by it).

    Forward fill (W2) runs on the per-bucket rows before the pivot: a bucket
    that has a row takes the last non-null value of the measure up to itself;
    buckets with no row stay null (quirk Q7), unless ``densify`` is set: then
    they take it too, from the entity's first bucket to the last of the
    ``n_buckets``. The windows hold at most ``n_buckets`` rows per entity.
    """
    if densify and not forward_fill:
        raise ValueError("densify needs forward_fill")
    names = [m.alias for m in measures]
    per_bucket = bucket_long(df, entity, t, measures, width=width, bucket_col="__bkt").filter(
        (F.col("__bkt") >= 0) & (F.col("__bkt") < n_buckets)
    )
    if forward_fill:
        per_bucket = fill_forward(per_bucket, entity, "__bkt", names)
    if densify:
        per_bucket = densify_buckets(per_bucket, entity, "__bkt", n_buckets)
    wide = per_bucket.groupBy(entity).pivot("__bkt", list(range(n_buckets))).agg(
        *[F.first(F.col(n)).alias(n) for n in names]
    )
    pivot_name = (lambda h, n: f"{h}_{n}") if len(names) > 1 else (lambda h, n: f"{h}")
    wide = wide.select(
        entity,
        *[F.col(f"`{pivot_name(h, m.alias)}`").alias(name_fmt.format(alias=m.alias, h=h))
          for m in measures for h in range(n_buckets)],
    )
    extra = list(extra)
    if extra:
        wide = wide.join(df.groupBy(entity).agg(*extra), entity, "inner")
    return wide


def bucket_long(
    df: DataFrame,
    entity: str,
    t: str,
    measures: Sequence[Measure],
    *,
    width: float = 3600.0,
    bucket_col: str = "bucket",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """A1 over (entity, bucket): one row per existing bucket with its statistics."""
    aggs = []
    for m in measures:
        s = F.max(F.col(m.col)) if m.how == "max" else F.avg(F.col(m.col))
        aggs.append((round_half_up(s, m.decimals) if m.decimals is not None else s).alias(m.alias))
    return df.withColumn(bucket_col, time_bucket(t, width)).groupBy(entity, bucket_col).agg(*aggs, *extra)


def fill_forward(df: DataFrame, entity: str, order: str | Sequence[str], cols: Sequence[str], *,
                 per_bin: int | None = None) -> DataFrame:
    """Carry the last non-null value forward inside each entity; leading nulls stay.

    All columns share one window spec, so the plan has one Sort + Window: meant for
    tables with a bounded number of rows per entity. With ``per_bin`` the first
    order column is cut into bins of that width and the carry goes over the
    bins (``scan.last_value``), so an entity of any length spreads over its bins.
    """
    order = [order] if isinstance(order, str) else list(order)
    if per_bin is not None:
        filled = last_value(df, [entity], order, list(cols), F.floor(F.col(order[0]) / per_bin), prefix="__filled_")
        return filled.select(*[F.col(f"__filled_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        *[F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def densify_buckets(df: DataFrame, entity: str, bucket: str, n_buckets: int) -> DataFrame:
    """Q7 option: repeats each (entity, bucket) row for the buckets up to the entity's next row, or up to
    the last bucket, ``n_buckets - 1``.

    Buckets before an entity's first row are not made. ``df`` has one row per
    (entity, bucket), so a window holds at most ``n_buckets`` rows and the
    result at most ``n_buckets`` rows per entity; rows of later buckets stay as they are.
    """
    ahead = Window.partitionBy(entity).orderBy(bucket)
    until = F.greatest(F.least(F.coalesce(F.lead(bucket).over(ahead), F.lit(n_buckets)), F.lit(n_buckets)) - 1, F.col(bucket))
    spread = df.withColumn("__until", until)
    return spread.select(*[F.explode(F.sequence(F.col(bucket), F.col("__until"))).alias(bucket) if c == bucket else F.col(c) for c in df.columns])


forward_fill = fill_forward  # W1/W2 under the reference's name


def long_with_closing_row(
    buckets: DataFrame,
    closing: DataFrame,
    entity: str,
    bucket_col: str,
    fill_cols: Sequence[str],
) -> DataFrame:
    """Per-bucket rows plus one closing row per entity, statics forward-filled.

    ``closing`` holds (entity, bucket_col, ...) rows, e.g. the discharge hour
    ``ceil(LOS * 24)`` with the outcome; columns missing on either side become
    null (diagonal concat, U1) before the forward fill (W1). At an equal bucket
    the closing row sorts last.
    """
    stacked = buckets.withColumn("__closing", F.lit(0)).unionByName(
        closing.withColumn("__closing", F.lit(1)), allowMissingColumns=True
    )
    return fill_forward(stacked, entity, [bucket_col, "__closing"], fill_cols, per_bin=LONG_BIN).drop("__closing")


def start_stop(
    buckets: DataFrame,
    entity: str,
    bucket_col: str,
    *,
    end_value: Column,
    event: Column,
    event_on: str = "last_row",
    last_bucket: int = 23,
    start_col: str = "time_start",
    stop_col: str = "time_stop",
    event_col: str = "event",
) -> DataFrame:
    """Survival start-stop rows from per-bucket rows.

    ``time_start`` = bucket, ``time_stop`` = bucket + 1 except on the closing
    row, where it is ``end_value`` (e.g. LOS in hours); ``event`` is set only on
    the closing row. ``event_on='last_row'`` closes on each entity's last
    bucket (correction of quirk Q5); ``'hour23'`` closes on bucket
    ``last_bucket`` as the reference does. The last bucket comes from a window
    over per-bucket rows (bounded per entity).
    """
    if event_on == "last_row":
        w = Window.partitionBy(entity)
        is_last = F.col(bucket_col) == F.max(bucket_col).over(w)
    elif event_on == "hour23":
        is_last = F.col(bucket_col) == F.lit(last_bucket)
    else:
        raise ValueError("event_on must be 'last_row' or 'hour23'")
    return (
        buckets.withColumn("__last", is_last)
        .withColumn(start_col, F.col(bucket_col).cast("double"))
        .withColumn(stop_col, F.when(F.col("__last"), end_value).otherwise(F.col(bucket_col) + 1).cast("double"))
        .withColumn(event_col, F.when(F.col("__last"), event).otherwise(F.lit(False)))
        .drop("__last", bucket_col)
    )
