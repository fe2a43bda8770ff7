"""Catalogue queries: per-entity feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.features import (
    Measure,
    bucket_long,
    bucket_wide,
    entity_features,
    long_with_closing_row,
    start_stop,
    stat_columns,
    sum_or_zero,
)
from wardflow.operators.timeline import attach, flag_in_intervals
from wardflow.plans.registry import register
from wardflow.plans.shapes import (
    DAY,
    ENTITY,
    INTERVALS_SQL,
    MEASUREMENTS_SQL,
    STATIC_SQL,
    TIME,
    TIMELINE_SQL,
    double_round,
    intervals,
    measurements,
    static_info,
    timeline,
)

# GCS-like measure (max per bucket) and two HR-like measures (mean rounded to 1 decimal).
MEASURES = [Measure("click", "click", "max"), Measure("view", "view", "mean", 1), Measure("signup", "signup", "mean", 1)]
N_DAYS = 30


def _meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(timeline(spark, sf_dir))


# --- A4 / A5 / A6 -----------------------------------------------------------------------------

def _kind_sql(kind: str) -> str:
    parts = []
    for m in MEASURES:
        v = m.col
        if kind == "basic":
            parts.append(f"round(max({v}), 6) AS {m.alias}")
        elif kind == "minmax":
            parts.append(f"round(min({v}), 6) AS {m.alias}_min, round(max({v}), 6) AS {m.alias}_max")
        else:
            parts.append(
                f"round(avg({v}), 6) AS {m.alias}_mean, round(stddev_samp({v}), 6) AS {m.alias}_std, "
                f"round(min({v}), 6) AS {m.alias}_min, round(max({v}), 6) AS {m.alias}_max"
            )
    return ", ".join(parts)


A4_SQL = f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL},
{INTERVALS_SQL},
fl AS (SELECT m.*, EXISTS (SELECT 1 FROM iv WHERE iv.user_id = m.user_id AND m.t BETWEEN iv.s AND iv.e) AS f
       FROM meas m)
SELECT user_id, {_kind_sql("basic")}, round(coalesce(sum(purchase), 0), 6) AS urine_ml,
       bool_or(f) AS mechvent
FROM fl GROUP BY user_id"""


@register("a4_basic", A4_SQL)
def a4_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    fl = flag_in_intervals(measurements(tl), intervals(tl), ENTITY, TIME, "s", "e", out="f")
    return double_round(
        entity_features(fl, ENTITY, MEASURES, "basic", sums={"urine_ml": "purchase"}, flags={"mechvent": "f"})
    )


def _simple_kind_sql(kind: str) -> str:
    return f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL}
SELECT user_id, {_kind_sql(kind)}, round(coalesce(sum(purchase), 0), 6) AS urine_ml
FROM meas GROUP BY user_id"""


@register("a5_minmax", _simple_kind_sql("minmax"))
def a5_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(
        entity_features(_meas(spark, sf_dir), ENTITY, MEASURES, "minmax", sums={"urine_ml": "purchase"},
                        name_fmt="{alias}_{stat}")
    )


@register("a6_stats", _simple_kind_sql("stats"))
def a6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(
        entity_features(_meas(spark, sf_dir), ENTITY, MEASURES, "stats", sums={"urine_ml": "purchase"},
                        name_fmt="{alias}_{stat}")
    )


# --- A8 / A9 / A10: bucketed wide features ------------------------------------------------------

def _bucket_stat_sql(m: Measure, value: str) -> str:
    if m.how == "max":
        return f"max({value})"
    return f"round(avg({value}) + sign(avg({value})) * 1e-9, {m.decimals})"


_PER_DAY_SQL = f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL},
pd AS (
  SELECT user_id, CAST(floor(t / {DAY!r}) AS BIGINT) AS day,
         {", ".join(_bucket_stat_sql(m, m.col) + f" AS {m.alias}" for m in MEASURES)}
  FROM meas GROUP BY 1, 2)"""


def _pivot_sql(source: str, tail: str = "") -> str:
    cols = ", ".join(
        f"round(max(CASE WHEN day = {h} THEN {m.alias} END), 6) AS {m.alias}_d{h}"
        for m in MEASURES for h in range(N_DAYS)
    )
    return f"SELECT user_id, {cols}{tail} FROM {source} GROUP BY user_id"


@register("a8_hourly_wide", _PER_DAY_SQL + "\n" + _pivot_sql("pd"))
def a8_hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(
        bucket_wide(_meas(spark, sf_dir), ENTITY, TIME, MEASURES, width=DAY, n_buckets=N_DAYS,
                    name_fmt="{alias}_d{h}")
    )


_FILLED_SQL = _PER_DAY_SQL + """,
ff AS (
  SELECT user_id, day, """ + ", ".join(
    f"last_value({m.alias} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {m.alias}"
    for m in MEASURES
) + " FROM pd)\n"


@register("a9_forward_fill_wide", _FILLED_SQL + _pivot_sql("ff"))
def a9_forward_fill_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(
        bucket_wide(_meas(spark, sf_dir), ENTITY, TIME, MEASURES, width=DAY, n_buckets=N_DAYS,
                    forward_fill=True, name_fmt="{alias}_d{h}")
    )


_DENSE_SQL = _FILLED_SQL + f""",
days AS (SELECT f.user_id, unnest(range(f.first_day, {N_DAYS})) AS day FROM (SELECT user_id, min(day) AS first_day FROM pd GROUP BY 1) f),
grid AS (SELECT d.user_id, d.day, {", ".join("ff." + m.alias for m in MEASURES)}
         FROM days d ASOF JOIN ff ON d.user_id = ff.user_id AND d.day >= ff.day)
"""


@register("a9_densified_wide", _DENSE_SQL + _pivot_sql("grid"))
def a9_densified_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 with days that have no row filled as well, from an entity's first day on."""
    return double_round(
        bucket_wide(_meas(spark, sf_dir), ENTITY, TIME, MEASURES, width=DAY, n_buckets=N_DAYS,
                    forward_fill=True, densify=True, name_fmt="{alias}_d{h}")
    )


_A10_SQL = _PER_DAY_SQL + """,
ent AS (SELECT user_id, """ + _kind_sql("stats") + """ FROM meas GROUP BY user_id),
wide AS (""" + _pivot_sql("pd") + """)
SELECT wide.*, ent.* EXCLUDE (user_id) FROM wide JOIN ent ON wide.user_id = ent.user_id"""


@register("a10_wide_stats", _A10_SQL)
def a10_wide_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly wide + whole-entity stats in one aggregation (the reference's
    hourly_stats condition silently equals hourly, quirk Q6; corrected here)."""
    return double_round(
        bucket_wide(_meas(spark, sf_dir), ENTITY, TIME, MEASURES, width=DAY, n_buckets=N_DAYS,
                    name_fmt="{alias}_d{h}", extra=stat_columns(MEASURES, "stats", "{alias}_{stat}"))
    )


# --- A11: long format with a closing row per entity ----------------------------------------------

def _long_buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    meas = _meas(spark, sf_dir)
    per_day = bucket_long(meas, ENTITY, TIME, MEASURES, width=DAY, bucket_col="day",
                          extra=[sum_or_zero("purchase").alias("urine_ml")])
    los = timeline(spark, sf_dir).groupBy(ENTITY).agg((F.max(TIME) / F.lit(DAY)).alias("los_days"))
    return per_day, los


_LONG_SQL = f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL},
{STATIC_SQL},
pd AS (
  SELECT user_id, CAST(floor(t / {DAY!r}) AS BIGINT) AS day,
         {", ".join(_bucket_stat_sql(m, m.col) + f" AS {m.alias}" for m in MEASURES)},
         coalesce(sum(purchase), 0) AS urine_ml
  FROM meas GROUP BY 1, 2),
los AS (SELECT user_id, max(t) / {DAY!r} AS los_days FROM tl GROUP BY user_id)"""

_A11_SQL = _LONG_SQL + """,
rows_ AS (
  SELECT pd.user_id, pd.day, pd.click, pd.view, pd.signup, pd.urine_ml, false AS outcome,
         st.acctbal, st.segment, 0 AS closing
  FROM pd JOIN st ON pd.user_id = st.user_id
  UNION ALL
  SELECT los.user_id, CAST(ceil(los.los_days) AS BIGINT) AS day, NULL, NULL, NULL, NULL, st.outcome,
         NULL, NULL, 1 AS closing
  FROM los JOIN st ON los.user_id = st.user_id)
SELECT user_id, day, round(click, 6) AS click, round(view, 6) AS view, round(signup, 6) AS signup,
       round(urine_ml, 6) AS urine_ml, outcome,
       round(last_value(acctbal IGNORE NULLS) OVER w, 6) AS acctbal,
       last_value(segment IGNORE NULLS) OVER w AS segment
FROM rows_
WINDOW w AS (PARTITION BY user_id ORDER BY day, closing ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("a11_long_closing_row", _A11_SQL)
def a11_long_closing_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day, los = _long_buckets(spark, sf_dir)
    st = static_info(spark, sf_dir)
    rows = attach(per_day, st.select(ENTITY, "acctbal", "segment"), ENTITY, how="inner").withColumn(
        "outcome", F.lit(False)
    )
    closing = attach(los, st.select(ENTITY, "outcome"), ENTITY, how="inner").select(
        ENTITY, F.ceil("los_days").cast("long").alias("day"), "outcome"
    )
    out = long_with_closing_row(rows, closing, ENTITY, "day", ["acctbal", "segment"])
    return double_round(out.select(ENTITY, "day", "click", "view", "signup", "urine_ml", "outcome", "acctbal", "segment"))


# --- A12: survival start-stop rows ---------------------------------------------------------------

def _a12_sql(event_on: str) -> str:
    last = "pd.day = max(pd.day) OVER (PARTITION BY pd.user_id)" if event_on == "last_row" else "pd.day = 23"
    return _LONG_SQL + f""",
m AS (SELECT pd.*, {last} AS is_last, los.los_days, st.outcome
      FROM pd JOIN los ON pd.user_id = los.user_id JOIN st ON pd.user_id = st.user_id)
SELECT user_id, round(click, 6) AS click, round(view, 6) AS view, round(signup, 6) AS signup,
       round(urine_ml, 6) AS urine_ml,
       CAST(day AS DOUBLE) AS time_start,
       round(CASE WHEN is_last THEN los_days ELSE CAST(day + 1 AS DOUBLE) END, 6) AS time_stop,
       CASE WHEN is_last THEN outcome ELSE false END AS event
FROM m"""


def _a12(spark: SparkSession, sf_dir: str, event_on: str) -> DataFrame:
    per_day, los = _long_buckets(spark, sf_dir)
    st = static_info(spark, sf_dir).select(ENTITY, "outcome")
    rows = attach(attach(per_day, los, ENTITY, how="inner"), st, ENTITY, how="inner")
    out = start_stop(rows, ENTITY, "day", end_value=F.col("los_days"), event=F.col("outcome"), event_on=event_on)
    return double_round(out.select(ENTITY, "click", "view", "signup", "urine_ml", "time_start", "time_stop", "event"))


@register("a12_start_stop", _a12_sql("last_row"))
def a12_start_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a12(spark, sf_dir, "last_row")


@register("a12_start_stop_hour23", _a12_sql("hour23"))
def a12_start_stop_hour23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a12(spark, sf_dir, "hour23")
