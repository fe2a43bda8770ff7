"""Catalogue queries: flagship, expressions, filters, joins, interval flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.features import Measure, entity_features, mean_arterial_pressure, row_sum_null_zero
from wardflow.operators.sampling import stratified_split
from wardflow.operators.timeline import (
    align_full_join,
    align_union,
    attach,
    flag_in_intervals,
    observation_window,
    restrict_to_universe,
    time_bucket,
)
from wardflow.plans.registry import register
from wardflow.plans.shapes import (
    DAY,
    ENTITY,
    HORIZON_DAYS,
    INTERVALS_SQL,
    MEASUREMENTS_SQL,
    SERIES,
    STATIC_SQL,
    TIME,
    TIMELINE_SQL,
    double_round,
    intervals,
    measurements,
    static_info,
    timeline,
)
from wardflow.sources.tables import read_table

WINDOW_END = HORIZON_DAYS * DAY
VITALS = ("click", "view", "signup")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align -> interval flag -> per-entity stats -> static attach -> stratified split."""
    tl = observation_window(timeline(spark, sf_dir), TIME, 0.0, WINDOW_END)
    flagged = flag_in_intervals(measurements(tl), intervals(tl), ENTITY, TIME, "s", "e", out="in_interval")
    feats = entity_features(
        flagged,
        ENTITY,
        [Measure(v, v) for v in VITALS],
        kind="stats",
        sums={"purchase_total": "purchase"},
        flags={"mech_flag": "in_interval"},
        extra=[F.count(F.lit(1)).alias("n_rows")],
        name_fmt="{alias}_{stat}",
    )
    joined = attach(feats, static_info(spark, sf_dir), ENTITY, how="inner")
    return double_round(stratified_split(joined, ENTITY, "region", out="split"))


_STATS_SQL = ", ".join(
    f"round(avg({v}), 6) AS {v}_mean, round(stddev_samp({v}), 6) AS {v}_std, "
    f"round(min({v}), 6) AS {v}_min, round(max({v}), 6) AS {v}_max"
    for v in VITALS
)

FLAGSHIP_SQL = f"""
WITH {TIMELINE_SQL},
tlw AS (SELECT * FROM tl WHERE t BETWEEN 0 AND {WINDOW_END!r}),
{MEASUREMENTS_SQL.replace("FROM tl", "FROM tlw")},
{INTERVALS_SQL.replace("FROM tl", "FROM tlw")},
fl AS (
  SELECT m.*, EXISTS (SELECT 1 FROM iv WHERE iv.user_id = m.user_id AND m.t BETWEEN iv.s AND iv.e) AS in_interval
  FROM meas m),
feats AS (
  SELECT user_id, {_STATS_SQL},
         round(coalesce(sum(purchase), 0), 6) AS purchase_total,
         bool_or(in_interval) AS mech_flag, count(*) AS n_rows
  FROM fl GROUP BY user_id),
{STATIC_SQL},
j AS (SELECT feats.*, st.region, round(st.acctbal, 6) AS acctbal, st.segment, st.outcome
      FROM feats JOIN st ON feats.user_id = st.user_id),
r AS (
  SELECT j.*,
         row_number() OVER (PARTITION BY region ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id) - 1 AS rk,
         count(*) OVER (PARTITION BY region) AS n
  FROM j)
SELECT * EXCLUDE (rk, n), CASE WHEN rk < round(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r
"""

register("q_flagship", FLAGSHIP_SQL)(flagship)


# --- P3 / P4: derived fallbacks and null-as-zero sums over (user, day) channels ------------

def _day_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir).withColumn("day", time_bucket(TIME, DAY))
    return tl.groupBy(ENTITY, "day").agg(
        *[F.avg(F.when(F.col("event_type") == s, F.col("value"))).alias(f"{s}_avg") for s in SERIES],
        *[F.sum(F.when(F.col("event_type") == s, F.col("value"))).alias(f"{s}_sum") for s in SERIES],
        F.max(F.when(F.col("event_type") == "signup", F.col("value"))).alias("signup_max"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("purchase_min"),
    )


_DAY_CHANNELS_SQL = f"""
WITH {TIMELINE_SQL},
ch AS (
  SELECT user_id, CAST(floor(t / {DAY!r}) AS BIGINT) AS day,
         {", ".join(f"avg(CASE WHEN event_type = '{s}' THEN value END) AS {s}_avg" for s in SERIES)},
         {", ".join(f"sum(CASE WHEN event_type = '{s}' THEN value END) AS {s}_sum" for s in SERIES)},
         max(CASE WHEN event_type = 'signup' THEN value END) AS signup_max,
         min(CASE WHEN event_type = 'purchase' THEN value END) AS purchase_min
  FROM tl GROUP BY 1, 2)"""


@register(
    "p3_coalesce_fallback",
    _DAY_CHANNELS_SQL
    + """
SELECT user_id, day,
       round(coalesce(click_avg, view_avg, (2.0 * signup_avg + purchase_avg) / 3.0,
                      (2.0 * signup_max + purchase_min) / 3.0), 6) AS map_value
FROM ch""",
)
def p3_coalesce_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _day_channels(spark, sf_dir)
    return double_round(
        ch.select(
            ENTITY,
            "day",
            mean_arterial_pressure(
                ["click_avg", "view_avg"], [("signup_avg", "purchase_avg"), ("signup_max", "purchase_min")]
            ).alias("map_value"),
        )
    )


@register(
    "p4_row_sum_null_zero",
    _DAY_CHANNELS_SQL
    + """,
rs AS (SELECT user_id, day, coalesce(click_sum, 0) + coalesce(view_sum, 0) + coalesce(purchase_sum, 0) AS urine
       FROM ch)
SELECT user_id, round(coalesce(sum(urine), 0), 6) AS urine_total, count(*) AS n_days,
       round(max(urine), 6) AS urine_max_day
FROM rs GROUP BY user_id""",
)
def p4_row_sum_null_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _day_channels(spark, sf_dir).withColumn("urine", row_sum_null_zero("click_sum", "view_sum", "purchase_sum"))
    out = ch.groupBy(ENTITY).agg(
        F.coalesce(F.sum("urine"), F.lit(0.0)).alias("urine_total"),
        F.count(F.lit(1)).alias("n_days"),
        F.max("urine").alias("urine_max_day"),
    )
    return double_round(out)


# --- P6 / P7 / F1: observation window, clip, bucket -----------------------------------------

_WEEK = 7 * DAY


@register(
    "p6_p7_clip_bucket",
    f"""
WITH {TIMELINE_SQL}
SELECT user_id, event_id, round(least(greatest(t, 0.0), {_WEEK - 1!r}), 6) AS t_clipped,
       CAST(floor(least(greatest(t, 0.0), {_WEEK - 1!r}) / 3600.0) AS BIGINT) AS hour
FROM tl WHERE t BETWEEN 0 AND {_WEEK!r}""",
)
def p6_p7_clip_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = observation_window(timeline(spark, sf_dir), TIME, 0.0, _WEEK, clip_end=_WEEK - 1)
    return double_round(
        tl.select(ENTITY, "event_id", F.col(TIME).alias("t_clipped"), time_bucket(TIME, 3600.0).alias("hour"))
    )


# --- F2: in-list or null over derived nulls -------------------------------------------------

@register(
    "f2_in_or_null",
    """
SELECT e.event_type, count(*) AS n_rows, count(DISTINCT c.c_custkey) AS n_customers
FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id
WHERE e.event_type IN ('error', 'signup') OR e.event_type IS NULL
GROUP BY e.event_type""",
)
def f2_in_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ENTITY))
    e = read_table(spark, sf_dir, "events").select(ENTITY, "event_type")
    j = c.join(e, ENTITY, "left")
    kept = j.filter(F.col("event_type").isin("error", "signup") | F.col("event_type").isNull())
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(ENTITY).alias("n_customers")
    )


# --- J1 / J4: static left join series, right join to the id universe -----------------------

@register(
    "j1_j4_left_right",
    f"""
WITH {STATIC_SQL},
ser AS (SELECT user_id, count(*) AS n_events, sum(value) AS value_sum FROM events GROUP BY user_id),
info AS (SELECT st.user_id, st.region, ser.n_events, ser.value_sum FROM st LEFT JOIN ser ON st.user_id = ser.user_id),
ids AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT ids.user_id, info.region, info.n_events, round(info.value_sum, 6) AS value_sum
FROM info RIGHT JOIN ids ON info.user_id = ids.user_id""",
)
def j1_j4_left_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    ser = ev.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value_sum"))
    info = attach(static_info(spark, sf_dir).select(ENTITY, "region"), ser, ENTITY, how="left")
    cust = read_table(spark, sf_dir, "customer")
    ids = cust.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias(ENTITY)
    )
    return double_round(restrict_to_universe(info, ids, ENTITY).select(ENTITY, "region", "n_events", "value_sum"))


# --- J2: full-join alignment vs union alignment ---------------------------------------------

def _series_by_day(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    tl = timeline(spark, sf_dir).withColumn("day", time_bucket(TIME, DAY))
    return [
        tl.filter(F.col("event_type") == s).groupBy(ENTITY, "day").agg(F.avg("value").alias(s)) for s in SERIES
    ]


_J2_SQL = f"""
WITH {TIMELINE_SQL},
d AS (SELECT user_id, CAST(floor(t / {DAY!r}) AS BIGINT) AS day, event_type, value FROM tl),
{", ".join(f"s_{s} AS (SELECT user_id, day, avg(value) AS {s} FROM d WHERE event_type = '{s}' GROUP BY 1, 2)" for s in SERIES)}
SELECT user_id, day, {", ".join(f"round({s}, 6) AS {s}" for s in SERIES)}
FROM s_{SERIES[0]} {" ".join(f"FULL OUTER JOIN s_{s} USING (user_id, day)" for s in SERIES[1:])}
"""


@register("j2_full_align", _J2_SQL)
def j2_full_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(align_full_join(_series_by_day(spark, sf_dir), [ENTITY, "day"]))


@register("j2_union_align", _J2_SQL)
def j2_union_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(align_union(_series_by_day(spark, sf_dir), [ENTITY, "day"]))


# --- J5 / J6: interval containment flag ------------------------------------------------------

@register(
    "j5_interval_flag",
    f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL},
{INTERVALS_SQL}
SELECT m.user_id, m.event_id, round(m.t, 6) AS t,
       EXISTS (SELECT 1 FROM iv WHERE iv.user_id = m.user_id AND m.t BETWEEN iv.s AND iv.e) AS in_interval
FROM meas m""",
)
def j5_interval_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    flagged = flag_in_intervals(measurements(tl), intervals(tl), ENTITY, TIME, "s", "e", out="in_interval")
    return double_round(flagged.select(ENTITY, "event_id", TIME, "in_interval"))


@register(
    "j5_interval_flag_day_buckets",
    f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL},
{INTERVALS_SQL}
SELECT m.user_id, m.event_id,
       EXISTS (SELECT 1 FROM iv WHERE iv.user_id = m.user_id AND m.t BETWEEN iv.s AND iv.e) AS in_interval
FROM meas m""",
)
def j5_interval_flag_day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same flag with 1-day sweep buckets (the default is 1 h; both cross bucket
    boundaries with 6 h intervals, so the carry-in path is exercised)."""
    tl = timeline(spark, sf_dir)
    flagged = flag_in_intervals(
        measurements(tl), intervals(tl), ENTITY, TIME, "s", "e", out="in_interval", bucket_width=86400.0
    )
    return flagged.select(ENTITY, "event_id", "in_interval")



# --- J3 / J7 / J8: per-entity tables attached to per-bucket rows -------------------------------

@register(
    "j3_j7_attach",
    f"""
WITH {TIMELINE_SQL},
pd AS (SELECT user_id, CAST(floor(t / {DAY!r}) AS BIGINT) AS day, count(*) AS n_events FROM tl GROUP BY 1, 2),
ent AS (SELECT user_id, max(t) / {DAY!r} AS los_days FROM tl GROUP BY 1),
sc AS (SELECT o_custkey AS user_id, count(*) AS n_orders, sum(o_totalprice) AS order_total FROM orders GROUP BY 1)
SELECT pd.user_id, pd.day, pd.n_events, round(ent.los_days, 6) AS los_days, sc.n_orders,
       round(sc.order_total, 6) AS order_total
FROM pd LEFT JOIN ent ON pd.user_id = ent.user_id LEFT JOIN sc ON pd.user_id = sc.user_id""",
)
def j3_j7_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-entity aggregate (length of stay) and J3: a per-entity score
    table (order totals) attached to per-(entity, day) rows by left joins."""
    tl = timeline(spark, sf_dir)
    per_day = tl.groupBy(ENTITY, time_bucket(TIME, DAY).alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    ent = tl.groupBy(ENTITY).agg((F.max(TIME) / F.lit(DAY)).alias("los_days"))
    orders = read_table(spark, sf_dir, "orders")
    scores = orders.groupBy(F.col("o_custkey").alias(ENTITY)).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("order_total")
    )
    return double_round(attach(attach(per_day, ent, ENTITY, "left"), scores, ENTITY, "left"))
