"""Reference data shapes derived from the driver tables.

entity = ``events.user_id`` (= ``customer.c_custkey``); relative time = seconds
since the user's first event; measured series = event types; intervals =
``[error ts, error ts + 6 h]``; static info = customer + nation + region;
outcome = ``c_acctbal < 0``. Each function returns a lazy DataFrame and the
matching SQL (DuckDB) text is kept next to it for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators.timeline import relative_seconds
from wardflow.sources.tables import read_table

ENTITY = "user_id"
TIME = "t"
SERIES = ("click", "view", "signup", "purchase")
INTERVAL_TYPE = "error"
INTERVAL_SECONDS = 6 * 3600.0
DAY = 86400.0
HORIZON_DAYS = 30


def double_round(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double column (results are compared to SQL after rounding)."""
    return df.select(
        *[
            F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, value, t) with t in seconds since the user's first event."""
    ev = read_table(spark, sf_dir, "events").select(ENTITY, "event_id", "event_type", "value", "ts")
    return relative_seconds(ev, ENTITY, "ts", out=TIME).drop("ts")


TIMELINE_SQL = """tl AS (
  SELECT e.user_id, e.event_id, e.event_type, e.value,
         (epoch_us(e.ts) - o.o_us) / CAST(1e6 AS DOUBLE) AS t
  FROM events e JOIN (SELECT user_id, min(epoch_us(ts)) AS o_us FROM events GROUP BY user_id) o
    ON e.user_id = o.user_id)"""


def measurements(tl: DataFrame) -> DataFrame:
    """Non-interval events as wide rows: one column per series, null elsewhere."""
    rows = tl.filter(F.col("event_type") != INTERVAL_TYPE)
    return rows.select(
        ENTITY, "event_id", TIME,
        *[F.when(F.col("event_type") == s, F.col("value")).alias(s) for s in SERIES],
    )


MEASUREMENTS_SQL = """meas AS (
  SELECT user_id, event_id, t, """ + ", ".join(
    f"CASE WHEN event_type = '{s}' THEN value END AS {s}" for s in SERIES
) + """
  FROM tl WHERE event_type <> 'error')"""


def intervals(tl: DataFrame) -> DataFrame:
    """(user_id, s, e): every error event opens a closed 6 h interval."""
    return tl.filter(F.col("event_type") == INTERVAL_TYPE).select(
        ENTITY, F.col(TIME).alias("s"), (F.col(TIME) + F.lit(INTERVAL_SECONDS)).alias("e")
    )


INTERVALS_SQL = f"""iv AS (
  SELECT user_id, t AS s, t + {INTERVAL_SECONDS!r} AS e FROM tl WHERE event_type = 'error')"""


def static_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: stratum (region), static columns, outcome."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias(ENTITY),
            F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("acctbal"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_acctbal") < 0).alias("outcome"),
        )
    )


STATIC_SQL = """st AS (
  SELECT c.c_custkey AS user_id, r.r_name AS region, c.c_acctbal AS acctbal,
         c.c_mktsegment AS segment, c.c_acctbal < 0 AS outcome
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""
