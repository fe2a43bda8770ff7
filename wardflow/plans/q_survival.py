"""Catalogue queries: survival (V1-V7) on lineitem.

Stand-in (SURVEY 7.4): duration ``l_quantity / 10`` (50 distinct times), event
``l_returnflag = 'R'``, covariates ``l_discount, l_tax, l_extendedprice``,
horizon 3, ridge penalty 0.1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.survival import (
    censor,
    cohort_summary,
    coefficient_table,
    concordance,
    fit_cox,
    hazard_as_of,
    horizon_label,
    nelson_aalen,
    predicted_risk,
    survival_at,
)
from wardflow.operators.metrics import auc
from wardflow.operators.ml import predictions_table
from wardflow.plans.registry import register
from wardflow.plans.shapes import double_round
from wardflow.sources.tables import read_table

HORIZON = 3.0
PENALIZER = 0.1
COVARIATES = ["l_discount", "l_tax", "l_extendedprice"]


def surv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", *COVARIATES,
        (F.col("l_quantity") / F.lit(10.0)).alias("dur"),
        (F.col("l_returnflag") == "R").alias("event"),
    )


_SURV_SQL = """s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_discount, l_tax, l_extendedprice,
         l_quantity / CAST(10 AS DOUBLE) AS dur, l_returnflag = 'R' AS event FROM lineitem)"""


@register(
    "v1_censor",
    f"""
WITH {_SURV_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(dur, {HORIZON!r}), 6) AS dur_c,
       event AND dur <= {HORIZON!r} AS event_c
FROM s""",
)
def v1_censor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surv_rows(spark, sf_dir)
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    return double_round(s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d.alias("dur_c"), e.alias("event_c")))


@register(
    "v2_horizon_label",
    f"""
WITH {_SURV_SQL}
SELECT l_linestatus, sum(CASE WHEN event AND dur <= {HORIZON!r} THEN 1 ELSE 0 END) AS n_label_1, count(*) AS n
FROM s GROUP BY l_linestatus""",
)
def v2_horizon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surv_rows(spark, sf_dir).withColumn("y", horizon_label(F.col("dur"), F.col("event"), HORIZON))
    return s.groupBy("l_linestatus").agg(F.sum("y").cast("long").alias("n_label_1"), F.count(F.lit(1)).alias("n"))


@register(
    "v7_cohort",
    f"""
WITH {_SURV_SQL}
SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE event) AS n_events,
       sum(CASE WHEN event AND dur <= {HORIZON!r} THEN 1 ELSE 0 END) AS n_events_by_horizon,
       CAST({HORIZON!r} AS DOUBLE) AS horizon
FROM s GROUP BY l_linestatus""",
)
def v7_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surv_rows(spark, sf_dir)
    out = cohort_summary(s, "l_linestatus", "dur", "event", HORIZON)
    return out.withColumn("n_events_by_horizon", F.col("n_events_by_horizon").cast("long"))


def cox_model(spark: SparkSession, sf_dir: str):
    s = surv_rows(spark, sf_dir)
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    return fit_cox(s.select(d.alias("dur"), e.alias("event"), *COVARIATES), "dur", "event", COVARIATES,
                   penalizer=PENALIZER)


@register("v3_cox")
def v3_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 + V6: coefficient table of the penalised Cox fit (rows-only check;
    coefficients are checked against a NumPy Newton solver in the tests)."""
    return coefficient_table(spark, cox_model(spark, sf_dir))


@register("v6_hazard_ratios")
def v6_hazard_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: covariates with p < 0.05. ``qty_discount`` follows the duration, so it has an effect."""
    s = surv_rows(spark, sf_dir).withColumn("qty_discount", F.col("dur") * F.col("l_discount"))
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    xs = [*COVARIATES, "qty_discount"]
    model = fit_cox(s.select(d.alias("dur"), e.alias("event"), *xs), "dur", "event", xs, penalizer=PENALIZER)
    return coefficient_table(spark, model, alpha=0.05)


@register("v4_survival_at_h")
def v4_survival_at_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surv_rows(spark, sf_dir)
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    s = s.withColumn("dur", d).withColumn("event", e)
    model = cox_model(spark, sf_dir)
    out = survival_at(s, model, "dur", "event", HORIZON, out="risk")
    return double_round(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "risk"))


def split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by order, so an order's lines stay together; the test rows' horizon is their shipping delay in tenths of a week."""
    li = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
                                                    F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *COVARIATES, (F.col("l_quantity") / F.lit(10.0)).alias("dur"),
                     (F.col("l_returnflag") == "R").alias("event"),
                     (F.datediff("l_shipdate", "o_orderdate") / F.lit(24.5)).alias("horizon"))
    return rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0")


_SPLIT_SQL = """r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / CAST(10 AS DOUBLE) AS dur, l_returnflag = 'R' AS event,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / CAST(24.5 AS DOUBLE) AS horizon
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register(
    "v4_hazard_as_of",
    f"""
WITH {_SPLIT_SQL},
t AS (SELECT dur AS time, count(*) AS n, count(*) FILTER (WHERE event) AS d FROM r WHERE l_orderkey % 5 <> 0 GROUP BY dur),
k AS (SELECT time, d / (sum(n) OVER (ORDER BY time DESC)) AS step FROM t),
h AS (SELECT time, sum(step) OVER (ORDER BY time) AS cum_hazard FROM k)
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, round(r.horizon, 6) AS horizon, round(coalesce(h.cum_hazard, 0), 6) AS cum_hazard
FROM (SELECT * FROM r WHERE l_orderkey % 5 = 0) r ASOF LEFT JOIN h ON r.horizon >= h.time""",
)
def v4_hazard_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows' hazard as of each test row's own horizon."""
    train, test = split_rows(spark, sf_dir)
    out = hazard_as_of(test, nelson_aalen(train, "dur", "event"), "horizon")
    return double_round(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "horizon", "cum_hazard"))


@register("v4_held_out_predictions")
def v4_held_out_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 + L7: fit on the training rows, risk of the test rows by their own horizon, as a predictions table
    with the run's AUC against the event by that horizon (fit and risk are compared with NumPy in the tests)."""
    train, test = split_rows(spark, sf_dir)
    # the join with orders runs once per side: the fit and the hazard read one cached copy, the AUC and the result another
    train = train.select("dur", "event", *COVARIATES).persist()
    model = fit_cox(train, "dur", "event", COVARIATES, penalizer=PENALIZER)
    scored = predicted_risk(test, train, model, "dur", "event", "horizon").withColumn(
        "label", (F.col("event") & (F.col("dur") <= F.col("horizon"))).cast("int")).withColumn(
        "line", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("line", "label", "risk").persist()
    run = auc(scored, [], "label", "risk").first()["auc"]
    table = predictions_table(scored, model_name="cox", model_args="own_horizon", num_shots=0, id_col="line", label_col="label", prob_col="risk")
    return double_round(table.withColumn("auc", F.lit(run).cast("double")))


@register("v5_concordance")
def v5_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concordance of the Cox risk score (exact; checked against brute-force
    pair counting on small fixtures in the tests)."""
    s = surv_rows(spark, sf_dir)
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    model = cox_model(spark, sf_dir)
    scored = s.select(d.alias("dur"), e.alias("event"), *COVARIATES).withColumn("risk", model.linear_predictor())
    return concordance(scored, "dur", "event", "risk")


@register(
    "v5_concordance_discount",
    f"""
WITH {_SURV_SQL},
c AS (SELECT least(dur, {HORIZON!r}) AS t, event AND dur <= {HORIZON!r} AS e, l_discount AS r FROM s),
cell AS (SELECT t, r, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM c GROUP BY t, r),
pairs AS (
  SELECT CAST(sum(a.d * (CASE WHEN b.t > a.t THEN b.n ELSE b.n - b.d END) * CASE WHEN b.r < a.r THEN 1.0 WHEN b.r = a.r THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS num,
         sum(a.d * (CASE WHEN b.t > a.t THEN b.n ELSE b.n - b.d END))::DOUBLE AS den
  FROM cell a JOIN cell b ON b.t >= a.t WHERE a.d > 0)
SELECT round(num / den, 6) AS concordance, round(num, 6) AS concordant_pairs, round(den, 6) AS comparable_pairs
FROM pairs""",
)
def v5_concordance_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with the discount as risk score: few distinct (time, risk) cells, so the
    oracle can count cell pairs directly."""
    s = surv_rows(spark, sf_dir)
    d, e = censor(F.col("dur"), F.col("event"), HORIZON)
    scored = s.select(d.alias("dur"), e.alias("event"), F.col("l_discount").alias("risk"))
    return double_round(concordance(scored, "dur", "event", "risk"))
