"""Catalogue queries: evaluation metrics (M1-M9, M15) over predictions tables.

Stand-ins (SURVEY 7.4): ``orders`` is a predictions table (label
``o_orderstatus = 'F'``, score ``o_totalprice / 500000``, model
``o_orderpriority``, args ``c_mktsegment``, shots ``year(o_orderdate)``);
``lineitem`` is one with heavy ties (label ``l_returnflag = 'R'``, score
``l_discount``); labelled documents give a small per-language table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.labels import model_label, model_label_sql
from wardflow.functions.random import key_bits_sql, mixed_uniform_sql, poisson_weight_sql
from wardflow.operators.metrics import (
    auc,
    auc_standard_error,
    average_precision_from_histogram,
    bootstrap_auc,
    missing_share,
    rates,
    roc_points,
    score_histogram,
    summary_metrics,
    threshold_metrics,
)
from wardflow.plans.registry import register
from wardflow.plans.shapes import double_round
from wardflow.sources.tables import read_table


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderpriority").alias("model"),
        F.col("c_mktsegment").alias("model_args"),
        F.year("o_orderdate").alias("num_shots"),
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("score"),
    )


ORDER_PRED_SQL = """pred AS (
  SELECT o.o_orderpriority AS model, c.c_mktsegment AS model_args, CAST(year(o.o_orderdate) AS INTEGER) AS num_shots,
         o.o_orderkey AS id, CAST(o.o_orderstatus = 'F' AS INTEGER) AS label,
         o.o_totalprice / CAST(500000 AS DOUBLE) AS score
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_discount").alias("score"),
    )


LINE_PRED_SQL = """pred AS (
  SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount AS score FROM lineitem)"""


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"),
        F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("score"),
    )


DOC_PRED_SQL = """pred AS (
  SELECT d.doc_id, d.lang, l.quality AS label, least(d.n_chars / CAST(20000 AS DOUBLE), 1.0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _hist_sql(group: str) -> str:
    return f"""h AS (
  SELECT {group}, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
  FROM pred WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {group}, score)"""


def _auc_sql(group: str, hist: str = "h", out: str = "auc") -> str:
    return f"""SELECT {group},
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0
         THEN sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) END AS {out},
    sum(pos) AS n_pos, sum(neg) AS n_neg
  FROM (SELECT *, sum(neg) OVER (PARTITION BY {group} ORDER BY score
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM {hist})
  GROUP BY {group}"""


# --- M1 ROC points ---------------------------------------------------------------------------

@register(
    "m1_roc_points",
    f"""
WITH {LINE_PRED_SQL},
{_hist_sql("l_linestatus")},
c AS (SELECT l_linestatus, score,
             sum(pos) OVER (PARTITION BY l_linestatus ORDER BY score DESC) AS cp,
             sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score DESC) AS cn,
             sum(pos) OVER (PARTITION BY l_linestatus) AS p_tot,
             sum(neg) OVER (PARTITION BY l_linestatus) AS n_tot FROM h)
SELECT l_linestatus, round(score, 6) AS threshold, round(cn / n_tot, 6) AS fpr, round(cp / p_tot, 6) AS tpr FROM c
UNION ALL
SELECT DISTINCT l_linestatus, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM h""",
)
def m1_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(roc_points(line_predictions(spark, sf_dir), ["l_linestatus"], "label", "score"))


@register(
    "m1_roc_reduced",
    f"""
WITH {ORDER_PRED_SQL},
{_hist_sql("model")},
c AS (SELECT model, score, pos, neg, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i,
             sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
             sum(pos) OVER (PARTITION BY model) AS p_tot, sum(neg) OVER (PARTITION BY model) AS n_tot
      FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(score, 6) AS threshold, round(cn / n_tot, 6) AS fpr, round(cp / p_tot, 6) AS tpr FROM c
WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL
SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM h""",
)
def m1_roc_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 as a plot shows it: points inside straight runs are left out."""
    return double_round(roc_points(order_predictions(spark, sf_dir), ["model"], "label", "score", drop_intermediate=True))


# --- M2 / M3 AUC and average precision ----------------------------------------------------

@register(
    "m2_auc",
    f"""
WITH {ORDER_PRED_SQL},
{_hist_sql("model, num_shots")}
SELECT model, num_shots, round(auc, 6) AS auc, n_pos, n_neg FROM ({_auc_sql("model, num_shots")})""",
)
def m2_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(auc(order_predictions(spark, sf_dir), ["model", "num_shots"], "label", "score"))


@register(
    "m2_auc_ties",
    f"""
WITH {LINE_PRED_SQL},
{_hist_sql("l_linestatus")}
SELECT l_linestatus, round(auc, 6) AS auc, n_pos, n_neg FROM ({_auc_sql("l_linestatus")})""",
)
def m2_auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(auc(line_predictions(spark, sf_dir), ["l_linestatus"], "label", "score"))


def _ap_sql(group: str) -> str:
    return f"""SELECT {group},
    CASE WHEN sum(pos) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos) END AS ap
  FROM (SELECT *, sum(pos) OVER (PARTITION BY {group} ORDER BY score DESC) AS tp,
                  sum(neg) OVER (PARTITION BY {group} ORDER BY score DESC) AS fp FROM h)
  GROUP BY {group}"""


@register(
    "m3_average_precision",
    f"""
WITH {ORDER_PRED_SQL},
{_hist_sql("model")}
SELECT model, round(ap, 6) AS ap FROM ({_ap_sql("model")})""",
)
def m3_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_predictions(spark, sf_dir)
    return double_round(average_precision_from_histogram(score_histogram(p, ["model"], "label", "score"), ["model"]))


@register(
    "m3_average_precision_ties",
    f"""
WITH {LINE_PRED_SQL},
{_hist_sql("l_linestatus")}
SELECT l_linestatus, round(ap, 6) AS ap FROM ({_ap_sql("l_linestatus")})""",
)
def m3_average_precision_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = line_predictions(spark, sf_dir)
    return double_round(
        average_precision_from_histogram(score_histogram(p, ["l_linestatus"], "label", "score"), ["l_linestatus"])
    )


# --- M4 threshold metrics ----------------------------------------------------------------------

def _m4_sql(op: str) -> str:
    return f"""
WITH {LINE_PRED_SQL},
c AS (
  SELECT l_linestatus,
         count(*) FILTER (WHERE score * 10 {op} 0.5 AND label = 1) AS tp,
         count(*) FILTER (WHERE score * 10 {op} 0.5 AND label = 0) AS fp,
         count(*) FILTER (WHERE NOT (score * 10 {op} 0.5) AND label = 1) AS fn,
         count(*) FILTER (WHERE NOT (score * 10 {op} 0.5) AND label = 0) AS tn
  FROM pred GROUP BY l_linestatus)
SELECT l_linestatus, tp, fp, fn, tn,
       round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM c"""


def _m4(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    p = line_predictions(spark, sf_dir).withColumn("score", F.col("score") * F.lit(10.0))
    return double_round(threshold_metrics(p, ["l_linestatus"], "label", "score", threshold=0.5, inclusive=inclusive))


@register("m4_threshold_metrics", _m4_sql(">="))
def m4_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m4(spark, sf_dir, True)


@register("m4_threshold_metrics_gt", _m4_sql(">"))
def m4_threshold_metrics_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m4(spark, sf_dir, False)


# --- M5 / M6 bootstrap --------------------------------------------------------------------------

def bootstrap_sql(pred_sql: str, group: str, key: str, n_boot: int, seed: int = 42, extra_select: str = "") -> str:
    """DuckDB form of ``bootstrap_auc`` (row-level Poisson weights from md5)."""
    u = mixed_uniform_sql("bits", "rep", seed)
    return f"""
WITH {pred_sql},
base AS (SELECT *, {key_bits_sql(key)} AS bits FROM pred WHERE label IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
{_hist_sql(group).replace("FROM pred WHERE label IS NOT NULL AND score IS NOT NULL", "FROM base")},
pt AS ({_auc_sql(group)}),
w AS (SELECT b.*, r.range AS rep, {poisson_weight_sql(u)} AS wt FROM base b CROSS JOIN range(0, {n_boot}) r),
hw AS (SELECT {group}, rep, score, sum(wt * label)::DOUBLE AS pos, sum(wt * (1 - label))::DOUBLE AS neg
       FROM w WHERE wt > 0 GROUP BY {group}, rep, score),
ra AS ({_auc_sql(group + ", rep", "hw", "a")}),
dist AS (SELECT {group}, avg(a) AS auc_mean, stddev_pop(a) AS auc_std,
                quantile_cont(a, 0.025) AS lo, quantile_cont(a, 0.975) AS hi, count(*) AS n_boot_used
         FROM ra WHERE a IS NOT NULL GROUP BY {group})
SELECT {", ".join(f"pt.{g.strip()}" for g in group.split(","))}, round(pt.auc, 6) AS auc,
       round(dist.auc_mean, 6) AS auc_mean, round(dist.auc_std, 6) AS auc_std,
       round(dist.lo, 6) AS auc_ci_lower, round(dist.hi, 6) AS auc_ci_upper,
       coalesce(dist.n_boot_used, 0) AS n_boot_used{extra_select}
FROM pt LEFT JOIN dist ON {" AND ".join(f"pt.{g.strip()} = dist.{g.strip()}" for g in group.split(","))}"""


@register("m5_bootstrap_auc", bootstrap_sql(DOC_PRED_SQL, "lang", "doc_id", 100))
def m5_bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = doc_predictions(spark, sf_dir)
    return double_round(bootstrap_auc(p, ["lang"], "label", "score", "doc_id", n_boot=100, seed=42))


@register(
    "m5_bootstrap_string_id",
    bootstrap_sql(DOC_PRED_SQL.replace("SELECT d.doc_id", "SELECT 'doc_' || d.doc_id AS sid, d.doc_id"), "lang", "sid", 50, seed=7))
def m5_bootstrap_string_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 with the string ids of the predictions schema."""
    p = doc_predictions(spark, sf_dir).withColumn("sid", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return double_round(bootstrap_auc(p, ["lang"], "label", "score", "sid", n_boot=50, seed=7))


_LINE_ID = "l_orderkey || ':' || l_linenumber || ':' || l_partkey"


@register(
    "m5_bootstrap_ties",
    bootstrap_sql(LINE_PRED_SQL.replace("SELECT l_linestatus", f"SELECT {_LINE_ID} AS id, l_linestatus"), "l_linestatus", "id", 20))
def m5_bootstrap_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 where a few scores are shared by all rows (each spread over several tasks)."""
    li = read_table(spark, sf_dir, "lineitem")
    p = li.select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"),
                  F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    return double_round(bootstrap_auc(p, ["l_linestatus"], "label", "score", "id", n_boot=20, seed=42))


@register("m6_percentile_ci", bootstrap_sql(DOC_PRED_SQL, "lang", "doc_id", 1000))
def m6_percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = doc_predictions(spark, sf_dir)
    return double_round(bootstrap_auc(p, ["lang"], "label", "score", "doc_id", n_boot=1000, seed=42))


_EXACT_CI = """abs(lo - (auc - 1.959964 * se)) < 0.5 * se AND abs(hi - (auc + 1.959964 * se)) < 0.5 * se"""


@register(
    "m6_percentile_ci_binned",
    f"""
WITH {LINE_PRED_SQL},
{_hist_sql("l_linestatus")},
c AS (SELECT *, sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score) AS cn, sum(pos) OVER (PARTITION BY l_linestatus ORDER BY score) AS cp,
             sum(pos) OVER (PARTITION BY l_linestatus) AS p, sum(neg) OVER (PARTITION BY l_linestatus) AS n FROM h),
v AS (SELECT *, (cn - neg / 2) / n AS below, (p - cp + pos / 2) / p AS above FROM c),
m AS (SELECT l_linestatus, sum(pos * below) / sum(pos) AS auc, max(p) AS p, max(n) AS n FROM v GROUP BY l_linestatus)
SELECT m.l_linestatus, round(m.auc, 6) AS auc,
       round(sqrt(sum(pos * (below - auc) ** 2) / (m.p - 1) / m.p + sum(neg * (above - auc) ** 2) / (m.n - 1) / m.n), 6) AS auc_se,
       TRUE AS ci_as_expected, 1000 AS n_boot_used
FROM v JOIN m USING (l_linestatus) GROUP BY m.l_linestatus, m.auc, m.p, m.n""",
)
def m6_percentile_ci_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B = 1000 with exactly n draws each on the tie-heavy lineitem table, beside the
    closed-form standard error. ``ci_as_expected``: both percentiles lie within half a
    standard error of the normal interval (a percentile of 1000 draws strays by about a tenth)."""
    p = line_predictions(spark, sf_dir).withColumn("id", F.lit(0))
    boot = bootstrap_auc(p, ["l_linestatus"], "label", "score", "id", n_boot=1000, binned=True)
    both = boot.join(auc_standard_error(p, ["l_linestatus"], "label", "score", out="se"), "l_linestatus")
    return double_round(both.withColumnsRenamed({"auc_ci_lower": "lo", "auc_ci_upper": "hi"}).select(
        "l_linestatus", "auc", F.col("se").alias("auc_se"), F.expr(_EXACT_CI).alias("ci_as_expected"), "n_boot_used"))


@register("m5_bootstrap_exact_n")
def m5_bootstrap_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 with exactly n draws per replicate on scores without ties (as many cells as rows);
    compared with a NumPy resampling in the tests."""
    return double_round(bootstrap_auc(order_predictions(spark, sf_dir), ["model"], "label", "score", "id", n_boot=200, binned=True))


# --- M7 / M8 -----------------------------------------------------------------------------------

@register(
    "m7_missing_share",
    """
SELECT d.lang, count(*) AS n_total, count(*) FILTER (WHERE l.quality IS NULL) AS n_missing,
       round(avg(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def m7_missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return double_round(missing_share(d.join(lab, "doc_id", "left"), ["lang"], "quality"))


@register(
    "m8_rates",
    f"""
WITH {DOC_PRED_SQL}
SELECT lang, round(avg(label), 6) AS event_rate, round(avg(score), 6) AS mean_prediction, count(*) AS n
FROM pred GROUP BY lang""",
)
def m8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(rates(doc_predictions(spark, sf_dir), ["lang"], "label", "score"))


# --- M9 grouped summary -------------------------------------------------------------------------

M9_GROUP = ["model", "model_args", "num_shots"]


def _m9_sql(n_boot: int) -> str:
    g = "model, model_args, num_shots"
    boot = bootstrap_sql(ORDER_PRED_SQL, g, "id", n_boot)
    body = boot.split("\nSELECT pt.model")[0]
    return body + f""",
valid AS (SELECT {g} FROM base GROUP BY {g} HAVING count(*) >= 2 AND count(DISTINCT label) = 2),
ap AS ({_ap_sql(g)}),
thr AS (
  SELECT {g},
         count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
         count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn
  FROM base GROUP BY {g})
SELECT {model_label_sql("v.model")} AS model_name, v.model_args, v.num_shots,
       round(pt.auc, 6) AS auc, round(dist.lo, 6) AS auc_ci_low, round(dist.hi, 6) AS auc_ci_high,
       round(ap.ap, 6) AS ap,
       round((thr.tp + thr.tn) / (thr.tp + thr.fp + thr.fn + thr.tn), 6) AS accuracy,
       round(CASE WHEN 2 * thr.tp + thr.fp + thr.fn > 0 THEN 2 * thr.tp / (2 * thr.tp + thr.fp + thr.fn) ELSE 0 END, 6) AS f1_score,
       round(CASE WHEN thr.tp + thr.fp > 0 THEN thr.tp / (thr.tp + thr.fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN thr.tp + thr.fn > 0 THEN thr.tp / (thr.tp + thr.fn) ELSE 0 END, 6) AS recall
FROM valid v
JOIN pt USING ({g}) LEFT JOIN dist USING ({g}) JOIN ap USING ({g}) JOIN thr USING ({g})"""


def m9_frame(spark: SparkSession, sf_dir: str, n_boot: int = 1000) -> DataFrame:
    p = order_predictions(spark, sf_dir)
    s = summary_metrics(p, M9_GROUP, "label", "score", "id", n_boot=n_boot, seed=42)
    return double_round(
        s.select(
            model_label("model").alias("model_name"), "model_args", "num_shots",
            F.col("AUC").alias("auc"), F.col("AUC_CI_Low").alias("auc_ci_low"),
            F.col("AUC_CI_High").alias("auc_ci_high"), F.col("AP").alias("ap"),
            F.col("Accuracy").alias("accuracy"), F.col("F1 Score").alias("f1_score"),
            F.col("Precision").alias("precision"), F.col("Recall").alias("recall"),
        )
    )


@register("m9_summary_metrics", _m9_sql(1000))
def m9_summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m9_frame(spark, sf_dir, 1000)


# --- M15 precomputed score as probability ----------------------------------------------------

@register(
    "m15_score_baseline",
    bootstrap_sql(
        """pred AS (
  SELECT c.c_custkey AS id, 'score_baseline' AS model, CAST(c.c_acctbal < 0 AS INTEGER) AS label,
         1.0 / (1.0 + exp(c.c_acctbal / 1000.0)) AS score
  FROM customer c)""",
        "model",
        "id",
        100,
    ),
)
def m15_score_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A precomputed per-entity score used directly as a probability (here a
    logistic transform of the account balance), with its bootstrap AUC."""
    c = read_table(spark, sf_dir, "customer")
    p = c.select(
        F.col("c_custkey").alias("id"), F.lit("score_baseline").alias("model"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("c_acctbal") / F.lit(1000.0)))).alias("score"),
    )
    return double_round(bootstrap_auc(p, ["model"], "label", "score", "id", n_boot=100, seed=42))
