"""Catalogue queries: ROC per condition at max shots, AUC vs shots, distinct
counts, stable head, first match, regex column choice, unseen levels, id-prefix
groups, lenient parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.labels import source_group
from wardflow.operators.metrics import auc, roc_points
from wardflow.operators.report import contains_ci, keep_max
from wardflow.operators.tables import columns_matching, first_match, lenient_double, map_unseen, stable_head
from wardflow.plans.q_features import MEASURES, _meas
from wardflow.plans.q_metrics import ORDER_PRED_SQL, order_predictions
from wardflow.plans.registry import register
from wardflow.plans.shapes import MEASUREMENTS_SQL, TIMELINE_SQL, double_round
from wardflow.operators.features import entity_features
from wardflow.sources.tables import read_table


@register(
    "m10_roc_by_condition",
    f"""
WITH {ORDER_PRED_SQL},
f AS (SELECT * FROM pred WHERE contains(lower(model_args), 'o')),
mx AS (SELECT model, max(num_shots) AS m FROM f GROUP BY model),
k AS (SELECT f.* FROM f JOIN mx ON f.model = mx.model AND f.num_shots = mx.m),
h AS (SELECT model, model_args, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM k GROUP BY 1, 2, 3),
c AS (SELECT model, model_args, score,
             sum(pos) OVER (PARTITION BY model, model_args ORDER BY score DESC) AS cp,
             sum(neg) OVER (PARTITION BY model, model_args ORDER BY score DESC) AS cn,
             sum(pos) OVER (PARTITION BY model, model_args) AS p_tot,
             sum(neg) OVER (PARTITION BY model, model_args) AS n_tot FROM h)
SELECT model, model_args, round(score, 6) AS threshold,
       round(CASE WHEN n_tot > 0 THEN cn / n_tot END, 6) AS fpr, round(CASE WHEN p_tot > 0 THEN cp / p_tot END, 6) AS tpr
FROM c
UNION ALL SELECT DISTINCT model, model_args, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM h""",
)
def m10_roc_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 data: ROC points of each (model, condition) among conditions whose name
    contains 'o' (F6, case-insensitive), restricted to each model's max shots (W5)."""
    p = order_predictions(spark, sf_dir).filter(contains_ci("model_args", "O"))
    kept = keep_max(p, ["model"], "num_shots")
    return double_round(roc_points(kept, ["model", "model_args"], "label", "score"))


@register(
    "m12_auc_vs_shots",
    f"""
WITH {ORDER_PRED_SQL},
h AS (SELECT model, num_shots, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
      FROM pred WHERE model_args = 'BUILDING' GROUP BY 1, 2, 3)
SELECT model, num_shots,
       round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY model, num_shots ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM h)
GROUP BY model, num_shots""",
)
def m12_auc_vs_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_predictions(spark, sf_dir).filter(F.col("model_args") == "BUILDING")
    return double_round(auc(p, ["model", "num_shots"], "label", "score").select("model", "num_shots", "auc"))


@register(
    "a13_distinct_counts",
    """
SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(*) AS n_rows
FROM events GROUP BY event_type""",
)
def a13_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct(F.col("ts").cast("date")).alias("n_days"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@register(
    "o3_head_stable",
    """
SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100""",
)
def o3_head_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped test set (the feature is the cap): 100 documents in stable hash order."""
    return stable_head(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@register(
    "o4_first_match",
    """
SELECT lang, min_by(md5(text), doc_id) AS first_text_md5, min(doc_id) AS first_doc FROM documents GROUP BY lang""",
)
def o4_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    a = first_match(d, ["lang"], "doc_id", F.md5("text"), out="first_text_md5")
    b = d.groupBy("lang").agg(F.min("doc_id").alias("first_doc"))
    return a.join(b, "lang")


@register(
    "p11_select_regex",
    f"""
WITH {TIMELINE_SQL},
{MEASUREMENTS_SQL}
SELECT user_id, round(avg(view), 6) AS view_mean, round(stddev_samp(view), 6) AS view_std,
       round(min(view), 6) AS view_min, round(max(view), 6) AS view_max
FROM meas GROUP BY user_id""",
)
def p11_select_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = entity_features(_meas(spark, sf_dir), "user_id", MEASURES, "stats", name_fmt="{alias}_{stat}")
    return double_round(feats.select("user_id", *columns_matching(feats, "view_")))


@register(
    "p15_unseen_levels",
    """
WITH tr AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS lvl FROM orders WHERE o_orderstatus = 'F'),
te AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, CASE WHEN tr.lvl IS NOT NULL THEN te.c ELSE 'Unknown' END AS customer_level
FROM te LEFT JOIN tr ON te.c = tr.lvl""",
)
def p15_unseen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    train = o.filter(F.col("o_orderstatus") == "F")
    test = o.filter(F.col("o_orderstatus") != "F")
    return map_unseen(test, train, "o_custkey", out="customer_level").select("o_orderkey", "customer_level")


@register(
    "p16_source_group",
    """
SELECT CASE WHEN starts_with(lower(source), 'src1') THEN 'MIMIC' ELSE 'eICU' END AS source_group, count(*) AS n
FROM documents GROUP BY 1""",
)
def p16_source_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy(source_group("source", prefix="src1").alias("source_group")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "x11_lenient_parse",
    """
SELECT event_type, count(TRY_CAST(trim(props) AS DOUBLE)) AS n_numeric_props,
       round(sum(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE)), 6) AS k_sum
FROM events GROUP BY event_type""",
)
def x11_lenient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return double_round(e.groupBy("event_type").agg(
        F.count(lenient_double("props")).alias("n_numeric_props"),
        F.sum(lenient_double(F.regexp_extract("props", r'"k": ([0-9]+)', 1))).alias("k_sum"),
    ))
