"""Catalogue queries: descriptive table, long metrics, result grid, reference
line, max-shots and best flags, model/condition labels, file-name labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.labels import (
    CONDITIONS,
    PROMPT_MODEL_IDS,
    condition_label,
    condition_label_sql,
    file_labels,
    model_label,
    model_label_sql,
)
from wardflow.operators.metrics import auc, bootstrap_auc, threshold_metrics
from wardflow.operators.report import flag_best, keep_max, long_metrics, result_table, sort_by_label, table_one
from wardflow.plans.q_metrics import ORDER_PRED_SQL, bootstrap_sql, order_predictions
from wardflow.plans.registry import register
from wardflow.plans.shapes import STATIC_SQL, double_round, static_info
from wardflow.sources.tables import read_table

# --- A14 -----------------------------------------------------------------------------------------

_A14_SQL = f"""
WITH {STATIC_SQL},
g AS (SELECT region AS grp, segment, CAST(outcome AS VARCHAR) AS outcome, acctbal FROM st
      UNION ALL SELECT 'Overall', segment, CAST(outcome AS VARCHAR), acctbal FROM st),
cat AS (SELECT grp, 'segment' AS variable, segment AS level FROM g UNION ALL SELECT grp, 'outcome', outcome FROM g),
cc AS (SELECT grp, variable, level, count(*) AS n FROM cat GROUP BY 1, 2, 3)
SELECT grp AS "group", 'n' AS variable, NULL AS level, count(*) AS n, NULL::DOUBLE AS pct, NULL::DOUBLE AS mean,
       NULL::DOUBLE AS sd, 0 AS n_missing FROM g GROUP BY grp
UNION ALL
SELECT grp, variable, level, n, round(100.0 * n / sum(n) FILTER (WHERE level IS NOT NULL) OVER (PARTITION BY grp, variable), 6),
       NULL, NULL, coalesce(sum(n) FILTER (WHERE level IS NULL) OVER (PARTITION BY grp, variable), 0)
FROM cc WHERE level IS NOT NULL
UNION ALL
SELECT grp, 'acctbal', NULL, count(acctbal), NULL, round(avg(acctbal), 6), round(stddev_samp(acctbal), 6),
       count(*) FILTER (WHERE acctbal IS NULL) FROM g GROUP BY grp"""


@register("a14_table_one", _A14_SQL)
def a14_table_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = static_info(spark, sf_dir).withColumn("outcome", F.col("outcome").cast("string"))
    return double_round(table_one(st, "region", ["segment", "outcome"], ["acctbal"]))


# --- M11 long metrics --------------------------------------------------------------------------

G3 = ["model", "model_args", "num_shots"]


def _point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_predictions(spark, sf_dir)
    a = auc(p, G3, "label", "score").select(*G3, "auc")
    t = threshold_metrics(p, G3, "label", "score", threshold=0.5)
    return a.join(t, G3, "inner").select(*G3, "auc", "accuracy", "f1", "precision", "recall")


_POINT_SQL = f"""
WITH {ORDER_PRED_SQL},
h AS (SELECT model, model_args, num_shots, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
      FROM pred GROUP BY 1, 2, 3, 4),
a AS (SELECT model, model_args, num_shots,
             CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) END AS auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model, model_args, num_shots ORDER BY score
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM h)
      GROUP BY 1, 2, 3),
t AS (SELECT model, model_args, num_shots,
             count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn
      FROM pred GROUP BY 1, 2, 3),
pm AS (SELECT a.model, a.model_args, a.num_shots, a.auc,
              (tp + tn) / (tp + fp + fn + tn) AS accuracy,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
       FROM a JOIN t USING (model, model_args, num_shots))"""


@register(
    "m11_long_metrics",
    _POINT_SQL + """
SELECT model, model_args, num_shots, metric, round(score, 6) AS score FROM (
""" + "\n  UNION ALL\n".join(
        f"  SELECT model, model_args, num_shots, '{m}' AS metric, {m} AS score FROM pm"
        for m in ("auc", "accuracy", "f1", "precision", "recall")
    ) + ")",
)
def m11_long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double_round(long_metrics(_point_metrics(spark, sf_dir), G3, ["auc", "accuracy", "f1", "precision", "recall"]))


# --- M13 result grid ------------------------------------------------------------------------------

MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHOT_LADDER = list(range(1995, 2003))


def _col(m: str) -> str:
    return "m_" + m.lower().replace("-", "_").replace(" ", "_")


@register(
    "m13_result_table",
    bootstrap_sql(ORDER_PRED_SQL, "model, model_args, num_shots", "id", 100).split("\nSELECT pt.model")[0]
    + """,
res AS (SELECT pt.model, pt.model_args, pt.num_shots, pt.auc, dist.lo, dist.hi
        FROM pt LEFT JOIN dist USING (model, model_args, num_shots)),
fl AS (SELECT *, abs(auc - max(auc) OVER (PARTITION BY model_args, num_shots)) < 1e-8 AS best,
              CASE WHEN auc IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL
                   THEN printf('%.3f', auc) || ' [' || printf('%.3f', lo) || '--' || printf('%.3f', hi) || ']'
                   ELSE '--' END AS cell FROM res),
fc AS (SELECT model_args, num_shots, model,
              CASE WHEN coalesce(best, false) AND cell <> '--' THEN '\\textbf{' || cell || '}' ELSE cell END AS cell FROM fl),
grid AS (SELECT DISTINCT c.c_mktsegment AS model_args, CAST(s.y AS INTEGER) AS num_shots
         FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
         JOIN (SELECT unnest(""" + str(SHOT_LADDER) + """) AS y) s ON true)
SELECT grid.model_args, grid.num_shots, """
    + ", ".join(
        f"coalesce(max(CASE WHEN fc.model = '{m}' THEN fc.cell END), '--') AS {_col(m)}" for m in MODELS
    )
    + """
FROM grid LEFT JOIN fc ON grid.model_args = fc.model_args AND grid.num_shots = fc.num_shots
GROUP BY grid.model_args, grid.num_shots""",
)
def m13_result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_predictions(spark, sf_dir)
    boot = bootstrap_auc(p, G3, "label", "score", "id", n_boot=100, seed=42)
    # complete grid: every condition (segment with orders) x every value of the shot ladder
    conditions = p.select("model_args").distinct()
    grid = conditions.select("model_args", F.explode(F.array(*[F.lit(y) for y in SHOT_LADDER])).alias("num_shots"))
    table = result_table(boot, grid, ["model_args", "num_shots"], "model", MODELS)
    return table.select("model_args", "num_shots", *[F.col(m).alias(_col(m)) for m in MODELS])


# --- M14 reference line ---------------------------------------------------------------------------

@register(
    "m14_reference_line",
    _POINT_SQL + """,
ref AS (SELECT c.c_mktsegment AS model_args,
               avg(CAST(c.c_acctbal < 0 AS INTEGER)) AS ref_event_rate, avg(1.0 / (1.0 + exp(c.c_acctbal / 1000.0))) AS ref_mean_score
        FROM customer c GROUP BY 1)
SELECT pm.model, pm.model_args, pm.num_shots, round(pm.auc, 6) AS auc, round(ref.ref_event_rate, 6) AS ref_event_rate,
       round(ref.ref_mean_score, 6) AS ref_mean_score
FROM pm LEFT JOIN ref ON pm.model_args = ref.model_args""",
)
def m14_reference_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-baseline figures per condition attached to every metrics row of that condition."""
    c = read_table(spark, sf_dir, "customer")
    ref = c.groupBy(F.col("c_mktsegment").alias("model_args")).agg(
        F.avg((F.col("c_acctbal") < 0).cast("int")).alias("ref_event_rate"),
        F.avg(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("c_acctbal") / F.lit(1000.0)))).alias("ref_mean_score"),
    )
    pm = _point_metrics(spark, sf_dir).select(*G3, "auc")
    return double_round(pm.join(ref, "model_args", "left"))


_BASE = ["auc", "accuracy", "f1", "precision", "recall"]


@register(
    "m14_baseline_metrics",
    _POINT_SQL + """,
ref AS (SELECT model_args, num_shots, auc AS base_auc, accuracy AS base_accuracy, f1 AS base_f1, precision AS base_precision,
               recall AS base_recall FROM pm WHERE model = '1-URGENT')
SELECT pm.model, pm.model_args, pm.num_shots, round(pm.auc, 6) AS auc, round(base_auc, 6) AS base_auc,
       round(base_accuracy, 6) AS base_accuracy, round(base_f1, 6) AS base_f1, round(base_precision, 6) AS base_precision,
       round(base_recall, 6) AS base_recall
FROM pm LEFT JOIN ref USING (model_args, num_shots)""",
)
def m14_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five metrics of one baseline model beside every metrics row of the same condition."""
    pm = _point_metrics(spark, sf_dir).select(*G3, *_BASE)
    ref = pm.filter(F.col("model") == "1-URGENT").select("model_args", "num_shots", *[F.col(m).alias(f"base_{m}") for m in _BASE])
    return double_round(pm.select(*G3, "auc").join(ref, ["model_args", "num_shots"], "left"))


# --- W5 / W6 --------------------------------------------------------------------------------------

@register(
    "w5_max_shots",
    f"""
WITH {ORDER_PRED_SQL},
m AS (SELECT model, max(num_shots) AS mx FROM pred GROUP BY model)
SELECT p.model, p.num_shots, count(*) AS n_rows FROM pred p JOIN m ON p.model = m.model AND p.num_shots = m.mx
GROUP BY p.model, p.num_shots""",
)
def w5_max_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_max(order_predictions(spark, sf_dir), ["model"], "num_shots")
    return kept.groupBy("model", "num_shots").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "w6_best_flag",
    _POINT_SQL + """
SELECT model, model_args, num_shots, round(auc, 6) AS auc,
       coalesce(abs(auc - max(auc) OVER (PARTITION BY model_args, num_shots)) < 1e-8, false) AS is_best
FROM pm""",
)
def w6_best_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = _point_metrics(spark, sf_dir).select(*G3, "auc")
    return double_round(flag_best(pm, ["model_args", "num_shots"], "auc"))


# --- X6 / X7 labels over names built from table rows ------------------------------------------

# Display-name stems used to build run names from part rows.
_NAME_STEMS = ["Logistic-Regression", "XGBoost", "CatBoost", "LightGBM", "TabPFN", "KaplanMeier", "CoxPH",
               "Qwen/Qwen3-8B", "mlfoundations/tabula-8b", "google/medgemma-4b-it", "oasis"]
_ARG_STEMS = ["baseline_" + c for c in CONDITIONS] + ["tabpfn-" + c for c in CONDITIONS] + ["other"]


def _run_names(part: DataFrame) -> DataFrame:
    stems = F.array(*[F.lit(s) for s in _NAME_STEMS])
    args = F.array(*[F.lit(s) for s in _ARG_STEMS])
    return part.select(
        "p_partkey",
        F.concat(F.element_at(stems, (F.col("p_partkey") % len(_NAME_STEMS) + 1).cast("int")), F.lit(" "),
                 F.col("p_brand")).alias("model_name"),
        F.concat(F.element_at(args, (F.col("p_partkey") % len(_ARG_STEMS) + 1).cast("int")), F.lit("_"),
                 F.col("p_type")).alias("model_args"),
    )


def _list_sql(items: list[str]) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


@register(
    "x6_x7_labels",
    f"""
WITH r AS (
  SELECT p_partkey,
         {_list_sql(_NAME_STEMS)}[p_partkey % {len(_NAME_STEMS)} + 1] || ' ' || p_brand AS model_name,
         {_list_sql(_ARG_STEMS)}[p_partkey % {len(_ARG_STEMS)} + 1] || '_' || p_type AS model_args
  FROM part)
SELECT p_partkey, {model_label_sql("model_name")} AS model_label, {condition_label_sql("model_args")} AS condition_label
FROM r""",
)
def x6_x7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _run_names(read_table(spark, sf_dir, "part"))
    return r.select("p_partkey", model_label("model_name").alias("model_label"),
                    condition_label("model_args").alias("condition_label"))


@register(
    "o2_sorted_by_label",
    f"""
WITH r AS (
  SELECT {_list_sql(_NAME_STEMS)}[p_partkey % {len(_NAME_STEMS)} + 1] || ' ' || p_brand AS model_name, p_size AS num_shots, p_retailprice
  FROM part)
SELECT {model_label_sql("model_name")} AS model_label, num_shots, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price
FROM r GROUP BY 1, 2 ORDER BY 1, 2""",
)
def o2_sorted_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by (derived model label, shots), sorted by both."""
    part = read_table(spark, sf_dir, "part")
    names = _run_names(part).join(part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    runs = names.groupBy(model_label("model_name").alias("model_label"), F.col("p_size").alias("num_shots")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))
    return sort_by_label(runs, F.col("model_label"), then=["num_shots"])


# --- X8 condition of the few-shot tabular files -----------------------------------------------

_TABULAR_ARGS = """CASE o_orderkey % 4 WHEN 0 THEN 'tabpfn' WHEN 1 THEN 'tabpfn_' || lower(replace(o_orderpriority, ' ', '-'))
  WHEN 2 THEN 'tabpfn_hourly-stats' ELSE 'tabpfn-minmax' END"""


@register(
    "x8_tabular_conditions",
    f"""
WITH a AS (SELECT o_orderkey, CAST(year(o_orderdate) - 1995 AS INTEGER) AS num_shots, {_TABULAR_ARGS} AS args FROM orders)
SELECT o_orderkey, 'tabpfn' AS family, num_shots AS shots,
       CASE WHEN args = 'tabpfn' THEN 'basic' WHEN args = 'tabpfn-minmax' THEN 'basic_minmax'
            ELSE regexp_replace(substr(args, 8), '-', '_', 'g') END AS condition
FROM a""",
)
def x8_tabular_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition and shots of the third file family, from the rows themselves."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.year("o_orderdate") - 1995).alias("num_shots"), F.expr(_TABULAR_ARGS).alias("args"))
    lab = file_labels(F.lit("tabpfn_results.csv"), F.col("args"), F.col("num_shots"))
    return o.select("o_orderkey", *[lab[k].alias(k) for k in ("family", "shots", "condition")])


# --- X8 file-name labels ------------------------------------------------------------------------

def _file_names(orders: DataFrame) -> DataFrame:
    ids = F.array(*[F.lit(s) for s in PROMPT_MODEL_IDS])
    conds = F.array(*[F.lit(s) for s in CONDITIONS])
    mid = F.element_at(ids, (F.col("o_orderkey") % 3 + 1).cast("int"))
    cond = F.element_at(conds, (F.col("o_orderkey") % 6 + 1).cast("int"))
    kind = F.col("o_orderkey") % 5
    shots = F.col("o_orderkey") % 129
    name = (
        F.when(kind == 0, F.concat(F.lit("llm_"), mid, F.lit("_"), cond, F.lit("_"), shots.cast("string"), F.lit("-shot_results.csv")))
        .when(kind == 1, F.concat(F.lit("tabpfn_"), cond, F.lit("_"), shots.cast("string"), F.lit("-shot_results.csv")))
        .when(kind == 2, F.concat(F.lit("baseline_xgboost_"), cond, F.lit("_results.csv")))
        .when(kind == 3, F.lit("baseline_logistic_results.csv"))
        .otherwise(F.concat(F.lit("notes_"), F.col("o_orderpriority"), F.lit(".csv")))
    )
    return orders.select("o_orderkey", name.alias("file_name"))


def _x8_sql() -> str:
    llm_re = r"^llm_(" + "|".join(PROMPT_MODEL_IDS) + r")_(.+)_([0-9]+)-shot$"
    cond_re = r"_(" + "|".join(sorted(CONDITIONS, key=len, reverse=True)) + r")$"
    name = f"""CASE o_orderkey % 5
      WHEN 0 THEN 'llm_' || {_list_sql(PROMPT_MODEL_IDS)}[o_orderkey % 3 + 1] || '_' || {_list_sql(CONDITIONS)}[o_orderkey % 6 + 1] || '_' || CAST(o_orderkey % 129 AS VARCHAR) || '-shot_results.csv'
      WHEN 1 THEN 'tabpfn_' || {_list_sql(CONDITIONS)}[o_orderkey % 6 + 1] || '_' || CAST(o_orderkey % 129 AS VARCHAR) || '-shot_results.csv'
      WHEN 2 THEN 'baseline_xgboost_' || {_list_sql(CONDITIONS)}[o_orderkey % 6 + 1] || '_results.csv'
      WHEN 3 THEN 'baseline_logistic_results.csv'
      ELSE 'notes_' || o_orderpriority || '.csv' END"""
    return f"""
WITH f AS (SELECT o_orderkey, {name} AS file_name FROM orders),
s AS (SELECT o_orderkey, file_name, regexp_replace(file_name, '_results\\.csv$', '') AS stem FROM f),
l AS (SELECT *, CASE WHEN starts_with(stem, 'llm_') AND regexp_matches(stem, '{llm_re}') THEN 'llm'
                     WHEN starts_with(stem, 'tabpfn') THEN 'tabpfn'
                     WHEN starts_with(stem, 'baseline_') THEN 'baseline' END AS family FROM s)
SELECT o_orderkey, file_name, family,
       CASE WHEN family = 'llm' THEN regexp_extract(stem, '{llm_re}', 1) END AS model_id,
       CASE WHEN family = 'llm' THEN regexp_extract(stem, '{llm_re}', 2)
            WHEN family = 'baseline' THEN 'baseline_' || CASE WHEN regexp_extract(stem, '{cond_re}', 1) <> ''
                                                            THEN regexp_extract(stem, '{cond_re}', 1) ELSE 'basic' END END AS condition,
       CASE WHEN family = 'llm' THEN CAST(regexp_extract(stem, '{llm_re}', 3) AS INTEGER) END AS shots
FROM l WHERE family IS NOT NULL"""


@register("x8_file_labels", _x8_sql())
def x8_file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _file_names(read_table(spark, sf_dir, "orders"))
    lab = file_labels("file_name")
    return f.select("o_orderkey", "file_name", *[v.alias(k) for k, v in lab.items()]).filter(F.col("family").isNotNull())
