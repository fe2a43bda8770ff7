"""Catalogue queries: models on the per-entity feature table.

Fits are rows-only checks (model output depends on the optimiser); the scoring
hook L8 with the deterministic length scorer has an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.text import parse_probability, parse_probability_sql
from wardflow.operators.levels import encode_levels, fit_on_levels, level_coefficients, level_counts, level_table
from wardflow.operators.metrics import bootstrap_auc
from wardflow.operators.ml import (
    batch_score,
    coefficient_rows,
    feature_kind,
    fit_classifier,
    fit_glm_logit,
    length_scorer,
    load_model,
    positive_probability,
    predictions_table,
    prepare_columns,
    save_model,
)
from wardflow.operators.sampling import class_balanced_sample
from wardflow.operators.scoring import score_in_waves
from wardflow.plans.q_files import shared_folder
from wardflow.plans.q_timeline import flagship
from wardflow.plans.registry import register
from wardflow.sources.tables import read_table

CATEGORICAL = ["segment", "region"]


def feature_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    f = flagship(spark, sf_dir).withColumn("label", F.col("outcome").cast("int"))
    # acctbal defines the outcome, so it is not a feature
    numeric = [c for c in f.columns if c not in {"user_id", "split", "outcome", "label", "acctbal", *CATEGORICAL}]
    assert feature_kind(numeric) == "stats"
    # fits make several passes over the (one row per entity) table: keep it cached
    return prepare_columns(f, numeric, CATEGORICAL).persist(), numeric


def _predictions(spark, sf_dir, scored: DataFrame, model_name: str, model_args: str, num_shots: int) -> DataFrame:
    """L7 table of a fitted model; the run's bootstrap CI (two numbers, one small
    job after the fit) is attached as constants."""
    scored = scored.persist()
    ci = bootstrap_auc(scored.withColumn("__g", F.lit(model_name)), ["__g"], "label", "predicted_probability",
                       "user_id", n_boot=100, seed=42).select("auc_ci_lower", "auc_ci_upper").first()
    bounds = (ci["auc_ci_lower"], ci["auc_ci_upper"]) if ci is not None else (None, None)
    return predictions_table(scored, model_name=model_name, model_args=model_args, num_shots=num_shots,
                             id_col="user_id", label_col="label", ci=bounds)


@register("l3_logistic")
def l3_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, numeric = feature_table(spark, sf_dir)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    model, _ = fit_glm_logit(train, "label", numeric, CATEGORICAL)
    scored = model.transform(test).withColumnRenamed("prediction", "predicted_probability")
    return _predictions(spark, sf_dir, scored, "logistic_glm", "baseline_stats", 0)


@register("l3_coefficients")
def l3_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 inference table: coefficient, standard error, z and p per named feature (checked against IRLS in the tests)."""
    data, numeric = feature_table(spark, sf_dir)
    train = data.filter(F.col("split") == "train")
    model, names = fit_glm_logit(train, "label", numeric, CATEGORICAL)
    rows = coefficient_rows(model, names, train)
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, z double, p double")


@register("l4_gbt")
def l4_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, numeric = feature_table(spark, sf_dir)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    model = fit_classifier(train, "label", numeric, CATEGORICAL, estimator="gbt", seed=42)
    return _predictions(spark, sf_dir, positive_probability(model, test), "gbt", "baseline_stats", 0)


@register("l5_saved_model")
def l5_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline is saved to the shared folder, read back and scores the test rows (compared with the fitted one in the tests)."""
    data, numeric = feature_table(spark, sf_dir)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    path = shared_folder(spark, "model")
    save_model(fit_classifier(train, "label", numeric, CATEGORICAL, estimator="logistic", reg=0.1), path)
    return _predictions(spark, sf_dir, positive_probability(load_model(path), test), "logistic_saved", "stats", 0)


@register("l6_few_shot_fit")
def l6_few_shot_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, numeric = feature_table(spark, sf_dir)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    shots = 8
    sample = class_balanced_sample(train, "label", "user_id", shots, seed=42).drop("sample_rank")
    model = fit_classifier(sample, "label", numeric, CATEGORICAL, estimator="logistic", reg=0.1)
    return _predictions(spark, sf_dir, positive_probability(model, test), "few_shot_logistic", "stats", shots)


@register(
    "l8_batch_score",
    f"""
SELECT doc_id, printf('%.2f', (length(text) % 100) / 100.0) AS answer,
       {parse_probability_sql("printf('%.2f', (length(text) % 100) / 100.0)")} AS probability
FROM documents""",
)
def l8_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = batch_score(d, "text", length_scorer, out="answer")
    return scored.select("doc_id", "answer", parse_probability("answer").alias("probability"))


LEVEL_COLUMNS = ["l_partkey", "l_linestatus", "l_suppkey"]


@register(
    "l1_level_table",
    """
WITH l AS (SELECT DISTINCT 'l_partkey' AS variable, CAST(l_partkey AS VARCHAR) AS level FROM lineitem
           UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem
           UNION ALL SELECT DISTINCT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem),
m AS (SELECT *, level = min(level) OVER (PARTITION BY variable) AS reference FROM l WHERE level IS NOT NULL)
SELECT variable, level, CASE WHEN reference THEN 0
       ELSE row_number() OVER (PARTITION BY variable, reference ORDER BY md5(level || ':42'), level) END AS position FROM m""",
)
def l1_level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered levels of three columns, of which parts and suppliers grow with the data."""
    return level_table(read_table(spark, sf_dir, "lineitem").select(*LEVEL_COLUMNS), LEVEL_COLUMNS)


@register("l1_level_coefficients")
def l1_level_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic fit with one sparse entry per row and column of levels; coefficients by level name (checked in the tests)."""
    numeric, categorical = ["l_quantity", "l_discount"], ["l_linestatus", "l_suppkey"]
    rows = read_table(spark, sf_dir, "lineitem").select(
        *[F.col(c).cast("double").alias(c) for c in numeric], *categorical, (F.col("l_returnflag") == "R").cast("double").alias("label"))
    levels = level_table(rows, categorical).persist()
    counts = level_counts(levels)
    model = fit_on_levels(encode_levels(rows, levels, counts), "label", numeric, counts, reg=0.01, max_iter=20)
    return level_coefficients(model, numeric, levels, counts)


MAX_TEXT = 2000


def limited_length_scorer():
    """A stand-in model with a context limit: scores like ``length_scorer``, raises on texts beyond ``MAX_TEXT``."""
    def score(texts):
        if texts.fillna("").str.len().max() > MAX_TEXT:
            raise ValueError("text too long")
        return length_scorer(texts)

    return score


@register(
    "l8_scored_in_waves",
    f"""
SELECT doc_id, CASE WHEN length(text) <= {MAX_TEXT} THEN printf('%.2f', (length(text) % 100) / 100.0) END AS answer,
       CASE WHEN length(text) > {MAX_TEXT} THEN 'ValueError: text too long' END AS error FROM documents""",
)
def l8_scored_in_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored in restartable waves by a model that refuses long ones; the other rows of a refused batch are answered."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_in_waves(d, "doc_id", "text", limited_length_scorer, shared_folder(spark, "scored"), waves=4).select("doc_id", "answer", "error")
