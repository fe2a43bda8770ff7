"""Models on pyspark.ml (ops L1-L8, P12-P15).

Feature preparation is a ``Pipeline`` fitted on the training split only, so
unseen or missing test levels and column alignment (L2) are handled by the
fitted model, not by hand. Scoring user functions (L8) run through
``mapInPandas`` on Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "Unknown"
# a tree fit keeps the partitions of its rows up to FEW_TASKS of them; rows in more are dealt, ROWS_PER_TASK to each
FEW_TASKS = 16
ROWS_PER_TASK = 20_000


def feature_kind(columns: Sequence[str]) -> str:
    """Which feature set a table holds, from its column names (plan time)."""
    names = [c.lower() for c in columns]
    hourly = any(" hour " in n or re.search(r"_d\d+$", n) for n in names)
    stats = any(n.endswith((" mean", "_mean", " std", "_std")) for n in names)
    if hourly or stats:
        return "hourly_stats" if hourly and stats else "hourly" if hourly else "stats"
    if any(n.endswith((" min", "_min", " max", "_max")) for n in names):
        return "minmax"
    return "basic"


def prepare_columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numeric nulls -> 0, categorical nulls -> 'Unknown' (as strings)."""
    return df.select(
        *[c for c in df.columns if c not in set(numeric) | set(categorical)],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in categorical],
    )


def learned_levels(train: DataFrame, categorical: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of each categorical column in the training rows."""
    if not categorical:
        return {}
    row = train.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(categorical)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(categorical)}


def feature_stages(numeric: Sequence[str], levels: dict[str, list[str]], *, out: str = "features") -> tuple[list, list[str]]:
    """L1: one 0/1 column per training level but the first (alphabetical), so the
    design is not collinear with the intercept. A level that training lacks
    reads as the first one (P15). Returns the stages and the feature names."""
    encoded, names, columns = [], list(numeric), []
    for i, (c, values) in enumerate(levels.items()):
        for j, v in enumerate(values[1:]):
            literal = v.replace("\\", "\\\\").replace("'", "\\'")
            columns.append(f"CAST(`{c}` <=> '{literal}' AS DOUBLE) AS `__level_{i}_{j}`")
            encoded.append(f"__level_{i}_{j}")
            names.append(f"{c}={v}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")] if columns else []
    return [*stages, VectorAssembler(inputCols=list(numeric) + encoded, outputCol=out, handleInvalid="keep")], names


def deal_training_rows(train: DataFrame) -> DataFrame:
    """The training rows, evenly in one partition per ``ROWS_PER_TASK`` rows if they come in more than ``FEW_TASKS``.

    Each of a hundred tree levels passes over the rows and shuffles between as
    many tasks as the rows have partitions. Features of few entities come in as
    many partitions as the shuffles of the tables behind them, so a pass would
    cost the square of that number.
    """
    if train.rdd.getNumPartitions() <= FEW_TASKS:
        return train
    return train.repartition(max(1, math.ceil(train.count() / ROWS_PER_TASK)))


def fit_classifier(
    train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], *, estimator: str = "logistic",
    seed: int = 42, reg: float = 0.0,
) -> PipelineModel:
    """Fit a pipeline (features + estimator) on the training rows."""
    if estimator == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=100)
    elif estimator == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol=label, seed=seed)
    else:
        raise ValueError("estimator must be 'logistic' or 'gbt'")
    stages, _ = feature_stages(numeric, learned_levels(train, categorical))
    return Pipeline(stages=stages + [est]).fit(deal_training_rows(train) if estimator == "gbt" else train)


def positive_probability(model: PipelineModel, df: DataFrame, *, out: str = "predicted_probability") -> DataFrame:
    """Score rows: probability of class 1."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


def fit_glm_logit(train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]):
    """L3: binomial GLM with logit link; returns (pipeline model, feature names)."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label,
                                      maxIter=50)
    stages, names = feature_stages(numeric, learned_levels(train, categorical))
    return Pipeline(stages=stages + [glm]).fit(train), names


def coefficient_rows(model: PipelineModel, names: Sequence[str], train: DataFrame) -> list[tuple]:
    """L3 inference: (feature, coefficient, standard error, z, p) per feature and the intercept.

    Standard errors come from the information matrix, summed over the training
    rows by tasks; a feature that is constant or a combination of others uses
    the generalised inverse (its error is that of the part the data determine).
    """
    glm = model.stages[-1]
    k = len(names) + 1
    rows = model.transform(train).select(vector_to_array("features").alias("x"), F.col("prediction").alias("p"))

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), np.ones(b.num_rows)])
                p = b.column(1).to_numpy()
                total += ((p * (1 - p))[:, None] * x).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    info = np.zeros(k * k)
    for r in (rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x"))
              .groupBy("i").agg(F.sum("x").alias("x")).collect()):
        info[r["i"]] = r["x"]
    scale = np.sqrt(np.maximum(np.diag(info.reshape(k, k)), 1e-300))
    inverse = np.linalg.pinv(info.reshape(k, k) / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    errors = np.sqrt(np.maximum(np.diag(inverse), 0.0))
    out = []
    for name, b, se in zip([*names, "intercept"], [*glm.coefficients, glm.intercept], errors):
        z = float(b / se) if se > 0 else float("nan")
        out.append((name, float(b), float(se), z, math.erfc(abs(z) / math.sqrt(2.0))))
    return out


def predictions_table(
    scored: DataFrame, *, model_name: str, model_args: str, num_shots: int, id_col: str, label_col: str,
    prob_col: str = "predicted_probability", ci: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """The one predictions schema of every model: constants, CI bounds, id,
    label (0/1) and probability. ``ci`` holds the two run-level numbers
    (``auc_ci_lower``, ``auc_ci_upper``), attached as constants."""
    lo, hi = ci
    return scored.select(
        F.lit(model_name).alias("model_name"), F.lit(model_args).alias("model_args"),
        F.lit(int(num_shots)).alias("num_shots"),
        F.lit(lo).cast("double").alias("auc_ci_lower"), F.lit(hi).cast("double").alias("auc_ci_upper"),
        F.col(id_col).cast("string").alias("global_icu_stay_id"),
        F.col(label_col).cast("int").alias("actual_label"),
        F.col(prob_col).cast("double").alias("predicted_probability"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A pipeline saved by ``save_model``; it scores like the one that was fitted."""
    return PipelineModel.load(path)


def batch_score(
    df: DataFrame, text_col: str, scorer: Callable[[pd.Series], pd.Series], *, out: str = "answer",
) -> DataFrame:
    """Apply a caller's batch function (text Series -> answer Series) with
    ``mapInPandas``; Spark partitions the rows, Arrow moves them in batches."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b[out] = scorer(b[text_col]).astype("string")
            yield b

    return df.mapInPandas(run, schema)


def length_scorer(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in scorer: '0.xx' from the text length (for tests and demos)."""
    n = texts.fillna("").str.len()
    return (n % 100).map(lambda v: f"{v / 100:.2f}")
