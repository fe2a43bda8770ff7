"""Category levels as a table (ops P13-P15, L1): any number of levels, none of them in the driver.

``level_table`` numbers the training levels, ``encode_levels`` joins the numbers
to rows, and the pipeline of ``fit_on_levels`` makes one sparse vector entry per
row and column of them. For a handful of levels ``ml.feature_stages`` (one 0/1
column per level, names in the pipeline) stays the plainer way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators.scan import hash_rank


def level_table(train: DataFrame, categorical: Sequence[str], *, seed: int = 42) -> DataFrame:
    """(variable, level, position) of every non-null level in the training rows.

    Position 0 is a column's first level in code point order, the reference that
    gets no coefficient; the others are numbered from 1 in ``md5(level:seed)``
    order, by bins, so a column of any number of levels is spread over tasks.
    The table is used several times: store it, or persist it.
    """
    if not categorical:
        return train.sparkSession.createDataFrame([], "variable string, level string, position long")
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical])
    levels = train.select(F.inline(cells)).filter("level IS NOT NULL").distinct()
    first = levels.groupBy("variable").agg(F.min("level").alias("__first"))
    marked = levels.join(first, "variable")
    others = hash_rank(marked.filter("level <> __first").select("variable", "level"), ["variable"], "level", seed, rank_col="position")
    return others.withColumn("position", F.col("position") + 1).unionByName(
        first.select("variable", F.col("__first").alias("level"), F.lit(0).cast("long").alias("position")))


def level_counts(levels: DataFrame) -> dict[str, int]:
    """Number of levels per column (one number per column in the driver)."""
    return {r["variable"]: r["n"] for r in levels.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}


def _index(c: str) -> str:
    return f"__index_{c}"


def encode_levels(df: DataFrame, levels: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Adds the index of each column's level; a missing level and one that training lacks read as the first.

    The index is position - 1, and the last index for the reference, which the
    encoder leaves out. One join per column on the level, broadcast once the
    table is measured small, else sorted and merged with hot levels split.
    """
    for c, n in sorted(counts.items()):
        own = levels.filter(F.col("variable") == c).select(F.col("level").alias("__level"), F.col("position").alias("__position"))
        joined = df.join(own, F.col(c).cast("string") == F.col("__level"), "left")
        index = F.when(F.col("__position") > 0, F.col("__position") - 1).otherwise(F.lit(n - 1)).cast("double")
        df = joined.withColumn(_index(c), index).drop("__level", "__position")
    return df


def fit_on_levels(
    encoded: DataFrame, label: str, numeric: Sequence[str], counts: dict[str, int], *, reg: float = 0.0, max_iter: int = 100
) -> PipelineModel:
    """Logistic regression over rows of ``encode_levels``. The fitted pipeline scores rows
    encoded with the same table and is saved and loaded like any other (``ml.save_model``)."""
    columns = [c for c, n in sorted(counts.items()) if n > 1]
    stages, vectors = [], []
    if columns:
        vectors = [f"__vector_{c}" for c in columns]
        stages.append(OneHotEncoder(inputCols=[_index(c) for c in columns], outputCols=vectors, dropLast=True))
    stages.append(VectorAssembler(inputCols=[*numeric, *vectors], outputCol="features", handleInvalid="keep"))
    stages.append(LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter))
    return Pipeline(stages=stages).fit(encoded)


def level_coefficients(model: PipelineModel, numeric: Sequence[str], levels: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(feature, coefficient): numeric columns, ``column=level`` for every level but the reference, and the intercept.

    The model's vector is in the driver as Spark fits it; the names are joined to its slots by Spark.
    """
    spark, fitted = levels.sparkSession, model.stages[-1]
    values = fitted.coefficients.toArray().tolist()
    plain = [*zip(numeric, values), ("intercept", float(fitted.intercept))]
    slots, at = [], len(numeric)
    for c, n in sorted(counts.items()):
        slots += [(c, k + 1, values[at + k]) for k in range(n - 1)]
        at += n - 1
    out = spark.createDataFrame(plain, "feature string, coefficient double")
    if slots:
        named = spark.createDataFrame(slots, "variable string, position long, coefficient double").join(levels, ["variable", "position"])
        out = out.unionByName(named.select(F.concat_ws("=", "variable", "level").alias("feature"), "coefficient"))
    return out
