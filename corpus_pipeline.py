"""Training-data pipeline over ``documents``: each stage applies one operator to what its predecessor kept."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardflow.llm import language  # noqa: E402
from wardflow.llm.common import checkpoint, table, written  # noqa: E402, F401
from wardflow.llm.decontaminate import find_contamination  # noqa: E402
from wardflow.llm.lines import dedup_lines  # noqa: E402
from wardflow.llm.mixing import mix  # noqa: E402
from wardflow.llm.near import near_groups  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document goes if its language is unknown or less certain than this
LEAST_CERTAIN = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no certain language, go. Where nothing can be learned, all stay."""
    docs = docs.select(*COLUMNS)
    model = language.fit(language.training_rows(docs), "text", "lang", "doc_id")
    if model is None:
        return docs
    judged = language.predict(docs, model)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay only in the largest doc_id; ``n_chars`` follows. No document goes."""
    done = dedup_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 on five-word shingles, the one with the smallest doc_id stays.

    Rows without a doc_id stay, as no id can name them.
    """
    docs = docs.select(*COLUMNS)
    gone = near_groups(docs, size=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item (or a whole shorter item) go."""
    found = find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in a mixture of the sources (weights: square roots of their sizes)."""
    return mix(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: A learned language model cannot be stated in SQL; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written as Parquet to the shared folder and read back by the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k + 1 < len(STAGES) else docs
    return docs
