"""Batch scoring of texts by a caller's model (op L8): concurrent inside tasks, restartable between them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.Series], pd.Series]
WAVE = "scoring_wave"


def score_concurrent(
    df: DataFrame, text_col: str, make_scorer: Callable[[], Scorer], *, out: str = "answer", error: str = "error",
    batch_rows: int = 64, in_flight: int = 4,
) -> DataFrame:
    """Adds ``out`` (the scorer's answer as text) and ``error`` (null, or why there is no answer).

    ``make_scorer`` is called once per task (connections, loaded weights) and
    returns the batch function. At most ``in_flight`` batches of ``batch_rows``
    rows are with the scorer at a time, each in a thread of the task, so a
    scorer must allow concurrent calls; rows keep their order. A batch that
    raises, or whose answers are not one per row, is scored again row by row, and
    only rows that fail alone carry an error. A failing ``make_scorer`` fails the
    task. Null texts reach the scorer as null.
    """
    if out in df.columns or error in df.columns:
        raise ValueError(f"the input has a column named {out} or {error} already")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def answers(scorer: Scorer, texts: pd.Series) -> tuple[list, list]:
        try:
            got = list(scorer(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [None if pd.isna(a) else str(a) for a in got], [None] * len(got)
        except Exception as e:
            if len(texts) > 1:
                parts = [answers(scorer, texts.iloc[[i]]) for i in range(len(texts))]
                return [p[0][0] for p in parts], [p[1][0] for p in parts]
            return [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()

        def finished(part: pd.DataFrame, future) -> pd.DataFrame:
            got, errors = future.result()
            return part.assign(**{out: pd.Series(got, index=part.index, dtype=object), error: pd.Series(errors, index=part.index, dtype=object)})

        pool = ThreadPoolExecutor(in_flight)
        try:
            waiting: deque = deque()
            for b in batches:
                for at in range(0, len(b), batch_rows):
                    part = b.iloc[at:at + batch_rows]
                    if len(waiting) == in_flight:
                        yield finished(*waiting.popleft())
                    waiting.append((part, pool.submit(answers, scorer, part[text_col].reset_index(drop=True))))
            while waiting:
                yield finished(*waiting.popleft())
        finally:
            pool.shutdown(cancel_futures=True)

    return df.mapInPandas(run, schema)


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether a write into ``folder`` was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def score_in_waves(
    df: DataFrame, id_col: str, text_col: str, make_scorer: Callable[[], Scorer], path: str, *, waves: int = 8,
    out: str = "answer", error: str = "error", batch_rows: int = 64, in_flight: int = 4, partitions: int | None = None,
) -> DataFrame:
    """L8, restartable: the rows of ``score_concurrent``, scored wave by wave into the shared folder ``path``.

    The first call stores the input under ``path``, split into ``waves`` parts by
    the hash of the id, so later calls score the same rows whatever became of
    ``df``. Each wave is a job that scores its part straight into Parquet: a
    finished task's answers are on shared storage and are not scored again when
    its executor is lost. A committed wave is kept: a call after a failure or a
    driver restart goes on with the first one that is not. ``path`` belongs to
    one input, one scorer and one set of parameters. ``partitions`` spreads a wave over that many
    tasks (by id and text; default: as the files split). Repeated ids, null ids and empty inputs
    are allowed.
    """
    spark = df.sparkSession
    if WAVE in df.columns:
        raise ValueError(f"the input has a column named {WAVE} already")
    store, scored = f"{path}/input", f"{path}/scored"
    if not _written(spark, store):
        wave = F.pmod(F.xxhash64(F.col(id_col)), F.lit(waves)).cast("int")
        df.withColumn(WAVE, wave).write.mode("overwrite").partitionBy(WAVE).parquet(store)
    nullable = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    rows = spark.read.schema(T.StructType([*nullable, T.StructField(WAVE, T.IntegerType())])).parquet(store)
    for k in range(waves):
        folder = f"{scored}/{WAVE}={k}"
        if not _written(spark, folder):
            part = rows.filter(F.col(WAVE) == k).drop(WAVE)
            part = part.repartition(partitions, id_col, text_col) if partitions else part
            score_concurrent(part, text_col, make_scorer, out=out, error=error, batch_rows=batch_rows, in_flight=in_flight).write.mode(
                "overwrite").parquet(folder)
    answered = [T.StructField(out, T.StringType()), T.StructField(error, T.StringType())]
    return spark.read.schema(T.StructType([*nullable, *answered, T.StructField(WAVE, T.IntegerType())])).parquet(scored).drop(WAVE)
