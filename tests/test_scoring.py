import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardflow.operators.scoring import score_concurrent, score_in_waves


@pytest.fixture
def upper():
    def make():
        return lambda batch: batch.str.upper()

    return make


def texts(spark, n, parts=2):
    return spark.createDataFrame([(k, f"t{k}") for k in range(n)], "id long, text string").repartition(parts, "id")


def test_batches_overlap_up_to_the_bound_and_set_up_runs_once_a_task(spark):
    def slow():
        import time
        import uuid

        task = uuid.uuid4().hex

        def score(batch):
            start = time.time()
            time.sleep(0.15)
            return pd.Series([f"{task},{start},{time.time()}"] * len(batch))

        return score

    got = score_concurrent(texts(spark, 64).withColumn("part", F.spark_partition_id()), "text", slow, batch_rows=4, in_flight=3).collect()
    assert len(got) == 64 and all(r.error is None for r in got)
    by_part = {}
    for r in got:
        task, start, end = r.answer.split(",")
        by_part.setdefault(r.part, []).append((task, float(start), float(end)))
    for calls in by_part.values():
        assert len({c[0] for c in calls}) == 1
        calls = set(calls)
        most = max(sum(s <= at < e for _, s, e in calls) for _, at, _ in calls)
        assert 2 <= most <= 3


def test_only_rows_that_fail_alone_carry_an_error(spark):
    def picky():
        def score(batch):
            if (batch == "t3").any():
                raise RuntimeError("no answer")
            got = batch.str.upper()
            return got.iloc[:-1] if (batch == "t5").any() else got

        return score

    got = {r.id: r for r in score_concurrent(texts(spark, 20), "text", picky, batch_rows=8).collect()}
    assert len(got) == 20
    assert (got[3].answer, got[3].error) == (None, "RuntimeError: no answer")
    assert (got[5].answer, got[5].error) == (None, "ValueError: 0 answers to 1 texts")
    assert all((r.answer, r.error) == (f"T{k}", None) for k, r in got.items() if k not in (3, 5))


def test_nulls_empty_tables_and_clashing_names(spark, upper):
    df = spark.createDataFrame([(None, None), (None, ""), (1, "a"), (1, "a")], "id long, text string")
    assert sorted([r.answer for r in score_concurrent(df, "text", upper).collect()], key=str) == ["", "A", "A", None]
    assert score_concurrent(df.limit(0), "text", upper).count() == 0
    with pytest.raises(ValueError, match="answer"):
        score_concurrent(df.withColumn("answer", F.lit(1)), "text", upper)


def test_finished_waves_are_kept_after_a_failure(spark, tmp_path):
    path, calls = str(tmp_path / "run"), str(tmp_path / "calls")
    os.makedirs(calls)

    def logged(tag, broken=()):
        def make():
            def score(batch):
                for t in batch:
                    with open(f"{calls}/{t}", "a") as f:
                        f.write(tag)
                return batch + f" {tag}"

            from pyspark import TaskContext

            if broken and TaskContext.get().stageId() >= 0 and len(os.listdir(calls)) >= broken[0]:
                raise RuntimeError("model gone")
            return score

        return make

    df = texts(spark, 80)
    with pytest.raises(Exception, match="model gone"):
        score_in_waves(df, "id", "text", logged("a", (1,)), path, waves=4, partitions=1)
    first = set(os.listdir(calls))
    assert 0 < len(first) < 80
    got = {r.text: r.answer for r in score_in_waves(df.limit(0), "id", "text", logged("b"), path, waves=4, partitions=1).collect()}
    assert set(got) == {f"t{k}" for k in range(80)}
    assert all(got[t] == f"{t} {'a' if t in first else 'b'}" for t in got)
    assert all(len(open(f"{calls}/{t}").read()) == 1 for t in got)


def test_waves_take_repeated_and_null_ids_and_empty_tables(spark, upper, tmp_path):
    df = spark.createDataFrame([(None, "x"), (None, None), (1, "a"), (1, "a"), (2, "")], "id long, text string")
    got = score_in_waves(df, "id", "text", upper, str(tmp_path / "a"), waves=3)
    assert got.columns == ["id", "text", "answer", "error"]
    assert sorted([(r.id, r.answer) for r in got.collect()], key=repr) == sorted([(None, "X"), (None, None), (1, "A"), (1, "A"), (2, "")], key=repr)
    assert score_in_waves(df.limit(0), "id", "text", upper, str(tmp_path / "b"), waves=3).count() == 0
