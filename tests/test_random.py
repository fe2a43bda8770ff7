import numpy as np
from pyspark.sql import functions as F

from wardflow.functions.random import key_bits, mixed_uniform, mixed_uniform_np, poisson_cdf, poisson_weight
from wardflow.session import cut_lineage


def test_mixed_uniform_spark_equals_numpy(spark):
    keys = [0, 1, 2, 17, 2**31 - 2, 2**40 + 5, 2**60 - 1, 123456789012]
    df = spark.createDataFrame([(k, r) for k in keys for r in (0, 1, 999)], "k long, r int")
    got = {(x.k, x.r): x.u for x in df.select("k", "r", mixed_uniform(F.col("k"), F.col("r"), 42).alias("u")).collect()}
    ref = mixed_uniform_np(np.array(keys), np.array([0, 1, 999]), 42)
    for i, k in enumerate(keys):
        for j, r in enumerate((0, 1, 999)):
            assert got[(k, r)] == ref[i, j]


def test_poisson_weights_are_poisson_and_uncorrelated():
    u = mixed_uniform_np(np.random.default_rng(1).integers(0, 2**60, 20000), np.arange(50), 42)
    assert 0.0 < u.min() and u.max() < 1.0
    w = np.searchsorted(np.array(poisson_cdf()), u, side="left")
    assert abs(w.mean() - 1.0) < 0.01 and abs(w.var() - 1.0) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005
    c_rep = np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]  # neighbouring replicates
    c_key = np.corrcoef(w[:-1, :].ravel(), w[1:, :].ravel())[0, 1]  # neighbouring keys
    assert abs(c_rep) < 0.01 and abs(c_key) < 0.01


def test_key_bits_of_any_type_and_far_apart_ids(spark):
    ids = [7 + i * (2**31 - 1) for i in range(40)]
    df = spark.createDataFrame([(i, f"mimic_{i}") for i in ids] + [(None, None)], "k long, s string")
    rows = df.select(key_bits(F.col("k")).alias("k"), key_bits(F.col("s")).alias("s")).collect()
    assert all(0 <= r.k < 2**60 for r in rows)
    for name in ("k", "s"):
        u = mixed_uniform_np(np.array([r[name] for r in rows[:-1]]), np.arange(50), 42)
        assert len(np.unique(u[:, 0])) == 40 and u.mean(axis=0).std() > 0.01


def test_poisson_weight_column_matches_search(spark):
    us = [0.0001, 0.3678, 0.3679, 0.5, 0.7358, 0.95, 0.999999]
    got = [r.w for r in spark.createDataFrame([(u,) for u in us], "u double").select(
        poisson_weight(F.col("u")).alias("w")).collect()]
    assert got == list(np.searchsorted(np.array(poisson_cdf()), np.array(us), side="left"))


def test_cut_lineage(spark):
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in cut.collect()) == [2 * i for i in range(10)]
