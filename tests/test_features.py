from pyspark.sql import functions as F

from wardflow.operators.features import (
    Measure,
    bucket_long,
    bucket_wide,
    entity_features,
    forward_fill,
    long_with_closing_row,
    mean_arterial_pressure,
    row_sum_null_zero,
    start_stop,
)


def test_wide_forward_fill_equals_window_fill(spark):
    # hours: 0 (hr null), 1 (70), 3 (null), 4 (80); hour 2 has no row; a second stay with one row
    rows = [("s", 0 * 3600.0 + 5, None), ("s", 1 * 3600.0 + 5, 70.0), ("s", 3 * 3600.0 + 5, None),
            ("s", 4 * 3600.0 + 5, 80.0), ("t", 2 * 3600.0, 60.0)]
    df = spark.createDataFrame(rows, "stay string, t double, hr double")
    m = [Measure("HR", "hr", "mean", 1)]
    wide = bucket_wide(df, "stay", "t", m, width=3600.0, n_buckets=6, forward_fill=True).collect()
    got = {r.stay: [r[f"HR Hour {h}"] for h in range(6)] for r in wide}
    assert got["s"] == [None, 70.0, None, 70.0, 80.0, None]  # leading null kept, hour 2 not created
    assert got["t"] == [None, None, 60.0, None, None, None]
    long = bucket_long(df, "stay", "t", m, width=3600.0, bucket_col="h")
    filled = {(r.stay, r.h): r.HR for r in forward_fill(long, "stay", "h", ["HR"]).collect()}
    for stay, vals in got.items():
        for h, v in enumerate(vals):
            if (stay, h) in filled:
                assert filled[(stay, h)] == v


def test_stats_single_row_std_is_null_and_sum_zero(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0), ("b", 4.0, None)], "k string, x double, u double")
    rows = {r.k: r for r in entity_features(df, "k", [Measure("X", "x")], "stats", sums={"urine": "u"}).collect()}
    assert rows["a"]["X std"] is None and rows["a"]["urine"] == 0.0
    assert abs(rows["b"]["X std"] - 2 ** 0.5) < 1e-12 and rows["b"]["urine"] == 5.0


def test_map_fallback_and_row_sum(spark):
    df = spark.createDataFrame([(None, None, 120.0, 60.0, 1.0, None, 3.0)],
                               "a double, b double, s double, d double, u1 double, u2 double, u3 double")
    r = df.select(mean_arterial_pressure(["a", "b"], [("s", "d")]).alias("m"),
                  mean_arterial_pressure(["a", "b"], [("s", "d")], weights=(1.0, 2.0)).alias("t"),
                  row_sum_null_zero("u1", "u2", "u3").alias("u")).first()
    assert r.m == 100.0 and r.t == 80.0 and r.u == 4.0


def test_closing_row_and_start_stop(spark):
    b = spark.createDataFrame([("s", 0, 1.0, 50.0), ("s", 1, None, None)], "k string, h long, v double, age double")
    closing = spark.createDataFrame([("s", 3, True)], "k string, h long, died boolean")
    out = long_with_closing_row(b, closing, "k", "h", ["age"]).orderBy("h").collect()
    assert [r.age for r in out] == [50.0, 50.0, 50.0]
    ss = start_stop(b.withColumn("los", F.lit(30.0)).withColumn("died", F.lit(True)), "k", "h",
                    end_value=F.col("los"), event=F.col("died")).orderBy("time_start").collect()
    assert [(r.time_start, r.time_stop, r.event) for r in ss] == [(0.0, 1.0, False), (1.0, 30.0, True)]


def test_densified_buckets_carry_over_gaps_to_the_end(spark):
    import pytest

    rows = [("s", 5.0, None), ("s", 3605.0, 70.0), ("s", 3 * 3600.0, None), ("s", 4 * 3600.0, 80.0), ("s", 9 * 3600.0, 1.0), ("t", 7200.0, 60.0)]
    df = spark.createDataFrame(rows, "stay string, t double, hr double")
    m = [Measure("HR", "hr", "mean", 1)]
    wide = bucket_wide(df, "stay", "t", m, n_buckets=7, forward_fill=True, densify=True).collect()
    got = {r.stay: [r[f"HR Hour {h}"] for h in range(7)] for r in wide}
    assert got == {"s": [None, 70.0, 70.0, 70.0, 80.0, 80.0, 80.0], "t": [None, None, 60.0, 60.0, 60.0, 60.0, 60.0]}
    with pytest.raises(ValueError, match="densify"):
        bucket_wide(df, "stay", "t", m, densify=True)
    from wardflow.operators.features import densify_buckets
    long = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0), ("a", 9, 3.0)], "e string, b long, v double")
    assert sorted((r.b, r.v) for r in densify_buckets(long, "e", "b", 5).collect()) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (9, 3.0)]
