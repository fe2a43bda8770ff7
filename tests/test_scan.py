import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardflow.operators.scan import float_bin, hash_rank, join_per_key, prefix_sum


def test_float_bin_is_monotone(spark):
    vals = [-1e9, -3.5, -1.0, -0.25, -1e-9, 0.0, 1e-12, 1e-3, 0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 1e6, 1e300]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select("x", float_bin("x").alias("b")).collect()
    got = sorted(rows, key=lambda r: r.x)
    bins = [r.b for r in got]
    assert bins == sorted(bins)


def test_prefix_sum_matches_single_window(spark):
    rnd = random.Random(7)
    # one hot group with most rows, several small ones
    rows = [("hot", i, rnd.random() * 100, float(rnd.randint(0, 5))) for i in range(3000)]
    rows += [(f"g{g}", i, rnd.random(), 1.0) for g in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id int, x double, v double")
    got = prefix_sum(df, ["g"], ["x", "id"], ["v"], float_bin("x"), inclusive=True)
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    j = got.join(ref, ["g", "id"]).select("cum_v", "ref").collect()
    assert len(j) == len(rows)
    assert all(abs(r.cum_v - r.ref) < 1e-9 for r in j)


def test_prefix_sum_descending_exclusive(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(50)], "g string, x double, v double")
    got = prefix_sum(df, ["g"], ["x"], ["v"], float_bin("x"), descending=True, inclusive=False).collect()
    for r in got:
        assert r.cum_v == 49 - r.x


def test_hash_rank_equals_row_number(spark):
    rows = [(i, f"s{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = hash_rank(df, ["s"], "k", 42, rank_col="rk")
    w = Window.partitionBy("s").orderBy(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.lit("42"))), "k")
    ref = df.withColumn("ref", F.row_number().over(w) - 1)
    j = got.join(ref, ["k", "s"]).collect()
    assert len(j) == 500 and all(r.rk == r.ref for r in j)


def test_last_and_next_value_equal_one_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wardflow.operators.scan import last_value, next_value

    rnd = random.Random(3)
    rows = []
    for g in ("a", "b", None, "hot"):
        for t in rnd.sample(range(4000), 1500 if g == "hot" else 60):
            rows.append((g, float(t), rnd.random() if rnd.random() < 0.1 else None, rnd.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "g string, t double, v double, w int").repartition(5)
    by_bin = F.floor(F.col("t") / 100)
    w = Window.partitionBy("g").orderBy("t")
    want = df.select("*", *[F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"last_{c}") for c in ("v", "w")])
    assert sorted(last_value(df, ["g"], ["t"], ["v", "w"], by_bin).collect(), key=str) == sorted(want.collect(), key=str)
    for down in (False, True):
        order = Window.partitionBy("g").orderBy(F.col("t").desc() if down else F.col("t"))
        want = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("v", "w")])
        assert sorted(next_value(df, ["g"], ["t"], ["v", "w"], by_bin, descending=down).collect(), key=str) == sorted(want.collect(), key=str)
    assert last_value(df.limit(0), ["g"], ["t"], ["v"], by_bin).collect() == []


@pytest.mark.parametrize("lookup", [1, 4, 100_000])
def test_join_per_key_equals_a_plain_join(spark, monkeypatch, lookup):
    monkeypatch.setattr("wardflow.operators.scan.LOOKUP_KEYS", lookup)
    keys = [0.5] * 60 + [1.5] * 30 + [float(k) for k in range(10)] + [None, 99.0]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k double").repartition(3)
    table = rows.filter("k < 99").groupBy("k").count().withColumn("v", F.col("k") * 2)
    got = join_per_key(rows, table, "k", "count", table.count(), 100).select("id", "v").collect()
    assert sorted(map(tuple, got)) == [(i, 2 * k) for i, k in enumerate(keys) if k is not None and k < 99]
