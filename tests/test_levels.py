import numpy as np

from wardflow.operators.levels import encode_levels, fit_on_levels, level_coefficients, level_counts, level_table
from wardflow.operators.ml import fit_classifier, load_model, positive_probability, save_model


def rows(spark, n=600):
    rng = np.random.default_rng(5)
    out = [(float(rng.normal()), "abcd"[rng.integers(4)], int(rng.integers(3))) for _ in range(n)]
    out = [(x, a, b, float(rng.random() < 1 / (1 + np.exp(-(x + (a == "c") - 0.7 * (b == 2)))))) for x, a, b in out]
    return spark.createDataFrame(out, "x double, a string, b long, y double").repartition(3)


def test_levels_are_numbered_once_with_the_first_at_zero(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", None), (None, 2), ("é", 10)], "a string, b int")
    got = {(r.variable, r.level): r.position for r in level_table(df, ["a", "b"]).collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("a", "é"), ("b", "1"), ("b", "2"), ("b", "10")}
    assert got["a", "a"] == 0 and got["b", "1"] == 0
    assert sorted(p for (v, _), p in got.items() if v == "a") == [0, 1, 2] and sorted(p for (v, _), p in got.items() if v == "b") == [0, 1, 2]
    assert level_table(df, []).count() == 0 and level_table(df.limit(0), ["a"]).count() == 0


def test_fit_equals_the_one_column_per_level_form(spark):
    df = rows(spark)
    levels = level_table(df, ["a", "b"]).persist()
    counts = level_counts(levels)
    assert counts == {"a": 4, "b": 3}
    model = fit_on_levels(encode_levels(df, levels, counts), "y", ["x"], counts)
    plain = fit_classifier(df, "y", ["x"], ["a", "b"])
    got = {r.feature: r.coefficient for r in level_coefficients(model, ["x"], levels, counts).collect()}
    want = dict(zip(["x", "a=b", "a=c", "a=d", "b=1", "b=2"], plain.stages[-1].coefficients.toArray())) | {"intercept": plain.stages[-1].intercept}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_unseen_and_missing_levels_score_like_the_first_after_a_reload(spark, tmp_path):
    df = rows(spark)
    levels = level_table(df, ["a", "b"]).persist()
    counts = level_counts(levels)
    save_model(fit_on_levels(encode_levels(df, levels, counts), "y", ["x"], counts), str(tmp_path / "m"))
    test = spark.createDataFrame([(0, 0.0, "a", 0), (1, 0.0, "zzz", 99), (2, 0.0, None, None), (3, 0.0, "c", 0)], "id int, x double, a string, b long")
    scored = positive_probability(load_model(str(tmp_path / "m")), encode_levels(test, levels, counts))
    p = [r.predicted_probability for r in scored.orderBy("id").collect()]
    assert p[0] == p[1] == p[2] != p[3]


def test_a_hundred_thousand_levels(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(
        F.concat(F.lit("level "), F.col("id") % 100_000).alias("c"), F.lit("only").alias("one"),
        (F.col("id") % 7 / 7).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    levels = level_table(df, ["c", "one"]).persist()
    counts = level_counts(levels)
    assert counts == {"c": 100_000, "one": 1}
    encoded = encode_levels(df, levels, counts)
    model = fit_on_levels(encoded, "y", ["x"], counts, reg=0.1, max_iter=2)
    first = model.transform(encoded.limit(1)).select("features").first()["features"]
    assert first.size == 100_000 and len(first.indices) <= 2
    named = level_coefficients(model, ["x"], levels, counts)
    assert named.count() == 99_999 + 2 and named.filter("feature = 'c=level 77'").count() == 1
