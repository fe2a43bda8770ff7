from wardflow.operators.ml import feature_kind
from wardflow.operators.report import categorical_columns
from wardflow.operators.tables import columns_matching, first_match, lenient_double, map_unseen, stable_head


def test_feature_kind():
    assert feature_kind(["GCS", "HR"]) == "basic"
    assert feature_kind(["HR min", "HR max"]) == "minmax"
    assert feature_kind(["HR mean", "HR std", "HR min"]) == "stats"
    assert feature_kind(["HR Hour 0", "HR Hour 1"]) == "hourly"
    assert feature_kind(["HR Hour 0", "HR mean"]) == "hourly_stats"


def test_columns_matching_escapes_literal_prefix(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`Temp (C) max` double, `Temp (C) min` double, `TempX` double")
    assert columns_matching(df, "Temp (C)") == ["Temp (C) max", "Temp (C) min"]
    assert columns_matching(df, r"^Temp \(C\) m", literal_prefix=False) == ["Temp (C) max", "Temp (C) min"]


def test_categorical_detection_excludes_group(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "s"), ("b", 2, 0.7, "t"), ("c", 1, 0.9, "s")],
                               "name string, k int, x double, src string")
    assert categorical_columns(df, ["name", "k", "x", "src"], max_levels=3, exclude=["src"]) == ["name", "k"]


def test_unseen_head_first_lenient(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, c string")
    got = dict(map_unseen(test, train, "c").select("i", "c").collect())
    assert got == {1: "a", 2: "Unknown", 3: "Unknown"}
    df = spark.range(50).withColumnRenamed("id", "k")
    h1 = [r.k for r in stable_head(df, "k", 5).collect()]
    h2 = [r.k for r in stable_head(df.repartition(7), "k", 5).collect()]
    assert h1 == h2 and len(h1) == 5
    fm = first_match(spark.createDataFrame([("g", 3, "c"), ("g", 1, "a")], "g string, o int, v string"),
                     ["g"], "o", "v", out="first").first()
    assert fm.first == "a"
    vals = spark.createDataFrame([(" 1.5 ",), ("x",), (None,)], "s string").select(lenient_double("s").alias("v"))
    assert [r.v for r in vals.collect()] == [1.5, None, None]
