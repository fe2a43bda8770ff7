import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardflow.functions.labels import file_labels, label_01
from wardflow.sources.tables import (
    PREDICTIONS_SCHEMA,
    check_feature_options,
    parse_id_text,
    parse_records,
    read_with_provenance,
    require_columns,
    require_rows,
    write_csv,
    write_id_text,
    write_text,
)


def _csv(path, header, rows):
    with open(path, "w") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_multi_file_read_with_provenance(spark):
    d = tempfile.mkdtemp(prefix="wardflow-test-")
    header = "model_name,model_args,num_shots,auc_ci_lower,auc_ci_upper,global_icu_stay_id,actual_label,predicted_probability"
    # the prompt-model file puts the id first: columns are matched by header name
    _csv(os.path.join(d, "llm_qwen_3_8b_hourly_stats_4-shot_results.csv"),
         "global_icu_stay_id,model_name,model_args,num_shots,auc_ci_lower,auc_ci_upper,actual_label,predicted_probability",
         [("s1", "Qwen", "qwen-hourly_stats", "4", "0.5", "0.7", "1", "0.9")])
    _csv(os.path.join(d, "baseline_xgboost_minmax_results.csv"), header,
         [("XGB", "x", "0", "0.4", "0.8", "s2", "True", "0.2")])
    open(os.path.join(d, "baseline_cox_results.csv"), "w").close()  # empty file adds nothing
    groups = [os.path.join(d, "llm*shot_results.csv"), os.path.join(d, "baseline*results.csv")]
    df = read_with_provenance(spark, groups, PREDICTIONS_SCHEMA)
    lab = file_labels("file_name")
    rows = sorted(df.select("global_icu_stay_id", label_01("actual_label").alias("y"),
                            *[v.alias(k) for k, v in lab.items()]).collect())
    assert [tuple(r) for r in rows] == [("s1", 1, "llm", "qwen_3_8b", "hourly_stats", 4),
                                        ("s2", 1, "baseline", None, "baseline_minmax", None)]


def test_files_of_one_glob_may_order_their_columns_differently(spark):
    from pyspark.sql import types as T

    d = tempfile.mkdtemp(prefix="wardflow-test-")
    _csv(os.path.join(d, "r1.csv"), "a,b", [("1", "2"), ("3", "4")])
    _csv(os.path.join(d, "r2.csv"), "b,a", [("20", "10")])
    _csv(os.path.join(d, "r3.csv"), "b", [("30",)])
    open(os.path.join(d, "r4.csv"), "w").close()
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    rows = sorted(((r.file_name, r.a, r.b) for r in read_with_provenance(spark, [os.path.join(d, "*.csv")], schema).collect()), key=str)
    assert rows == [("r1.csv", 1, 2), ("r1.csv", 3, 4), ("r2.csv", 10, 20), ("r3.csv", None, 30)]
    assert read_with_provenance(spark, [os.path.join(d, "r4.csv")], schema).collect() == []


def test_text_round_trip(spark):
    d = tempfile.mkdtemp(prefix="wardflow-test-")
    recs = spark.createDataFrame([("a1", "Patient ID: a1. Age: 3 years."), ("b2", "x\ty")], "id string, t string")
    write_text(recs.select("t"), "t", os.path.join(d, "rec"))
    write_id_text(recs, "id", "t", os.path.join(d, "tsv"))
    back = parse_records(spark.read.text(os.path.join(d, "rec"))).collect()
    assert [(r.id, r.text) for r in back] == [("a1", "Patient ID: a1. Age: 3 years.")]
    tsv = sorted((r.id, r.text) for r in parse_id_text(spark.read.text(os.path.join(d, "tsv"))).collect())
    assert tsv == [("a1", "Patient ID: a1. Age: 3 years."), ("b2", "x\ty")]  # split at the first tab only
    write_csv(spark.createDataFrame([(0.125, "k")], "x double, k string"), os.path.join(d, "csv"), decimals=2)
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).first().x == "0.12"


def test_input_checks(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        require_rows(df.filter(F.col("a") > 5))
    with pytest.raises(ValueError):
        check_feature_options(hourly=True, minmax=True)
    with pytest.raises(ValueError):
        check_feature_options(forward_fill=True)


def test_write_sorted_and_shape(spark):
    from wardflow.sources.tables import shape, write_sorted

    d = tempfile.mkdtemp(prefix="wardflow-test-")
    df = spark.createDataFrame([("b", 2.0), ("a", 5.0), ("a", 1.0), ("b", 1.0)], "k string, t double")
    write_sorted(df, os.path.join(d, "o"), "k", "t", partitions=2)
    back = spark.read.parquet(os.path.join(d, "o"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert shape(df) is None and shape(df, debug=True) == (4, 2)


def test_malformed_lines_go_to_the_quarantine(spark, tmp_path):
    from pyspark.sql import types as T

    from wardflow.sources.tables import read_csv_checked

    (tmp_path / "a.csv").write_text('id,name,v\n1,x,0.5\n2,y\n3,z,0.5,9\n4,"open,0.1\n5,w,high\n\n6,"a,b",\n7,"say ""hi""",1e3\n')
    (tmp_path / "b.csv").write_text('v,id\n0.25,8\nlow,9\n')
    (tmp_path / "c.csv").write_text("")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])
    good, bad = read_csv_checked(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], schema)
    assert sorted(map(tuple, good.collect())) == [(1, "x", 0.5, "a.csv"), (6, "a,b", None, "a.csv"), (7, 'say "hi"', 1000.0, "a.csv"), (8, None, 0.25, "b.csv")]
    assert sorted(map(tuple, bad.collect())) == [
        ("a.csv", "2,y", "number of fields"), ("a.csv", "3,z,0.5,9", "number of fields"), ("a.csv", '4,"open,0.1', "unclosed quote"),
        ("a.csv", "5,w,high", "value"), ("b.csv", "low,9", "value")]
    none = read_csv_checked(spark, str(tmp_path / "c.csv"), schema)
    assert [d.count() for d in none] == [0, 0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_align_and_attach_without_exchange(spark, tmp_path):
    from wardflow.operators.timeline import align_full_join, align_on_spine, attach, key_spine
    from wardflow.sources.tables import write_bucketed

    keys = ["e", "t"]
    plain = [spark.createDataFrame([(e, t, float(e + t + k)) for e in range(7) for t in range(9) if (e * t + k) % (k + 2) == 0] + [(None, 1, 0.5)],
                                   f"e long, t long, v{k} double") for k in range(3)]
    side = spark.createDataFrame([(e, f"s{e}") for e in range(0, 7, 2)], "e long, s string")

    def stored(df, on, tag):
        return write_bucketed(df, f"bucket_test_{tag}", str(tmp_path / tag), on, buckets=4)

    series = [stored(p, keys, f"series{k}") for k, p in enumerate(plain)]
    rows, static = stored(plain[0], ["e"], "rows"), stored(side, ["e"], "static")
    spine = stored(key_spine(series, keys), keys, "spine")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        aligned, attached = align_on_spine(spine, series, keys), attach(rows, static, "e")
        assert "Exchange" not in plan_of(aligned) and "Exchange" not in plan_of(attached)
        assert "Exchange" in plan_of(align_full_join(plain, keys))
        order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert order(aligned) == order(align_full_join(plain, keys).dropna(subset=keys))
        assert order(attached) == order(attach(plain[0], side, "e"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(list((tmp_path / "rows").glob("*.parquet"))) <= 4


def test_counts_come_from_the_write(spark, tmp_path):
    from wardflow.sources.tables import write_counted

    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id")).alias("x")).repartition(5)
    done = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    facts = write_counted(df, str(tmp_path / "a"), bad=F.col("id") >= 990, nulls=["x", "id"])
    jobs = len(done.getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert facts == {"rows": 1000, "bad_rows": 10, "null_share.x": 0.25, "null_share.id": 0.0}
    assert jobs <= 2 and spark.read.parquet(str(tmp_path / "a")).count() == 1000
    with pytest.raises(ValueError, match="at least 1"):
        write_counted(df.filter("id < 0"), str(tmp_path / "b"), nulls=["x"])
    assert write_counted(df.filter("id < 0"), str(tmp_path / "c"), nulls=["x"], min_rows=0)["null_share.x"] == 0.0


def test_models_are_fitted_and_applied_after_counted_writes(spark, tmp_path):
    from wardflow.operators.ml import fit_classifier, positive_probability
    from wardflow.sources.tables import write_counted

    df = spark.createDataFrame([(k, k % 7 / 7.0, "ab"[k % 2], float(k % 3 == 0)) for k in range(60)], "id long, x double, c string, y double")
    assert write_counted(df, str(tmp_path / "a"))["rows"] == 60
    model = fit_classifier(df, "y", ["x"], ["c"], estimator="logistic", reg=0.1)
    assert len(positive_probability(model, df).collect()) == 60
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and not spark.catalog.listTables("global_temp")
