import numpy as np

from wardflow.operators.ml import coefficient_rows, fit_classifier, fit_glm_logit, positive_probability, prepare_columns


def irls(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        info = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(info, x.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def data(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), "abc"[rng.integers(3)], "xy"[rng.integers(2)]) for _ in range(400)]
    rows = [(n, a, b, int(rng.random() < 1 / (1 + np.exp(-(0.8 * n + (a == "b") - 0.5 * (b == "y")))))) for n, a, b in rows]
    return rows, spark.createDataFrame(rows, "n double, a string, b string, y int").repartition(3)


def test_coefficients_match_irls_with_the_first_level_dropped(spark):
    rows, df = data(spark)
    model, names = fit_glm_logit(df, "y", ["n"], ["a", "b"])
    got = coefficient_rows(model, names, df)
    assert [r[0] for r in got] == ["n", "a=b", "a=c", "b=y", "intercept"]
    x = np.array([[n, a == "b", a == "c", b == "y", 1] for n, a, b, _ in rows], dtype=float)
    beta, se = irls(x, np.array([r[3] for r in rows]))
    assert np.allclose([r[1] for r in got], beta, atol=1e-4) and np.allclose([r[2] for r in got], se, atol=1e-4)
    assert all(0 <= r[4] <= 1 for r in got)


def test_unseen_and_missing_levels_score_like_the_first(spark):
    _, df = data(spark)
    model = fit_classifier(prepare_columns(df, ["n"], ["a", "b"]), "y", ["n"], ["a", "b"])
    test = prepare_columns(spark.createDataFrame([(0.0, "a", "x"), (0.0, "zzz", "x"), (None, None, "x")], "n double, a string, b string"), ["n"], ["a", "b"])
    p = [r.predicted_probability for r in positive_probability(model, test).collect()]
    assert p[0] == p[1] == p[2]


def test_saved_model_scores_like_the_fitted_one(spark, tmp_path):
    from wardflow.operators.ml import fit_classifier, load_model, positive_probability, save_model

    df = spark.createDataFrame([(k, k % 7 / 7.0, "ab"[k % 2], float(k % 3 == 0)) for k in range(60)], "id long, x double, c string, y double")
    for kind in ("logistic", "gbt"):
        model = fit_classifier(df, "y", ["x"], ["c"], estimator=kind, reg=0.1)
        save_model(model, str(tmp_path / kind))
        score = lambda m: [r[0] for r in positive_probability(m, df).orderBy("id").select("predicted_probability").collect()]  # noqa: E731, B023
        assert score(load_model(str(tmp_path / kind))) == score(model)


def test_tree_passes_follow_the_rows_not_the_partitions_they_come_in(spark):
    df = spark.createDataFrame([(k, k % 7 / 7.0, "ab"[k % 2], float(k % 3 == 0)) for k in range(60)], "id long, x double, c string, y double").repartition(40)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gbt", "gbt")
    try:
        fit_classifier(df, "y", ["x"], ["c"], estimator="gbt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in status.getJobIdsForGroup("gbt") for s in status.getJobInfo(j).stageIds}
    # a stage that was skipped, as its shuffle files were there, completed no task
    ran = [info.numTasks for info in map(status.getStageInfo, stages) if info and info.numCompletedTasks]
    # only the reads of the given rows run in its 40 partitions, none of the passes
    assert ran and sum(n >= 40 for n in ran) <= 8
