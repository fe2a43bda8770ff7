import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from wardflow.operators import survival as S
from wardflow.operators.survival import concordance, fit_cox, survival_at


def numpy_cox(t, e, X, pen, efron=True):
    n, p = X.shape
    mu, sd = X.mean(0), X.std(0, ddof=1)
    Z = (X - mu) / sd
    b = np.zeros(p)
    for _ in range(100):
        eta = Z @ b
        w = np.exp(eta)
        g = np.zeros(p)
        H = np.zeros((p, p))
        for tt in np.unique(t[e == 1]):
            risk, own = t >= tt, (t == tt) & (e == 1)
            sums = lambda k: (w[k].sum(), (w[k, None] * Z[k]).sum(0), (w[k, None, None] * Z[k, :, None] * Z[k, None, :]).sum(0))
            r, o = sums(risk), sums(own)
            g += Z[own].sum(0)
            for l in range(own.sum()):
                f = l / own.sum() if efron else 0.0
                s0, s1, s2 = (a - f * c for a, c in zip(r, o))
                g -= s1 / s0
                H += s2 / s0 - np.outer(s1, s1) / s0 ** 2
        step = np.linalg.solve(H / n + pen * np.eye(p), g / n - pen * b)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b / sd, np.sqrt(np.diag(np.linalg.inv(H + n * pen * np.eye(p)))) / sd


def cox_rows(rnd, times):
    rows = []
    for i in range(300):
        x1, x2 = rnd.gauss(0, 1), rnd.random() * 10
        t = rnd.expovariate(float(np.exp(0.5 * x1 - 0.1 * x2)))
        t = {"tied": round(t * 10) / 10 + 0.1, "same": 2.0, "untied": t, "mixed": round(t * 10) / 10 if i % 3 else t}[times]
        rows.append((i, t, rnd.random() < 0.7, x1, x2))
    return rows


@pytest.mark.parametrize("times", ["tied", "same", "untied", "mixed"])
@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_matches_numpy_newton(spark, times, ties, monkeypatch):
    rows = cox_rows(random.Random(5), times)
    df = spark.createDataFrame(rows, "id long, t double, e boolean, x1 double, x2 double")
    arr = np.array([(r[1], int(r[2]), r[3], r[4]) for r in rows])
    ref, se = numpy_cox(arr[:, 0], arr[:, 1], arr[:, 2:], 0.1, ties == "efron")
    m = fit_cox(df, "t", "e", ["x1", "x2"], penalizer=0.1, ties=ties)
    assert m.converged and np.allclose(m.beta, ref, atol=1e-6) and np.allclose(m.se, se, atol=1e-6)
    if times == "tied":  # the form for many covariates
        monkeypatch.setattr(S, "COLUMNS", 0)
        assert np.allclose(fit_cox(df, "t", "e", ["x1", "x2"], penalizer=0.1, ties=ties).beta, m.beta, atol=1e-9)


def test_efron_sums_in_blocks():
    whole = S.efron_sums(1000, 5000.0, 700.0, True)
    assert np.allclose(S.efron_sums(1000, 5000.0, 700.0, True, step=7), whole)
    assert np.allclose(whole[1], sum(1 / (5000 - k / 1000 * 700) for k in range(1000)))
    assert np.allclose(S.efron_sums(3, 5.0, 2.0, False), [3 * np.log(5), 3 / 5, 0, 3 / 25, 0, 0])


def test_hazard_as_of_takes_the_last_time_at_or_before(spark):
    hazard = spark.createDataFrame([(1.0, 0.1), (2.5, 0.3), (2.6, 0.35), (40.0, 2.0)], "time double, cum_hazard double")
    horizons = [0.5, 1.0, 2.49, 2.5, 2.55, 3.0, 39.9, 40.0, 1e9, -1.0, None, float("nan"), 2.5]
    df = spark.createDataFrame([(k, h, 7.0) for k, h in enumerate(horizons)], "id long, h double, time double").repartition(3)
    got = {r.id: r.cum_hazard for r in S.hazard_as_of(df, hazard, "h").collect()}
    want = [0.0, 0.1, 0.1, 0.3, 0.3, 0.35, 0.35, 2.0, 2.0, 0.0, None, None, 0.3]
    assert got == dict(enumerate(want))
    assert {r.cum_hazard for r in S.hazard_as_of(df.filter("id < 10"), hazard.limit(0), "h").collect()} == {0.0}


def test_held_out_risk_equals_numpy(spark):
    rows = cox_rows(random.Random(9), "tied")
    df = spark.createDataFrame(rows, "id long, t double, e boolean, x1 double, x2 double").withColumn("h", F.col("id") % 5 + 0.5)
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    m = fit_cox(train, "t", "e", ["x1", "x2"])
    got = {r.id: r.risk for r in S.predicted_risk(test, train, m, "t", "e", "h").collect()}
    z = {r[0]: float(((np.array(r[3:]) - m.mean) / m.scale) @ m.beta_std) for r in rows}
    learn = [r for r in rows if r[0] % 4]
    for i in got:
        h0 = 0.0
        for u in sorted({r[1] for r in learn if r[2] and r[1] <= i % 5 + 0.5}):
            h0 += sum(r[2] and r[1] == u for r in learn) / sum(np.exp(z[r[0]]) for r in learn if r[1] >= u)
        assert abs(got[i] - (1 - np.exp(-h0 * np.exp(z[i])))) < 1e-9
    assert len(got) == 75


def brute_c(t, e, r):
    num = den = 0.0
    for i in range(len(t)):
        if not e[i]:
            continue
        for j in range(len(t)):
            if t[j] > t[i] or (t[j] == t[i] and not e[j]):
                den += 1
                num += 1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0
    return num / den


def test_concordance_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [(float(rnd.randint(1, 40)), rnd.random() < 0.6, float(rnd.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(rows, "t double, e boolean, r double")
    got = concordance(df, "t", "e", "r").first().concordance
    t, e, r = zip(*rows)
    assert abs(got - brute_c(t, e, r)) < 1e-12


def test_event_and_censored_row_at_one_time_are_comparable(spark):
    df = spark.createDataFrame([(1.0, True, 3.0), (1.0, False, 1.0), (2.0, False, 5.0)], "t double, e boolean, r double")
    row = concordance(df, "t", "e", "r").first()
    assert row.comparable_pairs == 2 and row.concordance == 0.5


def test_cox_with_continuous_times_and_missing_covariates(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.expovariate(1.0), rnd.random() < 0.6, None if i % 4 == 0 else rnd.gauss(1, 1), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t double, e boolean, x1 double, x2 double").repartition(4)
    m = fit_cox(df, "t", "e", ["x1", "x2"], penalizer=0.1)
    arr = np.array([(r[1], int(r[2]), r[3] or 0.0, r[4]) for r in rows])
    assert np.allclose(m.beta, numpy_cox(arr[:, 0], arr[:, 1], arr[:, 2:], 0.1)[0], atol=1e-6)
    risk = [r.risk for r in survival_at(df, m, "t", "e", 1.0).collect()]
    assert len(risk) == 300 and all(x is not None and 0 <= x <= 1 for x in risk)


def test_cox_with_many_covariates(spark):
    rng = np.random.default_rng(8)
    x, p = rng.normal(size=(400, 60)), 60
    t = rng.exponential(np.exp(-x[:, 0]))
    df = spark.createDataFrame([(float(a), bool(i % 3), *map(float, r)) for i, (a, r) in enumerate(zip(t, x))],
                               "t double, e boolean, " + ", ".join(f"x{i} double" for i in range(p)))
    m = fit_cox(df, "t", "e", [f"x{i}" for i in range(p)], penalizer=0.1, max_iter=3, tol=1e-3)
    assert m.beta[0] > 5 * np.abs(m.beta[1:]).mean() and np.isfinite(m.se).all()


def test_cox_rows_do_not_move_by_time(spark, monkeypatch):
    plans, row_sums = [], S._row_sums

    def seen(rows, beta):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return row_sums(rows, beta)

    df = spark.createDataFrame(cox_rows(random.Random(5), "tied"), "id long, t double, e boolean, x1 double, x2 double").withColumn(
        "t", F.least("t", F.lit(0.5)))  # most rows share the last time
    monkeypatch.setattr(S, "_row_sums", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = fit_cox(df, "t", "e", ["x1", "x2"], tol=1e-6)
        assert plans and all("BroadcastHashJoin" in p for p in plans)
        # more times than the lookup holds: the frequent ones are still looked up
        monkeypatch.setattr("wardflow.operators.scan.LOOKUP_KEYS", 3)
        assert np.allclose(fit_cox(df, "t", "e", ["x1", "x2"], tol=1e-6).beta, want.beta, atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("cells", [7, 40, 250_000])
@pytest.mark.parametrize("risks", [1, 4, 1000])
def test_concordance_over_partitions_matches_brute_force(spark, monkeypatch, cells, risks):
    monkeypatch.setattr(S, "CELLS", cells)
    rnd = random.Random(cells + risks)
    rows = [(float(rnd.randint(1, 30)), rnd.random() < 0.5, rnd.randrange(risks) / 7 - 1) for _ in range(150)] * 2
    got = concordance(spark.createDataFrame(rows, "t double, e boolean, r double"), "t", "e", "r").first()
    assert abs(got.concordance - brute_c(*zip(*rows))) < 1e-12


def test_concordance_groups_hold_cells_not_rows(spark, monkeypatch):
    sizes, pairs = [], S._cell_pairs
    monkeypatch.setattr(S, "_cell_pairs", lambda cells, levels: (sizes.append(cells.count()), pairs(cells, levels))[1])
    df = spark.range(20_000).select((F.col("id") % 3).cast("double").alias("t"), (F.col("id") % 2 == 0).alias("e"),
                                    (F.col("id") % 5).cast("double").alias("r"))
    assert concordance(df, "t", "e", "r").first().comparable_pairs > 0 and sizes == [30]


def test_no_event_and_no_row(spark):
    df = spark.createDataFrame([(1.0, False, 1.0), (2.0, False, 2.0), (None, True, 1.0)], "t double, e boolean, r double")
    assert S.concordance(df, "t", "e", "r").select("concordant_pairs", "comparable_pairs").first() == (None, 0.0)
    assert concordance(df.limit(0), "t", "e", "r").first() == (None, None, None)


@pytest.mark.parametrize("cached", [False, True])
def test_cox_reads_its_rows_once(spark, cached):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(cox_rows(random.Random(5), "tied"), "id long, t double, e boolean, x1 double, x2 double")
    df = df.mapInArrow(counted, df.schema)
    if cached:
        df = df.persist()
    m = fit_cox(df, "t", "e", ["x1", "x2"], max_iter=2)
    if cached:  # the caller's copy is kept for the hazard
        assert S.baseline_cumulative_hazard(df, m, "t", "e").count() and df.is_cached
    assert read.value == 300
