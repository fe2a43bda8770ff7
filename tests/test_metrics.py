import random

import numpy as np
from pyspark.sql import functions as F

from wardflow.operators.metrics import (
    auc,
    average_precision_from_histogram,
    bootstrap_auc,
    roc_points,
    score_histogram,
    summary_metrics,
    threshold_metrics,
)


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ap(ys, ps):
    P = sum(ys)
    total = 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        new = sum(1 for y, p in zip(ys, ps) if p == t and y == 1)
        total += new / P * tp / (tp + fp)
    return total


def _preds(spark):
    rnd = random.Random(3)
    rows = []
    for g in ("ties", "cont"):
        for i in range(150):
            y = rnd.randint(0, 1)
            p = round(rnd.random() * 0.6 + 0.3 * y, 1) if g == "ties" else rnd.random() * 0.7 + 0.3 * y
            rows.append((g, i, y, p))
    rows += [("perfect", i, i % 2, float(i % 2)) for i in range(10)]
    rows += [("inverted", i, i % 2, float(1 - i % 2)) for i in range(10)]
    rows += [("constant", i, i % 2, 0.5) for i in range(10)]
    rows += [("oneclass", i, 1, 0.1 * i) for i in range(5)]
    rows += [("nulls", i, i % 2, None if i % 3 == 0 else 0.1 * i) for i in range(12)]
    return rows, spark.createDataFrame(rows, "g string, id long, y int, p double")


def test_auc_and_ap_match_brute_force(spark):
    rows, df = _preds(spark)
    got = {r.g: r.auc for r in auc(df, ["g"], "y", "p").collect()}
    aps = {r.g: r.ap for r in average_precision_from_histogram(score_histogram(df, ["g"], "y", "p"), ["g"]).collect()}
    for g in ("ties", "cont", "perfect", "inverted", "constant", "nulls"):
        ys = [r[2] for r in rows if r[0] == g and r[3] is not None]
        ps = [r[3] for r in rows if r[0] == g and r[3] is not None]
        assert abs(got[g] - brute_auc(ys, ps)) < 1e-12, g
        assert abs(aps[g] - brute_ap(ys, ps)) < 1e-12, g
    assert got["oneclass"] is None
    assert got["perfect"] == 1.0 and got["inverted"] == 0.0 and got["constant"] == 0.5


def test_roc_points_end_at_one(spark):
    _, df = _preds(spark)
    pts = [r for r in roc_points(df, ["g"], "y", "p").collect() if r.g == "ties"]
    assert min(pts, key=lambda r: r.fpr).fpr == 0.0
    last = min(pts, key=lambda r: r.threshold)
    assert last.fpr == 1.0 and last.tpr == 1.0
    assert any(r.threshold == float("inf") for r in pts)


def test_threshold_metrics_inclusive(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    ge = threshold_metrics(df, [], "y", "p", threshold=0.5).first()
    gt = threshold_metrics(df, [], "y", "p", threshold=0.5, inclusive=False).first()
    assert (ge.tp, ge.fp, ge.fn, ge.tn) == (2, 1, 0, 1)
    assert (gt.tp, gt.fp, gt.fn, gt.tn) == (1, 0, 1, 2)
    zero = threshold_metrics(spark.createDataFrame([(0, 0.1)], "y int, p double"), [], "y", "p").first()
    assert zero.precision == 0.0 and zero.f1 == 0.0


def test_bootstrap_ci_covers_point_and_binned_agrees(spark):
    _, df = _preds(spark)
    row = {r.g: r for r in bootstrap_auc(df, ["g"], "y", "p", "id", n_boot=200).collect()}
    binned = {r.g: r for r in bootstrap_auc(df, ["g"], "y", "p", "id", n_boot=200, binned=True).collect()}
    for g in ("ties", "cont"):
        r = row[g]
        assert r.auc_ci_lower <= r.auc <= r.auc_ci_upper
        assert r.n_boot_used == 200
        b = binned[g]
        assert abs(b.auc_ci_lower - r.auc_ci_lower) < 0.06 and abs(b.auc_ci_upper - r.auc_ci_upper) < 0.06
    assert row["oneclass"].n_boot_used == 0 and row["oneclass"].auc is None


def test_bootstrap_block_and_sql_paths_agree(spark):
    _, df = _preds(spark)
    a = {r.g: r for r in bootstrap_auc(df, ["g"], "y", "p", "id", n_boot=150, method="blocks").collect()}
    b = {r.g: r for r in bootstrap_auc(df, ["g"], "y", "p", "id", n_boot=150, method="sql").collect()}
    assert a.keys() == b.keys()
    for g in a:
        for f in ("auc", "auc_mean", "auc_std", "auc_ci_lower", "auc_ci_upper", "n_boot_used"):
            x, y = a[g][f], b[g][f]
            assert (x is None and y is None) or abs(x - y) < 1e-9, (g, f, x, y)


def test_bootstrap_blocks_exact_with_ties_across_chunks(spark):
    from wardflow.operators.bootstrap_blocks import replicate_aucs
    from pyspark.sql import functions as F

    rnd = random.Random(9)
    rows = [("g", i, rnd.randint(0, 1), float(rnd.randint(0, 2))) for i in range(3000)]  # 3 scores, big tie groups
    df = spark.createDataFrame(rows, "g string, id long, y int, p double")
    sql = {r.g: r for r in bootstrap_auc(df, ["g"], "y", "p", "id", n_boot=40, method="sql").collect()}
    base = df.withColumn("__gid", F.lit(7).cast("long"))
    small = replicate_aucs(base, "y", "p", "id", n_boot=40, seed=42, chunk_rows=97)
    dist = small.agg(F.avg("__auc").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert dist.n == sql["g"].n_boot_used
    assert abs(dist.m - sql["g"].auc_mean) < 1e-9


def test_string_ids_null_groups_and_split_ties(spark):
    rnd = random.Random(4)
    rows = [(a, b, f"mimic_{i}", rnd.randint(0, 1), rnd.choice([0.0, 0.0, 0.5, 1.0]))
            for a, b in ((None, "a"), ("a", None), ("a", "a"), (None, None)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, h string, id string, y int, p double").repartition(4)
    key = lambda r: (r.g, r.h)
    blocks = {key(r): r for r in bootstrap_auc(df, ["g", "h"], "y", "p", "id", n_boot=30).collect()}
    sql = {key(r): r for r in bootstrap_auc(df, ["g", "h"], "y", "p", "id", n_boot=30, method="sql").collect()}
    assert set(blocks) == set(sql) == {(None, "a"), ("a", None), ("a", "a"), (None, None)}
    for k, r in blocks.items():
        assert r.auc_std > 0 and abs(r.auc_mean - sql[k].auc_mean) < 1e-12 and abs(r.auc_std - sql[k].auc_std) < 1e-12
    both = {key(r): r.AUC for r in summary_metrics(df, ["g", "h"], "y", "p", "id", n_boot=10).collect()}
    assert set(both) == set(blocks)


def test_infinite_scores_are_ordered(spark):
    rows = [("g", i, int(i > 4), s) for i, s in enumerate([float("-inf"), -1.0, 0.0, float("inf"), 2.0, 1e300, float("inf"), 3.0])]
    df = spark.createDataFrame(rows, "g string, id long, y int, p double")
    ys, ps = [r[2] for r in rows], [r[3] for r in rows]
    assert abs(auc(df, ["g"], "y", "p").first().auc - brute_auc(ys, ps)) < 1e-12
    ap = average_precision_from_histogram(score_histogram(df, ["g"], "y", "p"), ["g"]).first().ap
    assert abs(ap - brute_ap(ys, ps)) < 1e-12


def _exact(df, **kw):
    from wardflow.operators.bootstrap_exact import replicate_aucs_exact
    from wardflow.operators.metrics import score_histogram

    hist = score_histogram(df.withColumn("__gid", F.lit(5).cast("long")), ["__gid"], "y", "p")
    return sorted((r.rep, r["__auc"], r["__drawn"]) for r in replicate_aucs_exact(hist, **kw).collect())


def test_exact_bootstrap_draws_n_rows_whatever_the_partitioning(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    rows = [(int(a), float(np.round(b + 0.5 * a, 1 + k % 2))) for k, (a, b) in enumerate(zip(y, rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "y int, p double")
    got = _exact(df.repartition(7), n_boot=50, seed=3, leaf=8, fanout=4)  # a tree of several levels
    assert got == _exact(df.coalesce(1), n_boot=50, seed=3, leaf=8, fanout=4)
    assert [r[0] for r in got] == list(range(50)) and {r[2] for r in got} == {500}
    assert len({r[1] for r in got}) > 40 and got != _exact(df, n_boot=50, seed=4, leaf=8, fanout=4)


def test_exact_bootstrap_is_distributed_like_a_numpy_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 120)
    p = np.round(rng.normal(size=120) + 0.6 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = np.array([r[1] for r in _exact(df, n_boot=4000, seed=11, leaf=16, fanout=2)])
    want = []
    for _ in range(4000):
        i = rng.integers(0, 120, 120)
        a, b = p[i][y[i] == 1], p[i][y[i] == 0]
        want.append(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
    want = np.array(want)
    assert abs(got.mean() - want.mean()) < 5 * want.std() / 4000**0.5 * 2**0.5
    assert abs(got.std() / want.std() - 1) < 0.06
    width = lambda v: np.subtract(*np.percentile(v, [97.5, 2.5]))
    assert abs(width(got) / width(want) - 1) < 0.08


def test_dealt_counts_follow_a_multinomial():
    from wardflow.operators.bootstrap_exact import deal

    rng = np.random.default_rng(3)
    sizes = [5, 0, 1, 94, 100]
    parts = np.array(list(deal(rng, np.full(20000, 200), sizes)))
    assert (parts.sum(axis=0) == 200).all() and (parts[1] == 0).all()
    for part, size in zip(parts, sizes):
        q = size / 200
        assert abs(part.mean() - size) < 0.1 and abs(part.var() - 200 * q * (1 - q)) < 0.06 * max(size, 1) + 0.05


def test_closed_form_standard_error(spark):
    from wardflow.operators.metrics import auc_standard_error

    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 90), np.round(rng.normal(size=90), 1)
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.5), ("one", 0, 0.1), (None, 1, 0.3)], "g string, y int, p double")
    a, b = p[y == 1], p[y == 0]
    share = (a[:, None] > b) + 0.5 * (a[:, None] == b)
    want = (share.mean(axis=1).var(ddof=1) / len(a) + share.mean(axis=0).var(ddof=1) / len(b)) ** 0.5
    got = {r.g: r.auc_se for r in auc_standard_error(df, ["g"], "y", "p").collect()}
    assert abs(got["g"] - want) < 1e-12 and got["one"] is None and None not in got


def test_reduced_roc_points_equal_brute_force(spark):
    from wardflow.operators.metrics import roc_points

    rng = np.random.default_rng(6)
    y, p = rng.integers(0, 2, 400), np.round(np.exp(rng.normal(size=400) * 3), 3)
    y[150:] = (p[150:] > 1).astype(int)  # long straight runs, across bins
    rows = [("g", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.5)] + [("flat", 0, k / 7) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(3)
    got = roc_points(df, ["g"], "y", "p", drop_intermediate=True).collect()
    full = roc_points(df, ["g"], "y", "p").collect()
    for g in ("g", "one", "flat"):
        scores = sorted({b for h, _, b in rows if h == g}, reverse=True)
        pos = np.array([sum(a for h, a, b in rows if h == g and b == s) for s in scores])
        neg = np.array([sum(1 - a for h, a, b in rows if h == g and b == s) for s in scores])
        keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1) or pos[i] != pos[i + 1] or neg[i] != neg[i + 1]]
        assert sorted(r.threshold for r in got if r.g == g and r.threshold < 1e300) == sorted(scores[i] for i in keep)
    area = lambda pts: np.trapezoid(*zip(*sorted((r.tpr, r.fpr) for r in pts if r.g == "g")))
    assert abs(area(got) - area(full)) < 1e-12 and len(got) < len(full)


def test_reduced_roc_is_one_point_per_turn(spark):
    from wardflow.operators.metrics import roc_points

    df = spark.createDataFrame([(int(k >= 500), k / 1000) for k in range(1000)], "y int, p double").selectExpr("1 AS g", "y", "p")
    got = roc_points(df, ["g"], "y", "p", drop_intermediate=True).collect()
    assert sorted((r.fpr, r.tpr) for r in got) == [(0.0, 0.0), (0.0, 0.002), (0.0, 1.0), (1.0, 1.0)]
