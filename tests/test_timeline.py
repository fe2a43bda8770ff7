from wardflow.operators.timeline import align_full_join, align_union, flag_in_intervals, observation_window


def brute_flag(points, intervals):
    out = {}
    for pid, stay, t in points:
        hit = False
        for s2, a, b in intervals:
            if stay is not None and t is not None and s2 == stay and a is not None and b is not None and a <= t <= b:
                hit = True
        out[pid] = hit
    return out


def test_interval_flag_matches_brute_force(spark):
    points = [(1, "a", -1.0), (2, "a", 0.0), (3, "a", 10.0), (4, "a", 20.0), (5, "a", 86400.0), (6, "a", 86401.0),
              (7, "b", 5.0), (8, "b", 100000.0), (9, "c", 3.0), (10, None, 3.0), (11, "a", None),
              (12, "b", 200000.0), (13, "a", 90000.0)]
    intervals = [("a", 0.0, 10.0), ("a", 5.0, 20.0),  # overlapping pair (no fan-out)
                 ("a", 86000.0, 86400.0), ("b", 90000.0, 190000.0),  # crosses bucket boundaries
                 ("b", None, 10.0), ("c", 3.0, None), ("z", 0.0, 1e9)]
    pdf = spark.createDataFrame(points, "pid int, stay string, t double")
    idf = spark.createDataFrame(intervals, "stay string, s double, e double")
    for width in (86400.0, 3600.0, 1e7):
        got = {r.pid: r.flag for r in flag_in_intervals(pdf, idf, "stay", "t", "s", "e", out="flag",
                                                         bucket_width=width).collect()}
        assert got == brute_flag(points, intervals), width


def test_union_alignment_equals_full_join(spark):
    a = spark.createDataFrame([("x", 1.0, 10.0), ("x", 2.0, 11.0), ("y", 1.0, 12.0)], "k string, t double, a double")
    b = spark.createDataFrame([("x", 2.0, 20.0), ("z", 5.0, 21.0)], "k string, t double, b double")
    c = spark.createDataFrame([("y", 1.0, 30.0), ("x", 3.0, None)], "k string, t double, c double")
    full = sorted(map(tuple, align_full_join([a, b, c], ["k", "t"]).select("k", "t", "a", "b", "c").collect()))
    union = sorted(map(tuple, align_union([a, b, c], ["k", "t"]).select("k", "t", "a", "b", "c").collect()))
    assert full == union


def test_observation_window_closed_and_clipped(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (86400.0,), (86401.0,)], "t double")
    got = sorted(r.t for r in observation_window(df, "t", 0.0, 86400.0, clip_end=86399.0).collect())
    assert got == [0.0, 86399.0]


def test_interval_flag_hot_entity_random(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n = 6000
    ent = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))  # entity 0 holds a third
    t = rng.random(n) * 30 * 86400
    m = 400
    ient = np.where(rng.random(m) < 1 / 3, 0, rng.integers(1, 40, m))
    s = rng.random(m) * 30 * 86400
    e = s + rng.exponential(6 * 3600, m) * np.where(rng.random(m) < 0.1, 20, 1)  # some span many buckets
    pts = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(ent, t))],
                                "pid long, k long, t double")
    ivs = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(ient, s, e)],
                                "k long, s double, e double")
    want = np.array([np.any((ient == a) & (s <= b) & (b <= e)) for a, b in zip(ent, t)])
    for width in (600.0, 3600.0, 86400.0):
        got = dict(flag_in_intervals(pts, ivs, "k", "t", "s", "e", out="f", bucket_width=width)
                   .select("pid", "f").collect())
        assert np.array_equal(np.array([got[i] for i in range(n)]), want), width


def test_minimum_stay(spark):
    from wardflow.operators.timeline import minimum_stay

    df = spark.createDataFrame([(1, 0.2), (2, 1 / 3), (3, 0.34), (4, None)], "id int, los double")
    assert [r.id for r in minimum_stay(df, "los").collect()] == [3]
