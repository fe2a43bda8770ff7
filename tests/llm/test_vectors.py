from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.llm import clusters as C
from wardflow.llm import topk as K
from wardflow.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, score int, whitened string"
NAN, INF = float("nan"), float("inf")


def made(n, width, seed, levels=None):
    """Vectors, a third of them equal, with some that take no part, repeated rows and rows without an id."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)) * np.linspace(0.05, 0.4, width)
    if levels:
        v = np.round(v * levels) / levels
    v[: n // 3] = v[0]
    rows = [(k, list(map(float, x))) for k, x in enumerate(v)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, rows[41][1]), (None, rows[3][1]), (None, rows[50][1])]
    return rows + [(-1, None), (-2, [NAN] + [0.0] * (width - 1)), (-3, [INF] * width), (-4, [None] * width)]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)


def integers(rows, scale, add=0):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [(i, [int(np.floor(scale * c)) + add for c in v]) for i, v in good]


def brute_top(rows, k):
    x = integers(rows, 64)
    out = []
    for q, qv in {(i, tuple(v)) for i, v in x if i is not None and i % 20 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in x if i != q))[:k]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [None, 4])
def test_top_k_equals_brute_force(spark, levels):
    rows = made(400, 16, 1, levels)
    got = K.top_k(table_of(spark, rows), F.col("vec_id") % 20 == 0, k=7, shard_rows=90, query_rows=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_top(rows, 7)


def test_top_k_of_few_rows_ragged_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, 0.5, 9.0]), (20, [])]
    got = K.top_k(table_of(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_top(rows, 20)
    none = table_of(spark, rows).limit(0)
    assert K.top_k(none, F.col("vec_id") % 20 == 0).collect() == []
    assert K.top_k(table_of(spark, rows[1:4]), F.col("vec_id") % 20 == 0).collect() == []


def test_search_stops_before_the_last_posting_where_it_can_prove_it():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 32)) * 20
    x = np.floor(centres[rng.integers(8, size=3000)] + rng.normal(size=(3000, 32)) * 3).astype(np.int64)
    shard = K.Shard(x, *K.segments(x), np.arange(3000), np.zeros(3000, bool), np.ones(3000, np.int64))
    could, read = shard.possible(x[:5], [np.array([i]) for i in range(5)], 20)
    for i in range(5):
        scores = np.where(np.arange(3000) == i, -10**9, x @ x[i])
        assert read[i] < len(shard.ends) and len(could[i]) < 1500 and set(np.argsort(-scores, kind="stable")[:20]) <= set(could[i])


def test_segments_fall_by_powers_of_two():
    x = np.array([[0, 5, -9], [1, 0, 4], [-3, 2, 7]])
    posts, ends = K.segments(x)
    assert [x.flat[p] for p in posts[: ends[0]]] == [-9] and sorted(x.flat[posts[ends[0]: ends[1]]]) == [4, 5, 7]
    assert sorted(x.flat[posts[ends[1]: ends[2]]]) == [-3, 2] and ends[3:] == [7] and len(posts) == 7
    assert K.segments(np.zeros((2, 3), int))[1] == [] and K.segments(np.zeros((2, 0), int))[1] == []


def brute_whitening(rows, k=8):
    x = integers(rows, 1024, 100_000)
    width = Counter(len(v) for _, v in x).most_common(1)[0][0]
    x = [(i, v) for i, v in x if len(v) == width]
    a, n = np.array([v for _, v in x], np.int64), len(x)
    s = a.sum(axis=0)
    c = a - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(e) - int(t)) ** 2 for e, t in zip(v, s)) for v in a]
    return [i for i, _ in x], n, deviation, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_equals_brute_force(spark):
    rows = made(300, 12, 2) + [(900, [0.5])]
    ids, n, deviation, z, explained = brute_whitening(rows)
    got = W.whiten_rows(table_of(spark, rows)).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n}
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    sign = np.sign([by[7, deviation[7]][j + 1][0] / z[7, j] for j in range(8)])
    want = Counter((i, d) for i, d in zip(ids, deviation))
    assert {key: len(v[1]) for key, v in by.items()} == want
    for i, d, row in zip(ids, deviation, z * sign):
        for j in range(8):
            assert any(abs(v - row[j]) < 1e-9 for v in by[i, d][j + 1])


def test_whitening_of_small_and_flat_tables(spark):
    assert W.whiten_rows(table_of(spark, [(1, [0.1, 0.2])]).limit(0)).collect() == []
    assert W.whiten_rows(table_of(spark, [(1, [0.1, 0.2])] * 3)).collect() == []
    assert W.whiten_rows(table_of(spark, [(1, [])] * 3)).collect() == []
    got = W.whiten_rows(table_of(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert {round(r.explained, 12) for r in got} == {1.0}
    once = W.whiten_rows(table_of(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]), weighted=False).collect()
    assert {r.n for r in once} == {2} and {abs(round(r.whitened, 9)) for r in once} == {1.0}


def test_deviation_beyond_64_bits_is_null():
    big = np.array([[1 << 40, 1 << 20]], np.int64)
    assert W._deviation(big) == [None]
    assert W._deviation(np.array([[1 << 31, 3], [5, 1 << 20]], np.int64)) == [(1 << 62) + 9, (1 << 40) + 25]
    assert W._deviation(np.array([[3, 4]], np.int64)) == [25]


def brute_clusters(rows, width, k=8, rounds=10):
    x = [(i, v) for i, v in integers(rows, 1024) if len(v) == width]
    order = sorted(x, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in x]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, label) in zip(x, near) if label == j]
                c[j] = [sum(e) // len(mine) for e in zip(*mine)] if mine else c[j]
    part = Counter()
    for d, j in near:
        part[j] += d
    digest = [sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, part[j], sum(part.values()), digest[j]) for (i, _), (d, j) in zip(x, near)), key=str)


@pytest.mark.parametrize("levels", [None, 2])
def test_clusters_equal_brute_force(spark, levels):
    rows = made(240, 6, 3, levels) + [(900, [0.5]), (901, [])]
    got = C.cluster(table_of(spark, rows), width=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, 6)


def test_clusters_of_few_rows(spark):
    assert C.cluster(table_of(spark, [(1, [0.1, 0.2])]).limit(0), width=2).collect() == []
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (2, [0.1, 0.2]), (None, [0.4, 0.2])]
    got = C.cluster(table_of(spark, rows), width=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, 2)


def test_bounds_never_exceed_the_distance_and_spare_measuring():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(2000, 64)) * 30 + rng.integers(8, size=(2000, 1)) * 200).astype(np.int64)
    centroids = x[rng.integers(2000, size=8)]
    pivots = C.choose_pivots(centroids)
    to = C.distances(x, pivots.at)
    exact = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    assert (C.lower_bounds(to, centroids, pivots) <= exact).all()
    label, best, measured = C.assign(x, to, centroids, pivots)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and measured < x.shape[0] * 8 * 0.8
    same = np.repeat(x[:1], 4, axis=0)
    assert C.choose_pivots(same).pairs == [] and C.assign(same, C.distances(same, x[:1]), same, C.choose_pivots(same))[0].tolist() == [0] * 4
