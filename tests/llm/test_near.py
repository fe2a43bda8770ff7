import random
import re

import numpy as np

from wardflow.llm import near, words as W


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k: k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def mutated(rnd, base, share):
    return " ".join(f"m{rnd.randrange(10**6)}" if rnd.random() < share else w for w in base)


def corpus():
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows = [mutated(rnd, base, rnd.choice([0, 0.01, 0.03, 0.05, 0.08])) for _ in range(120)]
    rows += [mutated(rnd, [f"v{rnd.randrange(900)}" for _ in range(rnd.choice([1, 3, 8, 40]))], 0) for _ in range(60)]
    rows += ["of the", "OF  the", "of", "x of the", "", "  ", None, "of the y of the", rows[3].upper()]
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def test_groups_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_groups(df, size=size).collect()}
        assert got == brute(rows, size)


def test_comparison_across_components_finds_every_link_in_blocks(spark, monkeypatch):
    rows = [r for r in corpus() if r[1] and len(r[1]) > 200]
    nodes = spark.createDataFrame(rows, "id long, text string")
    live = spark.createDataFrame([(7, i, i) for i, _ in rows], "key long, id long, component long")
    want = {i: c for i, (_, c, _) in brute(rows, 2).items()}
    for block in (2048, 10):
        links = [tuple(r) for r in near.across_components(live, nodes, 2, 80, block=block).collect()]
        parent = {i: i for i, _ in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert {i: root(i) for i, _ in rows} == want


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "A b  c"), (None, None), (None, "only here x y")]
    got = sorted((tuple(r) for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 0, None, True),
                          (None, 3, None, True)], key=str)
    assert near.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_close_to_the_true_similarity():
    r = np.random.default_rng(2)
    order = near.probe_order()
    for n, shared in ((40, 30), (500, 420), (5000, 2500)):
        a = np.sort(r.integers(0, 2**63, n).astype(W.U64))
        b = np.sort(np.concatenate([r.choice(a, shared, replace=False), r.integers(0, 2**63, n - shared).astype(W.U64)]))
        reg = near.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]), order)
        assert reg.all()
        estimate = ((reg[0] == reg[1]).mean() - near.COLLISION) / (1 - near.COLLISION)
        assert abs(estimate - shared / (2 * n - shared)) < 0.2


def test_links_between_tiny_texts_do_not_depend_on_the_estimate(spark):
    # six words, and the same without the last one: similarity 0.8, but estimates below 0.65
    texts = [" ".join(f"w{k}x{j}" for j in range(6)) for k in (4381, 4754)]
    rows = list(enumerate(texts + [t.rsplit(" ", 1)[0] for t in texts], 1))
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}
