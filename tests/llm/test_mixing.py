import random

import numpy as np
import pytest

from wardflow.llm import mixing as M


def test_every_source_stays_within_one_block():
    rnd = random.Random(7)
    for _ in range(30):
        weights = {f"s{k}": rnd.choice([1, 2, 50, 0.1, rnd.random()]) for k in range(rnd.randint(1, 30))}
        whole = M.exact_weights(weights)
        a, total = [whole[s] for s in sorted(whole)], sum(whole.values())
        plan = list(M.jobs(a, [1000 * x // total + 1 for x in a]))
        assert [i for k, i, _ in plan if k == 0] == list(range(1000 * a[0] // total + 1))
        at = np.array([k for k, _, slot in plan if slot < 1000])
        assert [slot for *_, slot in plan][: len(at)] == list(range(1000))
        for k, x in enumerate(a):
            assert np.abs(np.cumsum(at == k) - np.arange(1, 1001) * (x / total)).max() < 1


def earliest_deadline(a, n):
    """The schedule slot by slot, looking at every source each time."""
    total, at, slot, out = sum(a), [0] * len(a), 0, []
    while any(at[k] < n[k] for k in range(len(a))):
        ready = [(-(-(at[k] + 1) * total // a[k]), at[k] * total // a[k], k) for k in range(len(a)) if at[k] < n[k] and at[k] * total // a[k] <= slot]
        if ready:
            due = min(ready)[0]
            out.append((slot, due, {k for d, _, k in ready if d == due}))
            k = next(k for k in sorted(out[-1][2]))
            out[-1] = (slot, k, at[k])
            at[k] += 1
        slot += 1
    return out


def test_schedule_equals_brute_force_on_random_weights():
    rnd = random.Random(3)
    for _ in range(40):
        a = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 8))]
        n = [rnd.randint(0, 12) for _ in a]
        got = [(slot, k, i) for k, i, slot in M.jobs(a, n)]
        assert got == earliest_deadline(a, n)


def test_blocks_grow_with_the_table():
    assert M.block_length(10_000_000) == 16 and M.block_length(10**10) == 9537
    assert M.block_length(1000, block=4, most_blocks=50) == 20


def test_mixture_keeps_every_row_and_its_weights(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["a", "a", "a", "b", None])) for k in range(3000)] + [(None, "b"), (None, None), (5, "c"), (5, "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, mix_slot int").repartition(3)
    got = M.mix(df, weights={"a": 3.0, "b": 2.0, "": 1.0, "c": 0.01}, block=4, bins=8).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted(rows, key=str)
    assert len({r.mix_position for r in got}) == len(rows)
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.mix_block), []).append(r)
    assert all(len({x.mix_slot for x in v}) == 1 for v in blocks.values()) and len({v[0].mix_slot for v in blocks.values()}) == len(blocks)
    shares = {"a": 3.0, "b": 2.0, "": 1.0}
    lasts = got[0].mix_lasts
    for s in ("a", "b", None):
        slots = np.array([v[0].mix_slot for (x, _), v in blocks.items() if x == s])
        for t in range(1, lasts + 1):
            assert abs((slots < t).sum() - t * shares[s or ""] / 6.01) < 1
    ranks = sorted((r.mix_position for r in got if r.source == "a"))
    assert len(ranks) == sum(s == "a" for _, s in rows)


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_sources_stay_within_one_block_of_their_weights_on_long_tables():
    for others, slots in ((19, 20_000), (199, 40_000)):
        weights = {f"s{k:03}": (2 / 3 / others) ** 0.5 for k in range(others)} | {"big": (1 / 3) ** 0.5}
        whole = M.exact_weights(weights)
        names = sorted(whole)
        a, total = [whole[s] for s in names], sum(whole.values())
        n = [slots * x // total + 1 for x in a]
        at = np.array([k for k, _, _ in M.jobs(a, n)])
        for k, s in enumerate(names):
            target = np.arange(1, slots + 1) * (weights[s] / sum(weights.values()))
            assert np.abs(np.cumsum(at[:slots] == k) - target).max() < 1


def test_mixture_follows_the_weights_of_its_sources(spark):
    rows = [(k, "big" if k % 3 == 0 else f"s{k % 19:02}") for k in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = M.mix(df, block=2).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows) and len({r.mix_position for r in got}) == len(rows)
    counts = {s: sum(x == s for _, x in rows) for s in {x for _, x in rows}}
    total, lasts = sum(c ** 0.5 for c in counts.values()), got[0].mix_lasts
    assert lasts > 2000
    for s, c in counts.items():
        slots = np.array(sorted({r.mix_slot for r in got if r.source == s}))
        t = np.arange(1, lasts + 1)
        assert np.abs(np.searchsorted(slots, t) - t * c ** 0.5 / total).max() < 1


def test_many_tiny_sources_and_weight_zero(spark):
    rows = [(k, "big") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(60)] + [(2000 + k, "zero") for k in range(9)]
    weights = {"big": 1.0, "zero": 0.0} | {f"t{k}": 1e-4 for k in range(60)}
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows) and len({r.mix_position for r in got}) == len(rows)
    big = np.array(sorted({r.mix_slot for r in got if r.source == "big"}))
    t = np.arange(1, 101)
    assert np.abs(np.searchsorted(big, t) - t / 1.006).max() < 1
    assert min(r.mix_slot for r in got if r.source == "zero") > max(r.mix_slot for r in got if r.source != "zero")


def test_too_many_sources_and_long_blocks(spark):
    df = spark.createDataFrame([(k, f"s{k % 7}") for k in range(700)], "doc_id long, source string")
    with pytest.raises(ValueError):
        M.source_sizes(df, "source", most=6)
    got = M.mix(df, block=1, most_blocks=30).collect()
    assert len({r.mix_position for r in got}) == 700 and len({(r.source, r.mix_block) for r in got}) <= 37
