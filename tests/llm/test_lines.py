import hashlib

import numpy as np

from wardflow.llm import lines as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))
    return k if len(k) >= 40 else None


def brute(rows, min_docs=5):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                held.setdefault(key(x), set()).add(i)
    lose = {}
    for k, ids in held.items():
        if len(ids) >= min_docs:
            lose[k] = max(i for i in ids if i is not None)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (key(x) in lose and i != lose[key(x)])]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    r = np.random.default_rng(1)
    a, b = (r.integers(-(2**62), 2**62, 5001) for _ in range(2))
    p = L.PerfectHash.load(L.PerfectHash(a, b, np.arange(5001) + 2, np.arange(5001)).dump())
    assert p.total == 5001
    count, owner = p.probe(a, b)
    assert (count == np.arange(5001) + 2).all() and (owner == np.arange(5001)).all()
    assert not p.probe(b, a)[0].any()


def test_line_dedup_matches_brute_force(spark):
    long = ["Line %d " % k + "ü" * 40 for k in range(6)]
    rows = [(i, "\n".join(["  " + (long[i % 6].upper() if i % 2 else long[i % 6]) + "\t", "short", long[(i * 7) % 6], long[0], ""])) for i in range(20)]
    rows += [(3, rows[3][1]), (None, long[0]), (None, None), (40, ""), (41, "x" * 39), (42, "\n"), (43, long[2] * 2000)]
    df = spark.createDataFrame([(i, t, "other", 7) for i, t in rows], "doc_id long, text string, n_lines string, extra int")
    done = L.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in done.collect()), key=str)
    assert got == brute(rows)
    assert [r.text for r in done.collect() if r.doc_id is None and r.n_lines == 1 and r.n_dropped == 0] == [None]


def test_many_shards_and_copies_give_the_same_hits(spark):
    rows = [(k % 50, k, i) for i in range(30) for k in range(60) if (i * k) % 3 or k < 2]
    df = spark.createDataFrame([(hash((a, b)) % 2**60, b, i) for a, b, i in rows], "a long, b long, id long")
    one = sorted(map(tuple, L.repeated_line_hits(df, 5).collect()))
    many = sorted(map(tuple, L.repeated_line_hits(df, 5, keys_per_shard=7, probes_per_task=11).collect()))
    assert one == many and one


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
