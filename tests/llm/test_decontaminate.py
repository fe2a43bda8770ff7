import random

import numpy as np

from tests.llm.conftest import words
from wardflow.llm import decontaminate as D

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, bench, size):
    windows = {}
    for i, t in bench:
        w = words(t, PATTERN)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k: k + size]), set()).add("null" if i is None else i)
    out = []
    for i, t in docs:
        w, hit, items = words(t, PATTERN), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k: k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(3)
    text = lambda n: rnd.choice([" ", ". ", "\n"]).join(rnd.choice(["a", "B", "c", "d", "É", "x1"]) for _ in range(n))
    bench = [(f"i{k % 7}", text(rnd.randint(0, 9))) for k in range(12)] + [(None, "a b a"), ("n", None), ("e", "")]
    docs = [(k, text(rnd.choice([0, 1, 5, 40, 300, 4000]))) for k in range(50)] + [(None, None), (3, ""), (7, "q"), (7, "q")]
    return docs, bench


def test_matches_brute_force_in_one_block_or_many(spark):
    docs, bench = tables()
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, items string")
    items = spark.createDataFrame(bench, "item_id string, text string")
    for block_bytes in (8 << 20, 40):
        rows = D.find_contamination(df, items, size=4, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str) == brute(docs, bench, 4)
        for r in rows:  # what is cut holds exactly the hit words
            cut = "".join(r.text[s.start: s.end] + " " for s in r.spans) if r.text else ""
            assert len(words(cut, PATTERN)) == r.n_hit == sum(s.end - s.start for s in r.word_spans)
            left = D.remove_spans(r.text, [(s.start, s.end) for s in r.spans])
            assert len(words((left or "").replace("\0", " "), PATTERN)) <= r.n_words - r.n_hit + len(r.spans)


def test_empty_tables(spark):
    docs, bench = tables()
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    assert D.find_contamination(df.limit(0), items).collect() == []
    assert all(r.n_hit == 0 and r["items"] == [] for r in D.find_contamination(df, items.limit(0)).collect())


def test_index_counts_and_locates_like_a_scan():
    r = np.random.default_rng(5)
    for _ in range(20):
        text = r.integers(0, 4, r.integers(2, 200))
        text[0] = 0
        index = D.FMIndex(text, 4, sample=3)
        patterns = r.integers(1, 4, (30, 4))
        lengths = r.integers(1, 5, 30)
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            want = [k for k in range(len(text) - n + 1) if (text[k: k + n] == p[4 - n:]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
