import math
import os
import re
import struct
from collections import Counter

import pytest
import xxhash

from wardflow.llm import quality as Q

TEXTS = ["", None, " \n\t", "one two", "# $ % & | < > *", "a b c d e f g h " * 4, "same line\nsame line\n \nsame line \nother", "x " * 25,
         " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k % 11}" for k in range(30)), "é\x0bü\x0cß  \r\n y",
         " ".join(f"u{k}" for k in range(30)) + " a b c d e f g h " + " ".join(f"v{k}" for k in range(9)) + " a b c d e f g h"]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i: i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def hashes(t):
    """64-bit hashes of the words and pairs of a text, as Spark's xxhash64 (seed 42, chained) gives them."""
    signed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(signed, signed[1:])]
    return signed + pairs


def brute_verdicts(rows, trusted, bins, least=-0.1):
    """(mean log ratio, kept) of each (doc_id, text) by plain loops."""
    raw, target = Counter(), Counter()
    for i, t in rows:
        for h in hashes(t):
            raw[h % bins] += 1
            target[h % bins] += i in trusted and i is not None
    shift = math.log(sum(target.values()) + bins) - math.log(sum(raw.values()) + bins)
    out = []
    for i, t in rows:
        grams = hashes(t)
        mean = sum(round(1e6 * (math.log(target[h % bins] + 1) - math.log(raw[h % bins] + 1) - shift)) for h in grams) / 1e6 / max(len(grams), 1)
        if not sum(target.values()):
            mean = 0.0
        out.append((mean, not brute(t)[-1] and mean >= least))
    return out


def no_ratios(spark, bins=16):
    return Q.Ratios(spark.createDataFrame([(0, [0] * Q.PACK)], "g bigint, ratios array<int>"), bins)


def test_base_counts_match_brute_force(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string, score int")
    rows = Q.judge(df, no_ratios(spark)).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(r.text)
        assert r.kept == (not r.base_failed) and r.score == 0.0


GOOD = [" ".join(f"good{(k * j) % 37}" for j in range(1, 60)) for k in range(1, 20)]
JUNK = [" ".join(f"junk{(k * j) % 41}" for j in range(1, 60)) for k in range(1, 20)]
ROWS = list(enumerate(GOOD + JUNK)) + [(None, GOOD[0]), (3, GOOD[3]), (7, None), (8, " "), (9, "one")] + [(50, JUNK[2])] * 3


def test_scores_and_verdicts_equal_plain_loops_looked_up_or_joined(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(k,) for k in range(10)] + [(None,), (3,)], "doc_id long")
    ratios = Q.ratio_table(df, trusted, "doc_id", "text", grams_per_bin=4, least_bins=1)
    want = sorted(zip(ROWS, brute_verdicts(ROWS, set(range(10)), ratios.bins)), key=str)
    for judged in (Q.judge(df, ratios), Q.judge(df, ratios, in_row_bins=0)):
        got = sorted((((r.doc_id, r.text), (r.score, r.kept)) for r in judged.collect()), key=str)
        assert [g[0] for g in got] == [w[0] for w in want]
        for (_, (score, kept)), (_, (mean, keep)) in zip(got, want):
            assert abs(score - mean) < 1e-5 and (kept == keep or abs(mean + 0.1) < 1e-5)
    scores = {r.text: r.score for r in Q.judge(df, ratios).collect() if r.text}
    assert min(scores[t] for t in GOOD[:10]) > 0 and min(scores[t] for t in GOOD) > max(scores[t] for t in JUNK)
    fresh = spark.createDataFrame([(1, "words never seen before good3 good4 good5")], "doc_id long, text string")
    assert Q.judge(fresh, ratios).collect() == Q.judge(fresh, ratios, in_row_bins=0).collect()


def test_bins_follow_the_distinct_n_grams(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(10)], "doc_id long")
    bins = Q.ratio_table(df, trusted, "doc_id", "text", grams_per_bin=4, least_bins=1).bins
    distinct = len({h for _, t in ROWS for h in hashes(t)})
    assert bins / 2 < 1.1 * distinct / 4 and bins > 0.9 * distinct / 4
    assert Q.ratio_table(df.union(df), trusted, "doc_id", "text", grams_per_bin=4, least_bins=1).bins == bins
    more = df.union(df.selectExpr("doc_id", "regexp_replace(text, 'o|u', concat('x', doc_id))"))
    assert Q.ratio_table(more, trusted, "doc_id", "text", grams_per_bin=4, least_bins=1).bins >= 2 * bins
    assert {r.score for r in Q.judge(df, Q.ratio_table(df, trusted.limit(0), "doc_id", "text")).collect()} == {0.0}
    assert Q.judge(df.limit(0), Q.ratio_table(df.limit(0), trusted, "doc_id", "text")).collect() == []


def test_trusted_ids_are_joined_alike_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(10)], "doc_id long")
    near = sorted(Q.gram_counts(df, trusted, "doc_id", "text", 64).collect())
    monkeypatch.setattr(Q, "BROADCAST_IDS", 0)
    assert sorted(Q.gram_counts(df, trusted, "doc_id", "text", 64).collect()) == near


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_query_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in Q.trusted_labels(labels).collect()}
    ratios = Q.ratio_table(spark.read.parquet(f"{sf}/documents.parquet"), Q.trusted_labels(labels), "doc_id", "text")
    got = {r.doc_id: (r.score, r.kept) for r in Q.op3_quality_rules(spark, sf).collect()}
    for (i, _), (mean, keep) in zip(rows, brute_verdicts(rows, trusted, ratios.bins)):
        assert abs(got[i][0] - mean) < 1e-5 and (got[i][1] == keep or abs(mean + 0.1) < 1e-5)


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables not present")
def test_verdict_drops_low_quality_documents_on_a_larger_corpus(spark):
    got = Q.op3_quality_rules(spark, LARGER).filter("n_words >= 20").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.98 * (n[0, False] + n.get((0, True), 0))
    assert n.get((1, False), 0) < 0.01 * n[1, True]
