"""Steps of the language and toxicity models against plain loops."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm import language, toxicity
from wardflow.llm import words as W

MASK = (1 << 64) - 1


def plain_bins(text):
    """Bins of the n-grams of a text, one number per occurrence."""
    chars = re.sub(r"[\x20\x09-\x0D]+", " ", text).lower()
    out = []
    for size in (1, 2, 3):
        for at in range(len(chars) - size + 1):
            h = 0
            for k, c in enumerate(chars[at: at + size]):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + k + 1) & MASK
            out.append((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> 52)
    return out


def plain_tfidf(text, seen, total):
    counts = {}
    for b in plain_bins(text):
        counts[b] = counts.get(b, 0) + 1
    x = {b: math.log1p(n) * (math.log((1 + total) / (1 + seen.get(b, 0))) + 1) for b, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1
    return {b: v / norm for b, v in x.items()}


def plain_ftrl(rows, classes, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
    z, n = {}, {}

    def weight(key):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for idx, value, y in rows:
            w = {(i, c): weight((i, c)) for i in idx for c in range(classes)}
            s = [sum(v * w[i, c] for i, v in zip(idx, value)) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(classes):
                error = e[c] / sum(e) - (c == y)
                for i, v in zip(idx, value):
                    g, old = v * error, n.get((i, c), 0.0)
                    n[i, c] = old + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(n[i, c]) - math.sqrt(old)) / alpha * w[i, c]
    return z, weight


TEXTS = ["the cat  and\nthe hat", "der Hund und die Katze", "", "ÀÉ été à la", "le chat et le chien", "ab ab ab", "dog and cat\t!", "die Maus"]


def test_weights_of_n_grams_equal_plain_loops(spark):
    seen = {}
    for t in TEXTS:
        for b in set(plain_bins(t)):
            seen[b] = seen.get(b, 0) + 1
    df, total = language.document_frequencies(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    assert total == len(TEXTS) and {int(b): int(df[b]) for b in np.flatnonzero(df)} == seen
    data, offsets = W.text_buffer(pa.array(TEXTS))
    got = language.weighted(language.gram_counts(*language.code_points(data, offsets)), np.log((1 + total) / (1 + df)) + 1)
    for t, row in zip(TEXTS, got):
        want = plain_tfidf(t, seen, total)
        assert set(np.flatnonzero(row)) == set(want) and all(abs(row[b] - v) < 1e-12 for b, v in want.items())


def test_regularised_leader_equals_plain_loops():
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        idx = np.append(np.sort(rng.choice(30, size=5, replace=False)), language.DIMENSIONS)
        rows.append((idx, np.append(rng.random(5) / 2, 1.0), k % 3))
    got = language.ftrl(rows, 3)
    z, weight = plain_ftrl(rows, 3)
    assert all(abs(got[key] - weight(key)) < 1e-9 for key in z)
    assert (got != 0).sum() == sum(weight(key) != 0 for key in z) < len(z)  # the penalty leaves some at zero


def test_temperature_has_the_least_smoothed_log_loss():
    rng = np.random.default_rng(9)
    scores, y = rng.normal(size=(200, 3)) * 4, rng.integers(3, size=200)
    y[:120] = scores[:120].argmax(axis=1)

    def loss(t):
        total = 0.0
        for s, k in zip(scores / t, y):
            log_sum = math.log(sum(math.exp(v) for v in s))
            smoothed = [(1 / 203) + (c == k) * (1 - 3 / 203) for c in range(3)]
            total += sum(w * (log_sum - v) for w, v in zip(smoothed, s))
        return total

    best = language.temperature(scores, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(-3.9, 2.9, 300)))


def test_predictions_equal_plain_loops(spark):
    train = spark.createDataFrame([(k, TEXTS[k % 8] or "x", "abc"[k % 3]) for k in range(60)], "doc_id long, text string, lang string")
    model = language.fit(train, "text", "lang", "doc_id")
    got = {r.text: r for r in language.predict(spark.createDataFrame([(t,) for t in TEXTS], "text string"), model).collect()}
    for t in TEXTS:
        if not any(c.isalpha() for c in t):
            assert (got[t].lang_pred, got[t].score) == ("und", 0.0)
            continue
        counts = {}
        for b in plain_bins(t):
            counts[b] = counts.get(b, 0) + 1
        x = {b: math.log1p(n) * model["idf"][b] for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        s = [(sum(v / norm * float(model["weights"][b, c]) for b, v in x.items()) + float(model["weights"][-1, c])) / model["temperature"] for c in range(3)]
        p = [math.exp(v - max(s)) for v in s]
        assert got[t].lang_pred == "abc"[int(np.argmax(p))] and abs(got[t].score - max(p) / sum(p)) < 1e-6


WORD = rb"[0-9A-Za-z\x80-\xff]+"
STAND = {ord(a): ord(b) for a, b in toxicity.STAND_INS.items()}


def plain_features(text, mined):
    """The feature row of a text; ``mined``: token (bytes; a word, or its beginning as ``(bytes,)``) -> log odds."""
    raw = (text or "").encode()
    insults = {w.encode() for w in toxicity.INSULTS}
    second = {w.encode() for w in toxicity.SECOND_PERSON}
    found = [m.group() for m in re.finditer(WORD, raw)]
    tokens = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]
    n = max(len(tokens), 1)
    fixed = [t in insults for t in tokens]
    strengths = [[mined[x] for x in [t, *[(t[:k],) for k in toxicity.PREFIXES if len(t) > k]] if x in mined] for t in tokens]
    hit, best = [bool(s) for s in strengths], [max(s, default=0.0) for s in strengths]
    you = [t in second for t in tokens]
    near = sum(max((math.exp(-abs(i - j) / 5.0) for j in range(len(tokens)) if you[j]), default=0.0)
               for i in range(len(tokens)) if fixed[i] or hit[i])
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    shouted = sum(sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in found)
    size = max(len(raw), 1)
    both = hidden = 0
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff@$]+", raw):
        w = m.group()
        stands = any(c in STAND for c in w)
        letters = any(not 48 <= c <= 57 and c not in (ord("@"), ord("$")) for c in w)
        if stands and letters:
            both += 1
            hidden += bytes(c + 32 if 65 <= c <= 90 else c for c in bytes(STAND.get(c, c) for c in w)) in insults
    return [sum(fixed) / n, math.log1p(sum(fixed)), sum(hit) / n, math.log1p(sum(hit)), sum(best) / n, sum(you) / n, math.log1p(near),
            upper / max(upper + lower, 1), shouted / n, raw.count(b"!") / size, raw.count(b"?") / size,
            sum(raw.count(bytes([c])) for c in b"#$%&*<>@^|~") / size, both / n, math.log1p(hidden), math.log1p(len(tokens))]


RUDE = ["You are an 1d1ot, YOU m0ron!!", None, "", "an apple a day?", "blöd BLÖD ihr seid tr0ttel $cum ~~", "you " * 30 + "zorkelish SCUM",
        "zorkel and you, nasty@mail 123 a1 $5", "ÉCLAT nul? usted <b>basura</b>", "x" * 5000 + " idiot your " + "word " * 400]


def test_feature_rows_equal_plain_loops():
    mined = {b"zorkel": 2.5, (b"zorke",): 1.5, b"day": 0.7, (b"appl",): 3.0}
    whole = {toxicity.word_hashes([k.decode()])[0]: v for k, v in mined.items() if isinstance(k, bytes)}
    stems = {}
    for k in [k for k in mined if isinstance(k, tuple)]:
        data, offsets = W.text_buffer(pa.array([k[0].decode() + "xx"]))
        stems[W.words(data, offsets, W.alphanumeric(), (len(k[0]),)).prefix[0, 0]] = mined[k]
    hashes = whole | stems
    order = sorted(hashes)
    got = toxicity.features(pa.array(RUDE), np.array(order, dtype=W.U64), np.array([hashes[h] for h in order]))
    assert len(got) == len(RUDE)
    for t, row in zip(RUDE, got):
        want = plain_features(t, mined)
        for name, a, b in zip(toxicity.FEATURES, row, want):
            assert abs(a - b) < 1e-9, (name, t and t[:40], a, b)


def test_mined_tokens_equal_plain_counts(spark):
    rows = [(f"good words number{k} shared", 0) for k in range(40)] + [(f"zorkel blub{k % 2} shared zorkelish", 1) for k in range(12)]
    hashes, odds = toxicity.mine(spark.createDataFrame(rows, "text string, label int").repartition(3))
    bad, total = {}, {}
    for text, label in rows:
        tokens = set()
        for w in text.encode().split():
            tokens.add(w)
            tokens |= {(w[:k],) for k in toxicity.PREFIXES if len(w) > k}
        for t in tokens:
            total[t] = total.get(t, 0) + 1
            bad[t] = bad.get(t, 0) + label
    want = [math.log(((bad[t] + 0.5) / 12) / ((total[t] - bad[t] + 0.5) / 40)) for t in total if bad[t] >= 5]
    assert np.allclose(sorted(odds), sorted(x for x in want if x >= math.log(10.0))) and len(set(hashes.tolist())) == len(odds) > 0
    assert list(hashes) == sorted(hashes)


def test_calibration_equals_pooled_neighbours(spark):
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(4)
    rows = [(float(p), float(rng.random() < p * p)) for p in rng.integers(0, 20, size=300) / 20]
    iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(spark.createDataFrame(rows, "p double, label double"))
    by = {}
    for p, y in rows:
        by.setdefault(p, []).append(y)
    pools = []
    for p in sorted(by):
        pools.append([sum(by[p]), len(by[p]), [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, ps = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + ps]
    want = {p: s / n for s, n, ps in pools for p in ps}
    got = {r.p: r.score for r in iso.transform(spark.createDataFrame([(p,) for p in by], "p double")).select(F.col("p"), "score").collect()}
    assert all(abs(got[p] - want[p]) < 1e-9 for p in by)
