"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities and counts of two lexicons (a fixed one and one
mined from labels), the nearness of second-person words to lexicon words,
capitals, punctuation and obfuscation. The mined lexicon holds words and word
beginnings (four to six bytes) that are far commoner in documents labelled
toxic. Labels enter through a bounded sample (``SAMPLE`` rows, by hash of the
id), split by hash into parts for mining, for the trees and for calibration.
Features and scores cover every document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import words as W
from wardflow.llm.common import add_columns, checkpoint, table
from wardflow.llm.language import held_out

SAMPLE = 12_000
LEXICON_SIZE = 2_000
PREFIXES = (4, 5, 6)
# Common insults and second-person words of the four languages.
INSULTS = """
idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown
clowns fool fools jerk ugly creep freak pig rat vermin filth coward liar imbecile
dumm dummkopf arschloch blöd abschaum versager widerlich erbärmlich trottel
idiota imbécil estúpido estúpida basura asqueroso patético tonto payaso escoria
idiote imbécile stupide débile ordure nul minable dégoûtant crétin clochard
""".split()
SECOND_PERSON = """
you your yours yourself u ur
du dich dir dein deine deinen ihr euch euer sie ihnen
tú tu tus te ti usted ustedes vosotros vos
toi ton ta tes vous votre vos
""".split()
# Characters that stand for letters in obfuscated words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FEATURES = ["fixed_density", "fixed_count", "mined_density", "mined_count", "mined_best", "you_density", "you_near",
            "capitals", "shouted", "exclaims", "questions", "symbols", "obfuscated", "hidden_insults", "log_words"]


def word_hashes(items: list[str]) -> np.ndarray:
    data, offsets = W.text_buffer(pa.array(items, pa.large_string()))
    return np.unique(W.words(data, offsets, W.alphanumeric()).hash)


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(x.shape, dtype=bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)


def features(column: pa.Array, mined: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Feature rows of the texts of a column; ``mined`` are sorted token hashes with their log odds."""
    data, offsets = W.text_buffer(column)
    insults, you = word_hashes(INSULTS), word_hashes(SECOND_PERSON)
    stand_in = np.zeros(256, dtype=bool)
    stand_in[[ord(c) for c in STAND_INS]] = True
    letter = W.alphanumeric() & ~np.isin(np.arange(256), np.arange(48, 58))
    joined = W.alphanumeric() | stand_in
    to_letter = np.arange(256, dtype=np.uint8)
    for a, b in STAND_INS.items():
        to_letter[ord(a)] = ord(b)
    out = []
    for i, j in W.row_groups(offsets, 2 << 20):
        bounds = offsets[i: j + 1]
        w = W.words(data, bounds, W.alphanumeric(), PREFIXES)
        n = np.maximum(np.diff(w.first), 1)
        fixed = _in(insults, w.hash)
        tokens = np.column_stack([w.hash, w.prefix])
        hit = _in(mined, tokens)
        best = np.zeros(len(w.hash))
        if len(mined):
            at = np.minimum(np.searchsorted(mined, tokens), len(mined) - 1)
            best = np.where(hit, strength[at], 0).max(axis=1) if len(w.hash) else best
        any_mined = hit.any(axis=1)
        second = _in(you, w.hash)
        # distance in words from each lexicon word to the closest second-person word of its row
        rows = w.row
        bad, yous = np.flatnonzero(fixed | any_mined), np.flatnonzero(second)
        near = np.zeros(len(w.hash))
        if len(bad) and len(yous):
            k = np.searchsorted(yous, bad)
            for side in (np.maximum(k - 1, 0), np.minimum(k, len(yous) - 1)):
                same = rows[yous[side]] == rows[bad]
                near[bad] = np.maximum(near[bad], np.where(same, np.exp(-np.abs(yous[side] - bad) / 5.0), 0))
        raw = data[bounds[0]: bounds[-1]]
        cut = bounds - bounds[0]
        size = np.maximum(np.diff(cut), 1)
        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        ups = np.concatenate([[0], np.cumsum(upper)])
        lows = np.concatenate([[0], np.cumsum(lower)])
        s, e = w.start - bounds[0], w.end - bounds[0]
        shouted = (ups[e] - ups[s] >= 2) & (lows[e] == lows[s])
        letters = np.maximum(_per_row(upper | lower, cut), 1)
        # tokens that join letters and stand-ins, and insults among them once the stand-ins are read as letters
        plain = np.ascontiguousarray(to_letter[raw])
        t = W.words(raw, cut, joined)
        stands = np.concatenate([[0], np.cumsum(stand_in[raw])])
        real = np.concatenate([[0], np.cumsum(letter[raw])])
        both = (stands[t.end] > stands[t.start]) & (real[t.end] > real[t.start])
        hidden = np.zeros(len(t.hash), dtype=bool)
        some = np.flatnonzero(both)
        if len(some):
            clean = W.words(plain, cut, joined).hash[some]
            hidden[some] = _in(insults, clean)
        x = np.column_stack([
            _per_row(fixed, w.first) / n, np.log1p(_per_row(fixed, w.first)),
            _per_row(any_mined, w.first) / n, np.log1p(_per_row(any_mined, w.first)),
            _per_row(best, w.first) / n, _per_row(second, w.first) / n, np.log1p(_per_row(near, w.first)),
            _per_row(upper, cut) / letters, _per_row(shouted, w.first) / n,
            _per_row(raw == 33, cut) / size, _per_row(raw == 63, cut) / size,
            _per_row(np.isin(raw, [35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]), cut) / size,
            _per_row(both, t.first) / n, np.log1p(_per_row(hidden, t.first)), np.log1p(np.diff(w.first)),
        ])
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def mine(sample: DataFrame, smallest: int = 5, ratio: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a labelled sample (``text``, ``label``) that mark label 1, with their log odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = W.text_buffer(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in W.row_groups(offsets, 2 << 20):
                w = W.words(data, offsets[i: j + 1], W.alphanumeric(), PREFIXES)
                token = np.column_stack([w.hash, w.prefix]).ravel()
                row = np.repeat(w.row, 1 + len(PREFIXES))
                token, row = token[token != 0], row[token != 0]
                order = np.lexsort((row, token))
                token, row = token[order], row[order]
                fresh = np.ones(len(token), dtype=bool)
                fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
                token, one = token[fresh], label[i:j][row[fresh]]
                values, start = np.unique(token, return_index=True)
                bad = np.add.reduceat(one, start) if len(start) else one
                total = np.diff(np.append(start, len(token)))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(total.astype(np.int64))],
                                                 names=["token", "bad", "total"])

    sizes = sample.agg(F.sum("label").alias("bad"), F.count("label").alias("total")).first()
    bad_docs, good_docs = sizes["bad"] or 0, (sizes["total"] or 0) - (sizes["bad"] or 0)
    if not bad_docs or not good_docs:
        return np.zeros(0, W.U64), np.zeros(0)
    odds = F.log(((F.col("bad") + 0.5) / float(bad_docs)) / ((F.col("total") - F.col("bad") + 0.5) / float(good_docs)))
    got = (sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "token long, bad long, total long")
           .groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
           .filter(F.col("bad") >= smallest).withColumn("odds", odds).filter(F.col("odds") >= float(np.log(ratio)))
           .orderBy(F.desc("odds"), "token").limit(LEXICON_SIZE).toPandas())
    token = got["token"].to_numpy(dtype=np.int64).view(W.U64)
    order = np.argsort(token)
    return token[order], got["odds"].to_numpy(dtype=np.float64)[order]


def score_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                sample: int = SAMPLE) -> DataFrame:
    """Adds ``score`` (probability of label 1) to ``doc_id`` and ``held_out`` of every document.

    Labels are learned from documents that are not held out only. Where an id
    has several labels the largest counts; null labels and ids teach nothing.
    Null and empty texts have all features 0 and a score like any other text.
    With no label, or one only, every score is that label's (0 without any).
    """
    seen = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    order = F.xxhash64("id", F.lit(8))
    chosen = (seen.filter(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(order, "id").limit(sample).withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5))))
    chosen = checkpoint(chosen)
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = plain.join(F.broadcast(chosen), "id")  # at most ``sample`` small rows
    mined, strength = mine(known.filter("part < 2"))

    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(column: pa.Array) -> list[pa.Array]:
        x = features(column, mined, strength)
        flat = pa.array(x.ravel(), pa.float64())
        at = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
        return [pa.ListArray.from_arrays(at, flat).cast(pa.list_(pa.float64()))]

    every = checkpoint(add_columns(plain, ["text"], schema, run, keep=["id"]))
    wide = every.select("id", *[F.col("x")[k].alias(f) for k, f in enumerate(FEATURES)])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide).select("id", "features")
    taught = checkpoint(vectors.join(F.broadcast(chosen), "id"))
    kinds = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = vectors.select(F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "features")
    trees = taught.filter("part IN (2, 3)")
    if len(kinds) < 2 or trees.select("label").distinct().count() < 2:
        return result.select(doc_id, "held_out", F.lit(float(kinds.get(1, 0) > kinds.get(0, 0))).alias("score"))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=8).fit(trees.coalesce(2))
    raw = vector_to_array("probability")[1]
    level = model.transform(taught.filter("part = 4")).select(raw.alias("p"), F.col("label").cast("double").alias("label"))
    out = model.transform(result).withColumn("p", raw)
    if level.isEmpty():
        return out.select(doc_id, "held_out", F.col("p").alias("score"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(level)
    return iso.transform(out).select(doc_id, "held_out", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and verdict of every document."""
    scored = score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
