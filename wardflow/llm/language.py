"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (one to three code points, lower-cased, blank runs as one
space) are hashed into ``DIMENSIONS`` bins. Document frequencies come from every
training document. The classifier is fitted by follow-the-regularised-leader
with elastic-net penalties on a documented, bounded sample (``per_language``
documents of each language, by hash of the id); a fifth of it is held back to
choose the temperature that calibrates the probabilities. Prediction is one
pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import words as W
from wardflow.llm.common import add_columns, table

DIMENSIONS = 4096
UNKNOWN = "und"
ROWS_AT_ONCE = 256
#: the sample's hash ranges: 2 to this power for each label
HASH_BITS = 12


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in W.row_groups(offsets, 1 << 20):
        for a in range(i, j, ROWS_AT_ONCE):
            yield a, min(a + ROWS_AT_ONCE, j)


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a row group and the first of each row."""
    raw = data[bounds[0]: bounds[-1]]
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds - bounds[0]]
    c = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    upper = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)) | ((c >= 0x391) & (c <= 0x3A9)) | ((c >= 0x410) & (c <= 0x42F))
    c = np.where(upper, c + 32, c)
    return np.where((c == 0x20) | ((c >= 9) & (c <= 13)), np.uint32(32), c), at


def gram_counts(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of each row (rows x DIMENSIONS)."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    blank = c == 32
    repeated = np.zeros(len(c), dtype=bool)
    repeated[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    c, row = c[~repeated].astype(W.U64), row[~repeated]
    counts = np.zeros(n * DIMENSIONS, dtype=np.int64)
    h = np.zeros(len(c), dtype=W.U64)
    for k in range(3):
        m = len(c) - k
        if m <= 0:
            break
        h = h[:m] * W.U64(0x9E3779B97F4A7C15) + c[k:] + W.U64(k + 1)
        same = row[:m] == row[k:]
        mixed = (h ^ (h >> W.U64(29))) * W.U64(0xBF58476D1CE4E5B9)
        cell = row[:m] * DIMENSIONS + (mixed >> W.U64(52)).astype(np.int64)
        counts += np.bincount(cell[same], minlength=len(counts))
    return counts.reshape(n, DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF rows of length one (a row without n-grams stays zero)."""
    x = np.log1p(counts).astype(np.float64) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def has_letter(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letter = (c >= 97) & (c <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[at[1:]] > sums[at[:-1]]
    for r in np.flatnonzero(~out):
        out[r] = any(chr(x).isalpha() for x in np.unique(c[at[r]: at[r + 1]]).tolist())
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bin occurs, and the number of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            data, offsets = W.text_buffer(b.column(0))
            for i, j in _groups(offsets):
                total += (gram_counts(*code_points(data, offsets[i: j + 1])) > 0).sum(axis=0)
            rows += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[rows], total]))], names=["bin", "n"])

    got = texts.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for r in got:
        if r["bin"] < 0:
            rows = r["n"]
        else:
            df[r["bin"]] = r["n"]
    return df, rows


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (DIMENSIONS + 1 bias) x classes of a softmax regression, by FTRL-proximal steps per example."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for idx, value, y in rows:
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            root = np.sqrt(ni + g * g)
            z[idx] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search on its logarithm.

    Targets are smoothed as if each class had one more example, so a sample
    without errors does not end in certainty.
    """
    if not len(y):
        return 1.0
    target = np.full(scores.shape, 1.0 / (len(y) + scores.shape[1]))
    target[np.arange(len(y)), y] += 1 - target.sum(axis=1)

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (s * target).sum(axis=1)).mean())

    a, b, g = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def first_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (id, label) of each label that come first by a hash of the id.

    Rows are counted per label and range of hashes; only ranges that begin before
    rank n are sorted, each by itself, so no label is sorted as a whole.
    """
    h = F.xxhash64("id")
    binned = rows.withColumn("h", h).withColumn("bin", F.shiftright("h", 64 - HASH_BITS))
    counts = binned.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    early = counts.withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0))).filter(F.col("ahead") < n).drop("c")
    inside = Window.partitionBy("label", "bin").orderBy("h", "id")
    ranked = binned.join(early, ["label", "bin"]).withColumn("r", F.row_number().over(inside)).filter(F.col("r") <= n)
    return ranked.filter(F.col("r") + F.col("ahead") <= n).select("id", "label")


def fit(docs: DataFrame, text: str, label: str, doc_id: str, per_language: int = 1000) -> dict | None:
    """A model from the rows of ``docs`` with text and label; None without such rows."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{label}`").cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    df, total = document_frequencies(rows.select("text"))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    chosen = first_of_each(rows.select("id", "label"), per_language)
    chosen = F.broadcast(chosen.select("id").distinct())  # at most per_language ids of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = W.text_buffer(b.column(1))
            for i, j in _groups(offsets):
                x = weighted(gram_counts(*code_points(data, offsets[i: j + 1])), idf)
                at = [np.flatnonzero(v) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(at, pa.list_(pa.int32())),
                     pa.array([v[k].astype(np.float32) for v, k in zip(x, at)], pa.list_(pa.float32()))],
                    names=["id", "label", "idx", "value"])

    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("value", T.ArrayType(T.FloatType()))])
    got = rows.join(chosen, "id").mapInArrow(run, schema).orderBy(F.xxhash64("id", F.lit(1)), "label").toArrow()
    labels = got.column("label").to_pylist()
    names = sorted(set(labels))
    if not names:
        return None
    of = {x: k for k, x in enumerate(names)}
    examples = [(np.append(i.values.to_numpy(), DIMENSIONS), np.append(v.values.to_numpy().astype(np.float64), 1.0), of[y])
                for i, v, y in zip(got.column("idx"), got.column("value"), labels)]
    del got
    split = len(examples) - len(examples) // 5
    weights = ftrl(examples[:split], len(names))
    rest = examples[split:]
    scores = np.array([v @ weights[i] for i, v, _ in rest]).reshape(-1, len(names))
    return {"names": names, "idf": idf, "weights": weights.astype(np.float32),
            "temperature": temperature(scores, np.array([y for *_, y in rest], dtype=np.int64))}


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (calibrated probability of it) to the columns ``keep``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Every row is judged on its whole text; input columns named like a
    result are replaced.
    """
    def run(column: pa.Array) -> list[pa.Array]:
        data, offsets = W.text_buffer(column)
        names, scores = [], []
        for i, j in _groups(offsets):
            c, at = code_points(data, offsets[i: j + 1])
            letters = has_letter(c, at)
            if model is None:
                letters[:] = False
                p = np.zeros((j - i, 1))
            else:
                x = weighted(gram_counts(c, at), model["idf"])
                s = (x @ model["weights"][:DIMENSIONS] + model["weights"][DIMENSIONS]) / model["temperature"]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [model["names"][k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            scores.append(np.where(letters, p.max(axis=1), 0.0))
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]

    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    keep = list(docs.columns) if keep is None else keep
    source = docs.withColumn("__text", F.col(f"`{text}`").cast("string"))
    return add_columns(source, ["__text"], schema, run, keep=keep)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs), "text", "lang", "doc_id")
    return (predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
