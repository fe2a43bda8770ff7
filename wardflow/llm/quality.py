"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of words are hashed into bins whose number follows the number of
distinct n-grams in the corpus (``GRAMS_PER_BIN``), so they stay as fine on a large
corpus as on a small one. Two multinomials, one over the documents that labels trust
and one over the whole corpus, give every bin a log ratio in millionths; a
document's score is the sum over its n-grams divided by their number. Sums are
of integers, so a score and the verdict do not depend on partitioning or order.

The ratios are a table with ``PACK`` bins a row, written to the shared folder. Up to
``IN_ROW_BINS`` bins it is one array that every document looks its n-grams up in,
without a shuffle; beyond, the n-grams of a document are counted per bin inside its
row and join the table. Both ways give the same sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table, written

#: at most so many distinct n-grams a bin, on average, but always this many bins at least
GRAMS_PER_BIN = 256
LEAST_BINS = 1 << 16
#: up to so many bins (4 bytes each) the ratios are looked up inside the row
IN_ROW_BINS = 1 << 22
#: up to so many trusted ids (8 bytes each) are broadcast, after they are counted; more are joined by shuffle
BROADCAST_IDS = 1 << 20
#: neighbouring bins in one row of the table
PACK = 64
UNIT = 1_000_000
BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def _joined(h: Column, step: int) -> Column:
    """Hashes of twice the length: entry i combines entries i and i + step."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def with_hashes(df: DataFrame, text: str, windows: bool) -> DataFrame:
    """Adds ``__w`` (words), ``__h1`` and ``__h2`` (hashes of words and pairs) and, if asked, ``__h8`` (8-word windows)."""
    df = df.withColumn("__w", word_array(F.col(text)))
    df = df.withColumn("__h1", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__h2", _joined(F.col("__h1"), 1))
    if windows:
        df = df.withColumn("__h4", _joined(F.col("__h2"), 2))
        df = df.withColumn("__h8", _joined(F.col("__h4"), 4)).drop("__h4")
    return df


def repeated_words(h8: Column, n: int = 8) -> Column:
    """Words inside a window whose hash occurs at least twice in ``h8``."""
    count = F.size(h8)
    placed = F.array_sort(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(F.slice(placed, F.lit(1), count - 1), F.slice(placed, F.lit(2), count - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(at, start, lambda acc, i: F.struct(
        (acc["total"] + (i + n - F.greatest(acc["end"], i))).cast("long").alias("total"), (i + n).alias("end")),
        lambda acc: acc["total"])
    return F.when(F.size(F.array_distinct(h8)) < count, covered).otherwise(F.lit(0).cast("long"))


def base_rules(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (needs ``with_hashes``)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    df = df.select(
        "*", F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"), repeated_words(F.col("__h8")).alias("n_repeat_words"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bin_of(h: Column, bins: int) -> Column:
    """Bin of a hash; ``bins`` is a power of two."""
    return h.bitwiseAND(F.lit(bins - 1).cast("long"))


def gram_counts(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, bins: int) -> DataFrame:
    """Rows (b, raw, target): the n-grams of each bin in all documents and in those of ``trusted`` (column ``doc_id``).

    Counts cover every document.
    """
    ids = written(trusted.select(F.col(f"`{doc_id}`").alias("__id")).filter("__id IS NOT NULL").distinct())
    yes = ids.withColumn("__yes", F.lit(1))
    marked = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text")).join(
        F.broadcast(yes) if ids.count() <= BROADCAST_IDS else yes, "__id", "left")
    grams = with_hashes(marked, "__text", windows=False).select(
        F.coalesce("__yes", F.lit(0)).alias("yes"), F.explode(F.concat("__h1", "__h2")).alias("h"))
    return grams.groupBy(bin_of(F.col("h"), bins).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("yes").alias("target"))


@dataclass
class Ratios:
    """Log ratios (in millionths) of ``bins`` bins: rows (g, ratios) with the bins from g * PACK on."""

    table: DataFrame
    bins: int


def ratio_table(docs: DataFrame, trusted: DataFrame, doc_id: str, text: str, grams_per_bin: int = GRAMS_PER_BIN,
                least_bins: int = LEAST_BINS, smoothing: float = 1.0) -> Ratios:
    """Log ratio of each bin between the documents in ``trusted`` and all.

    The number of bins is the smallest power of two, ``least_bins`` or more, that
    holds ``grams_per_bin`` distinct n-grams each (estimated to a few percent, the
    same at every run). Without trusted n-grams all ratios are 0.
    """
    hashed = with_hashes(docs.select(F.col(f"`{text}`").cast("string").alias("__text")), "__text", windows=False)
    size = hashed.select(F.explode(F.concat("__h1", "__h2")).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).first()
    grams = size["n"]
    bins = 1 << max(-(-size["d"] // grams_per_bin) - 1, least_bins - 1, 0).bit_length()
    counts = written(gram_counts(docs, trusted, doc_id, text, bins))
    trusted_total = counts.select(F.sum("target").alias("n")).first()["n"] or 0
    ratio = F.lit(0)
    if trusted_total:
        shift = math.log(trusted_total + smoothing * bins) - math.log(grams + smoothing * bins)
        ratio = F.rint(UNIT * (F.log(F.col("target") + smoothing) - F.log(F.col("raw") + smoothing) - shift)).cast("int")
    # bins without n-grams get their place, too
    empty = docs.sparkSession.range(bins).select(F.col("id").alias("b"), *[F.lit(0).cast("long").alias(c) for c in ("raw", "target")])
    full = counts.union(empty).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    packed = full.groupBy(F.floor(F.col("b") / PACK).alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", ratio.alias("ratio")))).alias("x"))
    return Ratios(written(packed.select("g", F.col("x.ratio").alias("ratios"))), bins)


def gram_sums(df: DataFrame, ratios: Ratios) -> DataFrame:
    """Rows (__key, __n, __sum): the summed ratio of each text in ``df(__key, __n, __h1, __h2)`` with n-grams.

    A text's n-grams are first counted per bin inside the row. Copies of a text
    are one row of the result.
    """
    at = F.transform(F.concat("__h1", "__h2"), lambda h: bin_of(h, ratios.bins))
    df = df.filter("__n > 0").select("__key", "__n", F.sort_array(at).alias("__b"))
    first = F.transform("__b", lambda b, i: F.when((i == 0) | (F.get("__b", i - 1) != b), i))
    df = df.withColumn("__at", F.filter(first, lambda i: i.isNotNull()))
    after = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(F.size("__b")))
    runs = F.zip_with("__at", after, lambda i, j: F.struct(F.get("__b", i).alias("b"), (j - i).alias("c")))
    rows = df.select("__key", "__n", F.inline(runs)).withColumn("g", F.shiftright("b", PACK.bit_length() - 1)).join(ratios.table, "g")
    sums = rows.groupBy("__key", "__n").agg(F.sum("c").alias("c"),
                                            F.sum(F.col("c").cast("long") * F.get("ratios", (F.col("b") % PACK).cast("int"))).alias("s"))
    # c is __n times the copies of the text
    return sums.select("__key", "__n", F.expr("s div (c div __n)").alias("__sum"))


def judge(docs: DataFrame, ratios: Ratios, text: str = "text", least: float = -0.1, in_row_bins: int = IN_ROW_BINS) -> DataFrame:
    """Adds the base counts, ``score`` (mean log ratio per n-gram; 0 without words) and ``kept``.

    A document stays if the base rules do not fail it and its summed ratio is
    at least ``least`` times its number of n-grams. Null and empty texts have
    no words and fail; repeated rows are each judged; input columns named like
    a result are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new or c == text],
                     F.col(f"`{text}`").cast("string").alias("__text"))
    df = base_rules(with_hashes(df, "__text", windows=True), "__text")
    df = df.withColumn("__n", (F.size("__h1") + F.size("__h2")).cast("long"))
    if ratios.bins <= in_row_bins:
        packed = F.array_sort(F.collect_list(F.struct("g", "ratios")))
        flat = ratios.table.select(F.flatten(F.transform(packed, lambda r: r["ratios"])).alias("r")).scalar()
        # the plan holds the subquery's value once; no row carries it
        df = df.withColumn("__table", flat).withColumn("__sum", F.aggregate(
            F.concat("__h1", "__h2"), F.lit(0).cast("long"),
            lambda acc, h: acc + F.get("__table", bin_of(h, ratios.bins).cast("int")))).drop("__table")
    else:
        key = F.xxhash64("__text")
        texts = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))
        texts = with_hashes(texts, "__text", windows=False).select(
            key.alias("__key"), (F.size("__h1") + F.size("__h2")).cast("long").alias("__n"), "__h1", "__h2")
        df = df.withColumn("__key", key).join(gram_sums(texts, ratios), ["__key", "__n"], "left").withColumn(
            "__sum", F.coalesce("__sum", F.lit(0).cast("long"))).drop("__key")
    df = df.withColumn("score", F.coalesce(F.try_divide(F.col("__sum"), F.col("__n") * F.lit(float(UNIT))), F.lit(0.0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("__sum") >= F.lit(round(least * UNIT)).cast("long") * F.col("__n")))
    return df.drop("__text", "__w", "__h1", "__h2", "__h8", "__n", "__sum")


def trusted_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the likelihood-ratio verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = ratio_table(docs, trusted_labels(table(spark, sf_dir, "labels")), "doc_id", "text")
    return judge(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept", "score")
