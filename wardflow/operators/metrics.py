"""Classification metrics per group (ops M1-M9, W7, N5).

Every metric starts from a *score histogram*: one row per (group, distinct
score) with the (weighted) number of positives and negatives. Ties are thereby
collapsed before any ordering, and the running totals over scores are computed
with the two-level ``prefix_sum`` so that one huge group never lands in one
task. Labels are 0/1 (or boolean); rows with a null label or score are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.random import key_bits, mixed_uniform, poisson_weight
from wardflow.operators.scan import float_bin, join_groups, next_value, prefix_sum

SCORE = "score"


def _y(label: str) -> Column:
    return F.col(label).cast("int").cast("double")


def clean_scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """drop rows whose label or score is null (or NaN)."""
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score)))


def score_histogram(
    df: DataFrame, group_cols: Sequence[str], label: str, score: str, *, weight: Column | None = None
) -> DataFrame:
    """(group, score, pos, neg): weighted label counts per distinct score."""
    w = weight if weight is not None else F.lit(1.0)
    y = _y(label)
    return (
        clean_scored(df, label, score)
        .groupBy(*group_cols, F.col(score).cast("double").alias(SCORE))
        .agg(F.sum(w * y).alias("pos"), F.sum(w * (F.lit(1.0) - y)).alias("neg"))
    )


def auc_from_histogram(hist: DataFrame, group_cols: Sequence[str], *, out: str = "auc") -> DataFrame:
    """M2: ROC AUC with ties counted half: sum(pos * (neg below + neg/2)) / (P * N).

    The sum splits at monotone score bins: pairs inside a bin come from a
    running sum over (group, bin) reduced at once to one row per bin; pairs
    across bins come from a window over that small per-bin table. The big
    table is therefore sorted once and never joined back. Groups with a
    single class get a null AUC.
    """
    g = list(group_cols)
    b = "__bin"
    w_in = (
        Window.partitionBy(*g, b).orderBy(F.col(SCORE).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = hist.withColumn(b, float_bin(SCORE)).withColumn(
        "__below", F.coalesce(F.sum("neg").over(w_in), F.lit(0.0))
    )
    per_bin = local.groupBy(*g, b).agg(
        F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2.0)).alias("__within"),
        F.sum("pos").alias("__pos"),
        F.sum("neg").alias("__neg"),
    )
    w_bins = Window.partitionBy(*g).orderBy(F.col(b).asc()).rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("__negbelow", F.coalesce(F.sum("__neg").over(w_bins), F.lit(0.0)))
    num = F.sum(F.col("__within") + F.col("__pos") * F.col("__negbelow"))
    p, n = F.sum("__pos"), F.sum("__neg")
    return per_bin.groupBy(*g).agg(
        F.when((p > 0) & (n > 0), num / (p * n)).alias(out), p.alias("n_pos"), n.alias("n_neg")
    )


def auc(df: DataFrame, group_cols: Sequence[str], label: str, score: str, *, out: str = "auc") -> DataFrame:
    """M2 on raw rows."""
    return auc_from_histogram(score_histogram(df, group_cols, label, score), group_cols, out=out)


def average_precision_from_histogram(hist: DataFrame, group_cols: Sequence[str], *, out: str = "ap") -> DataFrame:
    """M3: sum over distinct thresholds (descending) of (R_i - R_{i-1}) * P_i."""
    h = prefix_sum(hist, group_cols, [SCORE], ["pos", "neg"], float_bin(SCORE), descending=True, prefix="tp_")
    prec = F.col("tp_pos") / (F.col("tp_pos") + F.col("tp_neg"))
    p = F.sum("pos")
    return h.groupBy(*group_cols).agg(
        F.when(p > 0, F.sum(F.when(F.col("pos") > 0, F.col("pos") * prec).otherwise(0.0)) / p).alias(out)
    )


def roc_points(df: DataFrame, group_cols: Sequence[str], label: str, score: str, *, drop_intermediate: bool = False) -> DataFrame:
    """M1: (group, threshold, fpr, tpr) for every distinct score, descending,
    plus the point (0, 0) at threshold +infinity.

    ``drop_intermediate`` leaves out the points inside straight runs, as plots of
    the curve do: those where a step and the next one add equally many true and
    false positives. The first and the last score stay. The area does not change.
    """
    hist = score_histogram(df, group_cols, label, score)
    h = prefix_sum(hist, group_cols, [SCORE], ["pos", "neg"], float_bin(SCORE), descending=True, prefix="c_")
    tot = hist.groupBy(*group_cols).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    if drop_intermediate:
        h = next_value(h, group_cols, [SCORE], ["pos", "neg"], float_bin(SCORE), descending=True)
        straight = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        first = F.col("c_pos") + F.col("c_neg") == F.col("pos") + F.col("neg")
        h = h.filter(first | ~F.coalesce(straight, F.lit(False)))
    pts = join_groups(h, tot, list(group_cols)).select(
        *group_cols,
        F.col(SCORE).alias("threshold"),
        F.when(F.col("__N") > 0, F.col("c_neg") / F.col("__N")).alias("fpr"),
        F.when(F.col("__P") > 0, F.col("c_pos") / F.col("__P")).alias("tpr"),
    )
    first = tot.select(
        *group_cols, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(first)


def threshold_from_histogram(
    hist: DataFrame, group_cols: Sequence[str], *, threshold: float = 0.5, inclusive: bool = True
) -> DataFrame:
    """M4 from a score histogram."""
    pred = F.col(SCORE) >= threshold if inclusive else F.col(SCORE) > threshold
    count = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0.0)).cast("long")
    agg = hist.groupBy(*group_cols).agg(count("pos", pred).alias("tp"), count("neg", pred).alias("fp"),
                                        count("pos", ~pred).alias("fn"), count("neg", ~pred).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    tp_, fp_, fn_, tn_ = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        *group_cols, "tp", "fp", "fn", "tn",
        ratio(tp_ + tn_, tp_ + fp_ + fn_ + tn_).alias("accuracy"),
        ratio(tp_, tp_ + fp_).alias("precision"),
        ratio(tp_, tp_ + fn_).alias("recall"),
        ratio(2 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"),
    )


def threshold_metrics(
    df: DataFrame,
    group_cols: Sequence[str],
    label: str,
    score: str,
    *,
    threshold: float = 0.5,
    inclusive: bool = True,
) -> DataFrame:
    """M4: confusion counts, accuracy, precision, recall, F1 (0 on zero division).

    ``inclusive=True`` predicts positive for ``score >= threshold``, else ``>``.
    """
    return threshold_from_histogram(score_histogram(df, group_cols, label, score), group_cols,
                                    threshold=threshold, inclusive=inclusive)


def auc_standard_error(df: DataFrame, group_cols: Sequence[str], label: str, score: str, *, out: str = "auc_se") -> DataFrame:
    """Closed-form standard error of the AUC per group (DeLong): the spread over positives of
    the share of negatives below, and over negatives of the share of positives above, ties half.

    Null where a class has fewer than two rows.
    """
    g = list(group_cols)
    hist = score_histogram(df, g, label, score)
    h = prefix_sum(hist, g, [SCORE], ["pos", "neg"], float_bin(SCORE), prefix="c_")
    tot = hist.groupBy(*g).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    below = (F.col("c_neg") - F.col("neg") / 2.0) / F.col("__N")
    above = (F.col("__P") - F.col("c_pos") + F.col("pos") / 2.0) / F.col("__P")

    def spread(n: str, v: Column) -> Column:
        total = F.sum(n)
        var = F.sum(F.col(n) * v * v) - F.sum(F.col(n) * v) * F.sum(F.col(n) * v) / total
        return F.when(total > 1, var / (total - 1) / total)

    return join_groups(h, tot.filter("__P > 0 AND __N > 0"), g).groupBy(*g).agg(
        F.sqrt(spread("pos", below) + spread("neg", above)).alias(out))


def bootstrap_auc(
    df: DataFrame,
    group_cols: Sequence[str],
    label: str,
    score: str,
    key: str,
    *,
    n_boot: int = 100,
    seed: int = 42,
    binned: bool = False,
    method: str = "blocks",
) -> DataFrame:
    """AUC with a bootstrap distribution per group.

    Output per group: ``auc`` (point), ``auc_mean``, ``auc_std`` (population),
    ``auc_ci_lower``/``auc_ci_upper`` (2.5 / 97.5 percentiles, linear
    interpolation) and ``n_boot_used`` (replicates with both classes; the rest
    are skipped as in the reference).

    Resampling is a Poisson(1) bootstrap: replicate r gives row ``key`` (an id
    of any type) the weight Poisson(1) drawn from ``mixed_uniform(key_bits(key),
    r, seed)`` - reproducible, no shuffle of rows, and each replicate is reduced to a weighted score histogram right
    after the (map-side) expansion. The reference draws exactly n rows with
    replacement; Poisson weights draw n on average, so intervals agree in
    distribution, not in digits.

    ``method="blocks"`` (default for the row-level form) evaluates the
    replicates in vectorised chunks over range partitions
    (``operators/bootstrap_blocks.py``); ``method="sql"`` expands rows x
    replicates as DataFrame rows. Both use the same weights and give the same
    numbers (the SQL form is the oracle's).

    ``binned=True`` draws exactly n rows per replicate, as the reference does: rows
    collapse to (score, label) cells, whose multinomial counts are dealt by
    conditional binomials (``operators/bootstrap_exact.py``). Its cost is one draw
    per cell and replicate, however many rows a cell holds; ``key`` is not used.

    Null group keys are groups of their own.
    """
    if method not in ("blocks", "sql"):
        raise ValueError("method must be 'blocks' or 'sql'")
    names = list(group_cols)
    # one 64-bit id replaces the (possibly string) group keys on the B-fold data
    gid = F.xxhash64(*[x for c in names for x in (F.col(c), F.col(c).isNull())]) if names else F.lit(0).cast("long")
    base = clean_scored(df, label, score).withColumn("__gid", gid)
    group_names = base.groupBy("__gid").agg(F.lit(1).alias("__named"), *[F.first(c).alias(c) for c in names])
    base = base.drop(*names)
    group_cols = ["__gid"]
    point = auc(base, group_cols, label, score)
    if binned:
        from wardflow.operators.bootstrap_exact import replicate_aucs_exact

        per_rep = replicate_aucs_exact(score_histogram(base, group_cols, label, score), n_boot=n_boot, seed=seed)
    elif method == "sql":
        # Weights from the counter-based integer hash of (key, replicate): cheap,
        # whole-stage-codegen friendly and reproducible in SQL. The uniform is
        # its own projection, so the inverse-CDF sum refers to an attribute.
        # Spread the n input rows before the B-fold expansion (an n-row shuffle
        # against n*B rows of work): a small or single-file input would
        # otherwise expand and aggregate in one task.
        parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        grid = base.withColumn("__bits", key_bits(F.col(key))).repartition(parts, F.col("__bits")).select(
            *group_cols, "__bits", label, score, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
        grid = grid.withColumn("__u", mixed_uniform(F.col("__bits"), F.col("rep"), seed))
        weighted = grid.withColumn("__w", poisson_weight(F.col("__u")).cast("double"))
        hist = score_histogram(weighted, [*group_cols, "rep"], label, score, weight=F.col("__w"))
        hist = hist.filter((F.col("pos") > 0) | (F.col("neg") > 0))
        per_rep = auc_from_histogram(hist, [*group_cols, "rep"], out="__auc").filter(F.col("__auc").isNotNull())
    else:
        from wardflow.operators.bootstrap_blocks import replicate_aucs

        per_rep = replicate_aucs(base, label, score, key, n_boot=n_boot, seed=seed)
    dist = per_rep.groupBy(*group_cols).agg(
        F.avg("__auc").alias("auc_mean"),
        F.stddev_pop("__auc").alias("auc_std"),
        F.percentile(F.col("__auc"), F.array(F.lit(0.025), F.lit(0.975))).alias("__ci"),
        F.count(F.lit(1)).alias("n_boot_used"),
    )
    # Assemble point AUC, replicate statistics and group names per group id with a
    # union and one aggregate (no joins: a constant group key would otherwise be
    # folded into a cartesian join).
    stats = ["auc", "auc_mean", "auc_std", "auc_ci_lower", "auc_ci_upper", "n_boot_used"]
    parts = [
        point.select("__gid", "auc"),
        dist.select("__gid", "auc_mean", "auc_std", F.col("__ci")[0].alias("auc_ci_lower"),
                    F.col("__ci")[1].alias("auc_ci_upper"), "n_boot_used"),
        group_names,
    ]
    stacked = parts[0]
    for p_ in parts[1:]:
        stacked = stacked.unionByName(p_, allowMissingColumns=True)
    out = stacked.groupBy("__gid").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in names + stats], F.max("__named").alias("__named"),
    )
    return out.filter(F.col("__named").isNotNull()).select(
        *names, *stats[:-1], F.coalesce(F.col("n_boot_used"), F.lit(0)).alias("n_boot_used"),
    )


def missing_share(df: DataFrame, group_cols: Sequence[str], score: str) -> DataFrame:
    """M7: share of rows whose prediction is missing, and the counts."""
    miss = F.col(score).isNull()
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(miss).alias("n_missing"),
        F.avg(miss.cast("double")).alias("missing_share"),
    )


def rates(df: DataFrame, group_cols: Sequence[str], label: str, score: str) -> DataFrame:
    """M8: event rate and mean prediction."""
    d = clean_scored(df, label, score)
    return d.groupBy(*group_cols).agg(
        F.avg(_y(label)).alias("event_rate"), F.avg(F.col(score)).alias("mean_prediction"),
        F.count(F.lit(1)).alias("n"),
    )


def summary_metrics(
    df: DataFrame,
    group_cols: Sequence[str],
    label: str,
    score: str,
    key: str,
    *,
    n_boot: int = 1000,
    seed: int = 42,
    threshold: float = 0.5,
    binned: bool = False,
) -> DataFrame:
    """M9: per group AUC, percentile CI, AP, accuracy, F1, precision, recall.

    Groups with fewer than 2 rows or a single class are dropped (as the reference does).
    """
    d = clean_scored(df, label, score)
    # one histogram serves average precision, thresholds and the check for both classes
    hist = score_histogram(d, group_cols, label, score)
    boot = bootstrap_auc(d, group_cols, label, score, key, n_boot=n_boot, seed=seed, binned=binned)
    ap = average_precision_from_histogram(hist, group_cols)
    thr = threshold_from_histogram(hist, group_cols, threshold=threshold).filter("tp + fn > 0 AND fp + tn > 0")
    g = list(group_cols)
    return (
        join_groups(join_groups(thr, ap, g), boot, g)
        .select(
            *g,
            F.col("auc").alias("AUC"),
            F.col("auc_ci_lower").alias("AUC_CI_Low"),
            F.col("auc_ci_upper").alias("AUC_CI_High"),
            F.col("ap").alias("AP"),
            F.col("accuracy").alias("Accuracy"),
            F.col("f1").alias("F1 Score"),
            F.col("precision").alias("Precision"),
            F.col("recall").alias("Recall"),
        )
    )
