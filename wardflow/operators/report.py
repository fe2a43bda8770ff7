"""Comparison tables (ops A14, M11-M14, W5, W6, X8 use, S6 use).

Only the *data* of the reference's tables and figures is built (no LaTeX or
plot drawing): stratified descriptive tables, long-form metrics, shot x model
result grids with the best cell flagged, and reference-line attachment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERALL = "Overall"


def categorical_columns(df: DataFrame, cols: Sequence[str], *, max_levels: int = 10, exclude: Sequence[str] = ()) -> list[str]:
    """A14 helper: string columns, or columns with fewer than ``max_levels`` distinct
    values (one aggregate job). The group column is never categorical (Q14)."""
    cols = [c for c in cols if c not in set(exclude)]
    strings = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    others = [c for c in cols if c not in strings]
    if not others:
        return strings
    row = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in others]).collect()[0]
    return strings + [c for c in others if row[c] < max_levels]


def table_one(
    df: DataFrame, group: str, categorical: Sequence[str], continuous: Sequence[str]
) -> DataFrame:
    """Descriptive table overall and per group, in long form.

    Rows: ``variable='n'`` (group size); per categorical (variable, level):
    ``n`` and ``pct`` of the non-missing values; per continuous variable:
    ``mean``, ``sd`` (sample), plus ``n_missing`` for every variable. A column
    named in both lists gives both kinds of rows.

    One pass and one aggregation for any number of columns: a row becomes one
    entry per variable, counted for its group and for ``Overall`` and combined
    before the shuffle. The shares then come from the aggregated rows, in one
    window over the levels of a variable.
    """
    entry = "struct<kind:int,variable:string,level:string,x:double>"

    def item(kind: int, variable: str, level: Column | None = None, x: Column | None = None) -> Column:
        null = F.lit(None)
        return F.struct(F.lit(kind), F.lit(variable), null if level is None else level, null if x is None else x).cast(entry)

    entries = [item(0, "n"), *[item(1, c, level=F.col(c)) for c in categorical], *[item(2, c, x=F.col(c)) for c in continuous]]
    base = df.select(F.array(F.col(group).cast("string"), F.lit(OVERALL)).alias("__groups"), F.array(*entries).alias("__entries"))
    long = base.select("__groups", F.inline("__entries")).select(F.explode("__groups").alias("group"), "kind", "variable", "level", "x")
    cells = long.groupBy("group", "kind", "variable", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("valued"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    of_variable = Window.partitionBy("group", "kind", "variable")
    levels, numbers = F.col("kind") == 1, F.col("kind") == 2
    missing = F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("rows"))).over(of_variable), F.lit(0))
    named = F.sum(F.when(F.col("level").isNotNull(), F.col("rows"))).over(of_variable)
    cells = cells.select("*", missing.alias("missing"), named.alias("named")).filter(~levels | F.col("level").isNotNull())
    return cells.select(
        "group", "variable", "level",
        F.when(numbers, F.col("valued")).otherwise(F.col("rows")).alias("n"),
        F.when(levels, F.lit(100.0) * F.col("rows") / F.col("named")).alias("pct"),
        "mean", "sd",
        F.when(levels, F.col("missing")).when(numbers, F.col("rows") - F.col("valued")).otherwise(F.lit(0)).cast("long").alias("n_missing"),
    )


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics to long form (``Metric``, ``Score``)."""
    return df.unpivot(list(ids), list(metrics), "metric", "score")


def keep_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows whose ``value`` equals the maximum of their ``by`` group.

    The maximum comes from a grouped aggregate joined back (partial aggregation,
    no window holding a whole group in one task)."""
    mx = df.groupBy(*by).agg(F.max(value).alias("__max"))
    return df.join(mx, list(by), "inner").filter(F.col(value) == F.col("__max")).drop("__max")


def flag_best(df: DataFrame, by: Sequence[str], value: str, *, out: str = "is_best", tol: float = 1e-8) -> DataFrame:
    """Flag rows within ``tol`` of the best ``value`` of their ``by`` group."""
    mx = df.groupBy(*by).agg(F.max(value).alias("__max"))
    return df.join(mx, list(by), "left").withColumn(
        out, F.coalesce(F.abs(F.col(value) - F.col("__max")) < tol, F.lit(False))
    ).drop("__max")


def ci_cell(auc: Column, lo: Column, hi: Column, *, decimals: int = 3, missing: str = "--") -> Column:
    """M13 cell text ``auc [lo--hi]`` (``--`` when any part is missing)."""
    pattern = "0." + "0" * decimals

    def fmt(c: Column) -> Column:
        return F.call_function("format_number", c, F.lit(pattern))

    ok = auc.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.when(ok, F.concat(fmt(auc), F.lit(" ["), fmt(lo), F.lit("--"), fmt(hi), F.lit("]"))).otherwise(
        F.lit(missing)
    )


def result_table(
    metrics: DataFrame,
    row_keys: DataFrame,
    row_cols: Sequence[str],
    model_col: str,
    models: Sequence[str],
    *,
    auc: str = "auc",
    lo: str = "auc_ci_lower",
    hi: str = "auc_ci_upper",
    bold: tuple[str, str] = ("\\textbf{", "}"),
) -> DataFrame:
    """One row per ``row_keys`` row (complete grid, e.g. condition x shots),
    one text column per model: ``auc [lo--hi]``, the row's best AUC wrapped in
    ``bold``, ``--`` where not evaluated. The pivot values are fixed, so the
    schema is known without a pass over the data."""
    row_cols = list(row_cols)
    m = metrics.filter(F.col(model_col).isin(list(models)))
    m = flag_best(m, row_cols, auc)
    cell = ci_cell(F.col(auc), F.col(lo), F.col(hi))
    cell = F.when(F.col("is_best") & (cell != "--"), F.concat(F.lit(bold[0]), cell, F.lit(bold[1]))).otherwise(cell)
    cells = m.select(*row_cols, model_col, cell.alias("__cell"))
    wide = cells.groupBy(*row_cols).agg(
        *[F.max(F.when(F.col(model_col) == mod, F.col("__cell"))).alias(mod) for mod in models]
    )
    grid = row_keys.select(*row_cols).distinct().join(wide, row_cols, "left")
    return grid.select(*row_cols, *[F.coalesce(F.col(mod), F.lit("--")).alias(mod) for mod in models])


def sort_by_label(df: DataFrame, label: Column, *, then: Sequence[Column | str] = (), out: str | None = None) -> DataFrame:
    """O2: rows ordered by a derived label (``labels.model_label``, ``condition_label``) in code point
    order, then by ``then`` (the number of shots, say); null labels first. ``out`` keeps the label
    as a column. Spark sorts by range partitions, so the order holds for a table of any size
    when it is written or collected; it is no window."""
    name = out or "__label"
    ordered = df.withColumn(name, label).orderBy(F.col(name).asc_nulls_first(), *then)
    return ordered if out else ordered.drop(name)


def contains_ci(c: Column | str, text: str) -> Column:
    """case-insensitive substring test; null -> false."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(col).contains(text.lower()), F.lit(False))
