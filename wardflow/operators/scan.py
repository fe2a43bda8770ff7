"""Distributed ordered scans: prefix sums and exact ranks without one-task groups.

A window ``partitionBy(group).orderBy(x)`` sends every row of a group to one
task; with one group holding a third of the data that task is the whole job.
The helpers here compute the same running totals in two levels:

1. each row gets a *bin* that is monotone in the order key;
2. totals per (group, bin) are aggregated (map-side combined, tiny) and turned
   into exclusive offsets by a window over the bin table, which has at most
   one row per non-empty bin;
3. a window over (group, bin) gives the running total inside the bin and the
   offset is added back with an equi-join on (group, bin).

The result is identical to the single window (it is the same sum, split at bin
boundaries). A null group key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mantissa resolution of ``float_bin``: bins per power of two.
BINS_PER_OCTAVE = 256
# Exponent offset so that every finite double gets a positive code.
_EXP_OFFSET = 1100
# bin of a row without an order key, which sorts before all others
NULL_BIN = -(1 << 62)


def float_bin(x: Column | str, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Monotone, scale-free integer bin of a double (like its float bit pattern).

    ``|x| = 2^e * (1 + m)`` gives the code ``(e + offset) * per_octave +
    floor(m * per_octave)``; negative values mirror, zero is 0. Rounding in
    ``log2`` only moves a value to the neighbouring code, so order is kept.
    """
    x = F.col(x) if isinstance(x, str) else x
    a = F.abs(x)
    e = F.floor(F.log2(a))
    m = a / F.pow(F.lit(2.0), e) - 1.0
    code = (e + _EXP_OFFSET) * per_octave + F.floor(m * per_octave)
    end = F.lit(4 * _EXP_OFFSET * per_octave)  # beyond every finite double
    infinite = a == F.lit(float("inf"))
    return (F.when(infinite & (x > 0), end).when(infinite, -end)
            .when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0)).cast("long"))


def null_safe_keys(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds non-null key columns that are equal exactly where ``cols`` are (null equals null).

    Joins and windows on them keep one hash partitioning, which a ``<=>`` join would not.
    """
    names = [f"__{part}{i}" for i in range(len(cols)) for part in ("k", "z")]
    keys = [k for c in cols for k in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]
    return df.select("*", *[k.alias(n) for n, k in zip(names, keys)]), names


def join_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-group tables on ``cols``, null matching null."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    on = None
    for c in cols:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*[f"__r_{c}" for c in cols])


# a table of at most this many keys is looked up in memory
LOOKUP_KEYS = 100_000


def join_per_key(rows: DataFrame, table: DataFrame, key: str, size: str, keys: int, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and the key's number of rows in ``size``.

    ``keys`` and ``total`` are the sums over ``table`` of 1 and of ``size``. A small
    table is broadcast, so the rows stay where they are. Of a large one the keys
    of at least ``total / LOOKUP_KEYS`` rows are, and only the rows of the other
    keys move by key: no task gets the rows of a frequent key.
    """
    if keys <= LOOKUP_KEYS:
        return rows.join(F.broadcast(table.drop(size)), key)
    frequent = F.col(size) * LOOKUP_KEYS >= total
    looked_up = rows.join(F.broadcast(table.filter(frequent).drop(size).withColumn("__found", F.lit(True))), key, "left")
    found = looked_up.filter("__found").drop("__found")
    rest = looked_up.filter("__found IS NULL").select(*rows.columns).join(table.filter(~frequent).drop(size), key)
    return found.unionByName(rest)


def hash_bin(hex_col: Column | str, digits: int = 4) -> Column:
    """Bin of an md5 hex string: its first ``digits`` hex digits as a number."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def _order(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def prefix_sum(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    bin_col: Column,
    *,
    descending: bool = False,
    inclusive: bool = True,
    prefix: str = "cum_",
) -> DataFrame:
    """Add ``cum_<v>``: running sum of ``v`` in ``order_cols`` order inside each group.

    ``bin_col`` must be non-decreasing in the order of ``order_cols``
    (ascending order). Rows should be unique per (group, order_cols); with
    duplicates the running sum follows an arbitrary but fixed order among them.
    ``inclusive=False`` gives the sum over strictly earlier rows.
    """
    b = "__bin"
    binned, group_cols = null_safe_keys(df, list(group_cols))
    binned = binned.withColumn(b, bin_col)
    totals = binned.groupBy(*group_cols, b).agg(*[F.sum(v).alias(f"__tot_{v}") for v in value_cols])
    bin_w = (
        Window.partitionBy(*group_cols)
        .orderBy(F.col(b).desc() if descending else F.col(b).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group_cols,
        b,
        *[F.coalesce(F.sum(f"__tot_{v}").over(bin_w), F.lit(0)).alias(f"__off_{v}") for v in value_cols],
    )
    end = 0 if inclusive else -1
    row_w = (
        Window.partitionBy(*group_cols, b)
        .orderBy(*_order(order_cols, descending))
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = binned.select(
        "*", *[F.coalesce(F.sum(v).over(row_w), F.lit(0)).alias(f"__loc_{v}") for v in value_cols]
    )
    joined = local.join(offsets, on=[*group_cols, b], how="inner")
    out = joined.select(
        *[c for c in df.columns],
        *[(F.col(f"__off_{v}") + F.col(f"__loc_{v}")).alias(f"{prefix}{v}") for v in value_cols],
    )
    return out


def last_value(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    bin_col: Column,
    *,
    prefix: str = "last_",
) -> DataFrame:
    """Add ``last_<v>``: the last non-null ``v`` at or before each row, in ``order_cols`` order inside each group.

    The companion of ``prefix_sum`` for a carry that does not add up: the last
    non-null value of each (group, bin) is carried over the small bin table, and
    rows fill inside their bin, so one group spreads over its bins. ``bin_col``
    must be non-decreasing in the order. Rows of the same order key read as one
    another's past in an arbitrary but fixed order.
    """
    b = "__bin"
    binned, keys = null_safe_keys(df, list(group_cols))
    binned = binned.withColumn(b, F.coalesce(bin_col.cast("long"), F.lit(NULL_BIN)))
    order = F.struct(*order_cols)
    lasts = binned.groupBy(*keys, b).agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(f"__end_{v}") for v in value_cols])
    over_bins = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, b, *[F.last(f"__end_{v}", ignorenulls=True).over(over_bins).alias(f"__carry_{v}") for v in value_cols])
    inside = Window.partitionBy(*keys, b).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = binned.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"__local_{v}") for v in value_cols])
    return local.join(carried, [*keys, b]).select(
        *df.columns, *[F.coalesce(f"__local_{v}", f"__carry_{v}").alias(f"{prefix}{v}") for v in value_cols])


def next_value(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    bin_col: Column,
    *,
    descending: bool = False,
    prefix: str = "next_",
) -> DataFrame:
    """Add ``next_<v>``: ``v`` of the next row in ``order_cols`` order inside each group (null for the last row).

    A bin hands the values of its first row to the bin before it, so a group
    spreads over its bins. Rows should be unique per (group, order_cols).
    """
    b = "__bin"
    binned, keys = null_safe_keys(df, list(group_cols))
    binned = binned.withColumn(b, F.coalesce(bin_col.cast("long"), F.lit(NULL_BIN)))
    first = (F.max_by if descending else F.min_by)(F.struct(*value_cols), F.struct(*order_cols))
    firsts = binned.groupBy(*keys, b).agg(first.alias("__first"))
    over_bins = Window.partitionBy(*keys).orderBy(F.col(b).desc() if descending else F.col(b).asc())
    handed = firsts.select(*keys, b, F.lead("__first").over(over_bins).alias("__handed"))
    inside = Window.partitionBy(*keys, b).orderBy(*_order(order_cols, descending))
    local = binned.select("*", F.lead(F.struct(*value_cols)).over(inside).alias("__next"))
    return local.join(handed, [*keys, b]).withColumn("__next", F.coalesce("__next", "__handed")).select(
        *df.columns, *[F.col("__next")[v].alias(f"{prefix}{v}") for v in value_cols])


def hash_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    key_col: str,
    seed: int,
    *,
    rank_col: str = "rank",
    hash_col: str = "__hash",
    max_rank: int | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """0-based exact rank of each row inside its group in ``md5(key:seed), key`` order.

    Equal to ``row_number() over (partition by group order by md5(key||':'||seed),
    key) - 1`` but computed with per-bin offsets, so a group of any size is
    spread over many tasks. ``key_col`` must be unique within a group.

    With ``max_rank`` only rows of rank < max_rank are returned, and rows in hash
    bins whose offset already reaches ``max_rank`` are dropped *before* the
    window: a few-shot sample of n rows sorts a handful of bins per group, not
    the whole group. ``size_col`` adds the size of the row's group (from the bin
    totals, without another pass).
    """
    from wardflow.functions.random import hash_key

    b = "__bin"
    keyed, g = null_safe_keys(df, list(group_cols))
    hashed = keyed.withColumn(hash_col, hash_key(F.col(key_col), F.lit(seed))).withColumn(b, hash_bin(F.col(hash_col)))
    totals = hashed.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__tot"))
    w_bins = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, b, F.coalesce(F.sum("__tot").over(w_bins), F.lit(0)).alias("__off"),
                            F.sum("__tot").over(Window.partitionBy(*g)).alias(size_col or "__size"))
    if max_rank is not None:
        offsets = offsets.filter(F.col("__off") < max_rank)
    rows = hashed.join(offsets, on=[*g, b], how="inner")
    w_in = Window.partitionBy(*g, b).orderBy(hash_col, key_col)
    ranked = rows.withColumn(rank_col, (F.col("__off") + F.row_number().over(w_in) - 1).cast("long"))
    if max_rank is not None:
        ranked = ranked.filter(F.col(rank_col) < max_rank)
    return ranked.select(*df.columns, rank_col, *([size_col] if size_col else []))
