"""Readers, writers and input checks (ops S1-S13).

Parquet is the default format; CSV always with an explicit schema (never
``inferSchema``, which costs a full extra pass over the data).
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.session import data_path

# Schema of a predictions table (the central fact table of the evaluation).
PREDICTIONS_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("model_args", T.StringType()),
        T.StructField("num_shots", T.IntegerType()),
        T.StructField("auc_ci_lower", T.DoubleType()),
        T.StructField("auc_ci_upper", T.DoubleType()),
        T.StructField("global_icu_stay_id", T.StringType()),
        T.StructField("actual_label", T.StringType()),
        T.StructField("predicted_probability", T.StringType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one table (projection and filters push down)."""
    return spark.read.parquet(data_path(sf_dir, name))


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """S3: overwrite a Parquet dataset."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with header and an explicit schema; columns matched by header name."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )


def write_csv(df: DataFrame, path: str, *, decimals: int | None = None) -> None:
    """CSV with header; doubles optionally fixed to ``decimals`` places."""
    if decimals is not None:
        fmt = "0." + "0" * decimals if decimals > 0 else "0"
        df = df.select(
            *[
                F.call_function("format_number", F.col(f.name), F.lit(fmt)).alias(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    df.write.mode("overwrite").option("header", True).csv(path)


def header_families(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """Header line -> files that start with it, for CSV files that may differ in column order.

    The first line of each file is the first row of the split that starts at
    byte 0; files without any line are left out.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    first = (lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id())
             .groupBy("path").agg(F.min_by("value", "at").alias("header")).collect())
    out: dict[str, list[str]] = {}
    for r in sorted(first, key=lambda r: r["path"]):
        out.setdefault(r["header"], []).append(r["path"])
    return out


def read_csv_by_name(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """S4 for files whose header order differs from ``schema`` or from each other:
    files with the same header are read together as text columns named by it (no
    type inference pass), then the schema's columns are selected and cast by
    name. A column that a file lacks is null."""
    parts = []
    for files in header_families(spark, paths).values():
        raw = spark.read.option("header", True).option("inferSchema", False).csv(files)
        parts.append(raw.select(
            *[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in schema.fields],
            F.col("_metadata.file_name").alias("__file"),
        ))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("__file", T.StringType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_csv_checked(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, *, file_col: str = "file_name"
) -> tuple[DataFrame, DataFrame]:
    """S4/S6 for files that may hold malformed lines: (good rows, quarantine).

    Every non-blank line but the header is in exactly one of both. Good rows have
    the schema's columns, matched by each file's header, and ``file_col``; the
    quarantine has (``file_col``, line, reason). Reasons: ``unclosed quote`` (an odd number
    of quotes), ``number of fields`` (shorter or longer than the header) and ``value`` (a
    field that its type cannot hold). A record is one line; lines equal to the
    header are left out.
    """
    types = {f.name: f.dataType for f in schema.fields}
    good, bad = [], []
    for header, files in header_families(spark, paths).items():
        names = next(csv.reader([header]))
        lines = spark.read.text(files).select("value", F.col("_metadata.file_name").alias("__file")).filter(
            (F.trim("value") != "") & (F.col("value") != header))

        def parsed(as_text: bool, names=names) -> Column:
            fields = [T.StructField(n, T.StringType() if as_text else types.get(n, T.StringType())) for n in names]
            fields.append(T.StructField("__bad", T.StringType()))
            return F.from_csv("value", T.StructType(fields).toDDL(),
                              {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "escape": '"'})

        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        reason = (F.when(quotes % 2 == 1, "unclosed quote").when(F.col("__text")["__bad"].isNotNull(), "number of fields")
                  .when(F.col("__typed")["__bad"].isNotNull(), "value"))
        rows = lines.select("*", parsed(True).alias("__text"), parsed(False).alias("__typed")).withColumn("reason", reason)
        good.append(rows.filter("reason IS NULL").select(
            *[(F.col("__typed")[n] if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()], F.col("__file").alias(file_col)))
        bad.append(rows.filter("reason IS NOT NULL").select(F.col("__file").alias(file_col), F.col("value").alias("line"), "reason"))
    if not good:
        text = T.StringType()
        return (spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(file_col, text)])),
                spark.createDataFrame([], T.StructType([T.StructField(c, text) for c in (file_col, "line", "reason")])))
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)


def read_with_provenance(
    spark: SparkSession, path_groups: Sequence[str | Sequence[str]], schema: T.StructType, *, file_col: str = "file_name"
) -> DataFrame:
    """Union of several globs of result files, whose files may each have
    their own column order; columns are matched by each file's header, each row
    keeping its source file name. Empty files contribute no rows."""
    parts = [read_csv_by_name(spark, g, schema).withColumnRenamed("__file", file_col) for g in path_groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_text(df: DataFrame, text_col: str, path: str) -> None:
    """One record per line."""
    df.select(F.col(text_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_id_text(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """S10 (write): ``id<TAB>text`` lines."""
    df.select(F.concat_ws("\t", F.col(id_col).cast("string"), F.col(text_col)).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def parse_id_text(lines: DataFrame, *, value_col: str = "value", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """S10 (read): split each trimmed line at the first tab; lines without a tab are dropped."""
    v = F.trim(F.col(value_col))
    parts = F.split(v, "\t", 2)
    return (
        lines.filter(v != "")
        .select(parts.alias("__p"))
        .filter(F.size("__p") == 2)
        .select(F.col("__p")[0].alias(id_col), F.col("__p")[1].alias(text_col))
    )


# Fixed value: the record id pattern of serialized summaries (must equal the reference's).
RECORD_ID_PATTERN = r"Patient ID:\s*(\S+?)\s*\."


def parse_records(
    lines: DataFrame, *, value_col: str = "value", id_col: str = "id", text_col: str = "text",
    id_pattern: str = RECORD_ID_PATTERN,
) -> DataFrame:
    """Trimmed non-blank lines whose id is found by ``id_pattern``; others dropped."""
    v = F.trim(F.col(value_col))
    found = F.regexp_extract(v, id_pattern, 1)
    return lines.filter(v != "").select(found.alias(id_col), v.alias(text_col)).filter(F.col(id_col) != "")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail at plan time when columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail when nothing was read (one cheap ``isEmpty`` job)."""
    if df.isEmpty():
        raise ValueError(f"no rows could be loaded from {what}")
    return df


def check_feature_options(*, hourly: bool = False, stats: bool = False, minmax: bool = False,
                          forward_fill: bool = False) -> None:
    """Forbidden option pairs of the feature builder."""
    if hourly and minmax:
        raise ValueError("hourly and minmax cannot be combined")
    if stats and minmax:
        raise ValueError("stats and minmax cannot be combined")
    if forward_fill and not hourly:
        raise ValueError("forward_fill needs hourly")


def write_sorted(df: DataFrame, path: str, entity: str, time: str, *, partitions: int | None = None) -> None:
    """O1: write ordered by (entity, time). Range partitioning on both keys (not a
    hash on the entity) splits a hot entity over several files by time; rows
    are sorted inside each partition, so readers see entity-time runs."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (df.repartitionByRange(n, entity, time).sortWithinPartitions(entity, time)
       .write.mode("overwrite").parquet(path))


def write_bucketed(
    df: DataFrame, name: str, path: str, keys: Sequence[str], *, sort: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """S3/O1: store ``df`` bucketed by ``keys`` and sorted inside buckets by ``keys`` and ``sort``
    (files under ``path``, table ``name`` in the session's catalogue), and return the stored table.

    Tables with the same bucket keys and number of buckets join and aggregate on
    these keys without a shuffle, however often they are read. One shuffle at
    write time gives one file per bucket. A key's rows share a bucket: where one
    entity may hold a large part of the rows, bucket by (entity, time) for
    alignment, and attach per-entity columns to the plain table (skew splitting
    works on shuffles only). Rows with null keys are kept, in one bucket. Choose
    ``buckets`` so that a bucket fits a task; default: the shuffle partitions.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [*keys, *[c for c in sort if c not in keys]]
    (df.repartition(n, *keys).sortWithinPartitions(*order).write.mode("errorifexists").format("parquet")
       .bucketBy(n, *keys).sortBy(*order).option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def write_counted(
    df: DataFrame, path: str, *, bad: Column | None = None, nulls: Sequence[str] = (), min_rows: int = 1
) -> dict[str, float]:
    """Write Parquet and return ``rows``, ``bad_rows`` and ``null_share.<column>``,
    counted while the rows are written (no count job, no second read).

    The counts sit right before the write, behind every shuffle, so each written
    task is counted once even when lost tasks run again. The write runs in a
    session of its own with the same settings: a session that has observed a
    query can no longer send fitted models to tasks (its observation manager is
    not serialisable), and the caller's session must stay fit for that. Fewer than ``min_rows``
    rows raise ``ValueError`` after the write. The null share of no rows is 0.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(bad if bad is not None else F.lit(False)).alias("bad_rows"),
              *[F.count_if(F.col(c).isNull()).alias(f"null.{c}") for c in nulls]]
    spark, name = df.sparkSession, f"counted_{uuid.uuid4().hex}"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    df.createGlobalTempView(name)
    try:
        own.table(f"global_temp.{name}").observe(seen, *counts).write.mode("overwrite").parquet(path)
        got = seen.get
    finally:
        spark.catalog.dropGlobalTempView(name)
    rows = int(got["rows"])
    if rows < min_rows:
        raise ValueError(f"{rows} rows written to {path}, at least {min_rows} expected")
    return {"rows": rows, "bad_rows": int(got["bad_rows"]),
            **{f"null_share.{c}": int(got[f"null.{c}"]) / rows if rows else 0.0 for c in nulls}}


def shape(df: DataFrame, *, debug: bool = False) -> tuple[int, int] | None:
    """(rows, columns) as a progress fact - runs a count job, so only when
    ``debug`` is set; otherwise returns None without touching the data."""
    if not debug:
        return None
    return df.count(), len(df.columns)
