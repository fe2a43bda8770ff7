"""Catalogue queries that write files to the cluster's shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators.timeline import align_on_spine, attach, key_spine, minimum_stay
from wardflow.plans.registry import register
from wardflow.plans.shapes import SERIES, double_round
from wardflow.session import ensure_checkpoint_dir
from wardflow.sources.tables import (
    parse_id_text,
    read_csv,
    read_csv_checked,
    read_table,
    read_with_provenance,
    write_bucketed,
    write_counted,
    write_csv,
    write_id_text,
    write_parquet,
    write_text,
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "s3_parquet_round_trip",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
)
def s3_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "orders")
    write_parquet(read_table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice"), path, partition_by=["o_orderstatus"])
    back = spark.read.parquet(path).groupBy("o_orderstatus")
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("s5_csv_round_trip", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s5_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "customer")
    write_csv(read_table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])
    return double_round(read_csv(spark, path, schema))


@register(
    "s6_files_of_mixed_column_order",
    """
SELECT c_custkey AS id, round(c_acctbal, 3) AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, round(s_acctbal, 3), 'supplier' FROM supplier""",
)
def s6_files_of_mixed_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families with opposite column order and an empty one in one read by header name."""
    path = shared_folder(spark, "families")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = read_table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    write_csv(c, f"{path}/a")
    write_csv(s, f"{path}/b")
    write_text(spark.createDataFrame([], "value string"), "value", f"{path}/c")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("balance", T.DoubleType()), T.StructField("kind", T.StringType())])
    read = read_with_provenance(spark, [[f"{path}/a", f"{path}/b", f"{path}/c"]], schema).drop("file_name")
    return read.select("id", F.round("balance", 3).alias("balance"), "kind")


@register("s8_id_text_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS text FROM orders")
def s8_id_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "lines")
    write_id_text(read_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", path)
    return parse_id_text(spark.read.text(path))


@register(
    "f4_minimum_stay",
    """
WITH stay AS (SELECT user_id, date_diff('second', min(ts), max(ts)) / CAST(86400 AS DOUBLE) AS los FROM events GROUP BY user_id)
SELECT user_id, round(los, 6) AS los FROM stay WHERE los > 1.0 / 3""",
)
def f4_minimum_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that stayed longer than eight hours (stay: from the first to the last event)."""
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    stay = read_table(spark, sf_dir, "events").groupBy("user_id").agg((seconds / F.lit(86400.0)).alias("los"))
    return double_round(minimum_stay(stay, "los"))


@register(
    "s4_malformed_lines",
    """
SELECT kind, count(*) AS n, round(coalesce(sum(balance), 0), 2) AS balance FROM (
  SELECT CASE c_custkey % 10 WHEN 1 THEN 'number of fields' WHEN 2 THEN 'number of fields' WHEN 3 THEN 'unclosed quote'
              WHEN 4 THEN 'value' ELSE 'good' END AS kind,
         CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN NULL ELSE c_acctbal END AS balance FROM customer)
GROUP BY kind""",
)
def s4_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written lines of which some are short, long, unclosed or no number, read into good rows and a quarantine."""
    path = shared_folder(spark, "lines")
    key, name = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    balance, damage = F.call_function("format_number", F.col("c_acctbal"), F.lit("0.00")), F.col("c_custkey") % 10
    line = (F.when(damage == 1, F.concat_ws(",", key, name)).when(damage == 2, F.concat_ws(",", key, name, balance, F.lit("more")))
            .when(damage == 3, F.concat_ws(",", key, F.concat(F.lit('"'), name), balance))
            .when(damage == 4, F.concat_ws(",", key, name, F.lit("n/a"))).otherwise(F.concat_ws(",", key, name, balance)))
    rows = read_table(spark, sf_dir, "customer").select(line.alias("line"))
    write_text(spark.createDataFrame([("id,segment,balance",)], "line string").unionByName(rows).coalesce(1), "line", path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("balance", T.DoubleType())])
    good, bad = read_csv_checked(spark, path, schema)
    both = good.select(F.lit("good").alias("kind"), "balance").unionByName(bad.select(F.col("reason").alias("kind"), F.lit(None).cast("double").alias("balance")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("balance"), F.lit(0.0)), 2).alias("balance"))


BUCKETS = 16


def stored(df: DataFrame, keys: list[str], *, sort: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a bucketed table of its own below the shared folder."""
    name = f"stored_{uuid.uuid4().hex}"
    return write_bucketed(df, name, shared_folder(df.sparkSession, name), keys, sort=sort, buckets=BUCKETS)


@register(
    "j2_bucketed_align",
    "SELECT user_id, ts, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{s}') AS {s}" for s in SERIES)
    + " FROM events WHERE event_type IN (" + ", ".join(f"'{s}'" for s in SERIES) + ") AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
)
def j2_bucketed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series stored by (entity, time) and aligned on the spine of their keys; reading them shuffles nothing."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    keys = ["user_id", "ts"]
    series = [stored(events.filter(F.col("event_type") == s).groupBy(*keys).agg(F.max("value").alias(s)), keys) for s in SERIES]
    return align_on_spine(stored(key_spine(series, keys), keys), series, keys)


@register(
    "j1_bucketed_attach",
    """
SELECT c.c_mktsegment AS segment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""",
)
def j1_bucketed_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and static columns stored by entity, attached without a shuffle, then summed by segment."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), "o_orderdate", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    both = attach(stored(o, ["entity"], sort=("o_orderdate",)), stored(c, ["entity"]), "entity")
    return both.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(
    "s12_counted_write",
    """
SELECT 'rows' AS fact, CAST(count(*) AS DOUBLE) AS value FROM events
UNION ALL SELECT 'bad_rows', count(*) FILTER (WHERE value < 0) FROM events
UNION ALL SELECT 'null_share.value', round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) FROM events
UNION ALL SELECT 'stored_rows', count(*) FROM events""",
)
def s12_counted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about the events counted by the write itself, beside the rows read back."""
    path = shared_folder(spark, "events")
    facts = write_counted(read_table(spark, sf_dir, "events"), path, bad=F.col("value") < 0, nulls=["value"])
    rows = spark.createDataFrame([(k, round(float(v), 6)) for k, v in facts.items()], "fact string, value double")
    back = spark.read.parquet(path).agg(F.lit("stored_rows").alias("fact"), F.count(F.lit(1)).cast("double").alias("value"))
    return rows.unionByName(back)
