"""Catalogue queries: exact stratified split and class-balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.sampling import class_balanced_sample, fold_block, sample_counts, shots_ladder, stratified_split
from wardflow.plans.registry import register
from wardflow.plans.shapes import STATIC_SQL, static_info
from wardflow.sources.tables import read_table

SHOTS = [1, 2, 4, 8, 16, 32, 64, 128]


def _rank_sql(table: str, part: str, key: str, seed: int = 42) -> str:
    return (f"row_number() OVER (PARTITION BY {part} ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}'), {key}) - 1")


@register(
    "n1_split",
    f"""
WITH {STATIC_SQL},
r AS (SELECT user_id, region, {_rank_sql("st", "region", "user_id")} AS rk,
             count(*) OVER (PARTITION BY region) AS n FROM st)
SELECT user_id, region, CASE WHEN rk < round(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def n1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = static_info(spark, sf_dir).select("user_id", "region")
    return stratified_split(st, "user_id", "region", train_frac=0.8, seed=42, out="split")


@register(
    "n1_split_sizes",
    f"""
WITH {STATIC_SQL},
r AS (SELECT user_id, region, {_rank_sql("st", "region", "user_id")} AS rk,
             count(*) OVER (PARTITION BY region) AS n FROM st)
SELECT region, count(*) FILTER (WHERE rk < round(0.8 * n)) AS n_train, count(*) AS n_total FROM r GROUP BY region""",
)
def n1_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = n1_split(spark, sf_dir)
    return s.groupBy("region").agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                   F.count(F.lit(1)).alias("n_total"))


_LAB_SQL = "lab AS (SELECT doc_id, quality FROM labels)"


@register(
    "n2_few_shot",
    f"""
WITH {_LAB_SQL},
r AS (SELECT doc_id, quality, {_rank_sql("lab", "quality", "doc_id")} AS sample_rank FROM lab)
SELECT doc_id, quality, sample_rank FROM r WHERE sample_rank < 16""",
)
def n2_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return class_balanced_sample(lab, "quality", "doc_id", 16, seed=42)


@register(
    "n2_sample_counts",
    """
SELECT quality, count(*) AS available, least(count(*), 64) AS used, count(*) < 64 AS short
FROM labels GROUP BY quality""",
)
def n2_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sample_counts(lab, "quality", 64)


@register(
    "n4_shots_ladder",
    f"""
WITH {_LAB_SQL},
r AS (SELECT doc_id, quality, {_rank_sql("lab", "quality", "doc_id")} AS sample_rank FROM lab)
SELECT r.doc_id, r.quality, r.sample_rank, CAST(s.n AS INTEGER) AS num_shots
FROM r JOIN (SELECT unnest({SHOTS}) AS n) s ON r.sample_rank < s.n""",
)
def n4_shots_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return shots_ladder(lab, "quality", "doc_id", SHOTS, seed=42)


_BLOCK_SHOTS = [1, 2, 4]


@register(
    "n3_prompt_block",
    f"""
WITH lab AS (SELECT l.doc_id, l.quality, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT doc_id, quality, text, {_rank_sql("lab", "quality", "doc_id")} AS sample_rank FROM lab),
s AS (SELECT r.*, CAST(n.n AS INTEGER) AS num_shots FROM r JOIN (SELECT unnest({_BLOCK_SHOTS}) AS n) n ON r.sample_rank < n.n),
b AS (SELECT num_shots, string_agg(text, '' ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS block,
             count(*) AS n_examples FROM s GROUP BY num_shots)
SELECT num_shots, md5(block) AS block_md5, length(block) AS block_chars, n_examples FROM b""",
)
def n3_prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = shots_ladder(lab.join(docs, "doc_id"), "quality", "doc_id", _BLOCK_SHOTS, seed=42)
    blocks = fold_block(sample, ["num_shots"], "doc_id", "text", seed=42)
    return blocks.select("num_shots", F.md5("block").alias("block_md5"), F.length("block").cast("long").alias("block_chars"),
                         "n_examples")
