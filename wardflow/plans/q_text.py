"""Catalogue queries: text cleaning, records, feature sentences, prompts, answer parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import text as X
from wardflow.operators.sampling import fold_block, shots_ladder, stratified_split
from wardflow.plans.registry import register
from wardflow.plans.q_timeline import FLAGSHIP_SQL, flagship
from wardflow.sources.tables import parse_id_text, parse_records, read_table


# --- X1 --------------------------------------------------------------------------------------

@register(
    "x1_clean_text",
    f"""
SELECT doc_id, md5({X.clean_text_sql("text")}) AS clean_md5, length({X.clean_text_sql("text")}) AS clean_chars
FROM documents""",
)
def x1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("__c"))
    return d.select("doc_id", F.md5("__c").alias("clean_md5"), F.length("__c").cast("long").alias("clean_chars"))


# --- X2 / X4: natural-language record per entity -----------------------------------------------

def _record_fragments(include_outcome: F.Column) -> list[F.Column]:
    vitals = F.concat_ws(
        ", ",
        X.fragment("Glasgow coma score", X.fixed(F.col("click_max"), 0)),
        X.fragment("Heart rate", X.fixed(F.col("view_mean"), 0)),
        X.fragment("Mean arterial pressure", X.fixed(F.col("signup_mean"), 0)),
        X.fragment("Respiratory rate", X.fixed(F.col("signup_std"), 0)),
        X.fragment("Temperature", X.fixed(F.col("view_std"), 1), " C"),
    )
    return [
        F.concat(F.lit("Patient ID: "), F.col("user_id").cast("string")),
        X.fragment("Age", F.col("acctbal").cast("string"), " years"),
        X.fragment("Admission Type (Urgency)", F.concat(F.col("segment"), F.lit(" ("), F.col("region"), F.lit(")"))),
        X.fragment("Pre-ICU Length of Stay", X.fixed(F.col("click_mean"), 2), " days"),
        F.when(vitals != "", F.concat(F.lit("Worst Vitals in the first 24 hours: "), vitals)),
        X.fragment("Urine Output", X.fixed(F.col("purchase_total"), 0), " ml"),
        X.fragment("Mechanical Ventilation", X.yes_no(F.col("mech_flag"))),
        F.when(include_outcome, X.fragment("Mortality in ICU", X.yes_no(F.col("outcome")))),
    ]


def _fixed_sql(x: str, d: int) -> str:
    return f"printf('%.{d}f', {x})"


def _frag_sql(label: str, value: str, suffix: str = "") -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN '{label}: ' || {value} || '{suffix}' END"


_VITALS_SQL = ("concat_ws(', ', " + ", ".join([
    _frag_sql("Glasgow coma score", _fixed_sql("click_max", 0)),
    _frag_sql("Heart rate", _fixed_sql("view_mean", 0)),
    _frag_sql("Mean arterial pressure", _fixed_sql("signup_mean", 0)),
    _frag_sql("Respiratory rate", _fixed_sql("signup_std", 0)),
    _frag_sql("Temperature", _fixed_sql("view_std", 1), " C"),
]) + ")")

_RECORD_BODY_SQL = "concat_ws('. ', " + ", ".join([
    "'Patient ID: ' || CAST(user_id AS VARCHAR)",
    _frag_sql("Age", "CAST(acctbal AS VARCHAR)", " years"),
    "'Admission Type (Urgency): ' || segment || ' (' || region || ')'",
    _frag_sql("Pre-ICU Length of Stay", _fixed_sql("click_mean", 2), " days"),
    f"CASE WHEN {_VITALS_SQL} <> '' THEN 'Worst Vitals in the first 24 hours: ' || {_VITALS_SQL} END",
    _frag_sql("Urine Output", _fixed_sql("purchase_total", 0), " ml"),
    "'Mechanical Ventilation: ' || CASE WHEN mech_flag THEN 'Yes' ELSE 'No' END",
    "CASE WHEN split = 'train' THEN 'Mortality in ICU: ' || CASE WHEN outcome THEN 'Yes' ELSE 'No' END END",
]) + ")"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity records (train rows carry the outcome, test rows do not)."""
    f = flagship(spark, sf_dir)
    return f.select("user_id", "split", "outcome",
                    X.record_text(_record_fragments(F.col("split") == "train")).alias("record"))


_RECORDS_SQL = f"""
WITH fs AS ({FLAGSHIP_SQL}),
rec AS (SELECT user_id, split, outcome,
               {X.clean_text_sql(f"CASE WHEN {_RECORD_BODY_SQL} <> '' THEN {_RECORD_BODY_SQL} || '.' END")} AS record
        FROM fs)"""


@register("x2_record_text", _RECORDS_SQL + "\nSELECT user_id, split, record FROM rec")
def x2_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("user_id", "split", "record")


# --- X3: feature sentences ------------------------------------------------------------------------

_X3_EXCLUDE = ["user_id", "split", "outcome"]


def _x3_sql() -> str:
    # Column list and types of the flagship output (fixed schema).
    dbl = [f"{v}_{s}" for v in ("click", "view", "signup") for s in ("mean", "std", "min", "max")]
    cols = [(c, "double") for c in dbl] + [("purchase_total", "double"), ("mech_flag", "bool"), ("n_rows", "int"),
                                           ("region", "str"), ("acctbal", "double"), ("segment", "str")]
    cols = sorted(c for c in cols if c[0] not in _X3_EXCLUDE)

    def val(c: str, t: str) -> str:
        if t == "bool":
            return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
        return f"CAST({c} AS VARCHAR)"

    parts = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN 'The {c} is ' || {val(c, t)} || '.' END" for c, t in cols)
    return f"WITH fs AS ({FLAGSHIP_SQL})\nSELECT user_id, concat_ws(' ', {parts}) AS features FROM fs"


@register("x3_feature_text", _x3_sql())
def x3_feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagship(spark, sf_dir)
    cols = [(fld.name, fld.dataType) for fld in f.schema.fields]
    return f.select("user_id", X.feature_sentences(cols, exclude=_X3_EXCLUDE, sort_cols=True).alias("features"))


# --- S8-S10: text lines round trip (id by regex; id<TAB>text) -------------------------------------

@register("s9_parse_records", _RECORDS_SQL + """
SELECT regexp_extract(trim(record), 'Patient ID:\\s*(\\S+?)\\s*\\.', 1) AS id, trim(record) AS text FROM rec
WHERE trim(record) <> '' AND regexp_extract(trim(record), 'Patient ID:\\s*(\\S+?)\\s*\\.', 1) <> ''""")
def s9_parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records(spark, sf_dir).select(F.col("record").alias("value"))
    return parse_records(lines)


@register("s10_parse_id_text", """
SELECT CAST(conv_id AS VARCHAR) AS id, text FROM (
  SELECT conv_id, trim(CAST(conv_id AS VARCHAR) || chr(9) || text) AS line,
         substr(trim(CAST(conv_id AS VARCHAR) || chr(9) || text), length(CAST(conv_id AS VARCHAR)) + 2) AS text
  FROM conversations)
WHERE line <> '' AND contains(line, chr(9))""")
def s10_parse_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    lines = conv.select(F.concat_ws("\t", F.col("conv_id").cast("string"), F.col("text")).alias("value"))
    return parse_id_text(lines)


# --- X9 / X10: answer parsing over real text ---------------------------------------------------

@register(
    "x9_parse_probability",
    f"""
SELECT conv_id, turn, round({X.parse_probability_sql("text")}, 6) AS probability FROM conversations""",
)
def x9_parse_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(X.parse_probability("text"), 6).alias("probability"))


@register(
    "x10_parse_quartile",
    f"""
SELECT conv_id, turn, {X.parse_quartile_sql("text")} AS probability FROM conversations""",
)
def x10_parse_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.parse_quartile("text").alias("probability"))


# --- X13 / J11 / J10: prompts for every test row with a few-shot block -------------------------

_PROMPT_SHOTS = [2]


def prompts(spark: SparkSession, sf_dir: str, shots: list[int]) -> DataFrame:
    """Labelled documents split 80/20 by language; train rows give the
    class-balanced example block (N2-N3), attached to each test row by an equi-join
    on the shot count (one block row per shot value; AQE measures it)."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    data = stratified_split(lab.join(docs, "doc_id", "inner"), "doc_id", "lang", out="split")
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    sample = shots_ladder(train, "quality", "doc_id", shots, seed=42)
    blocks = fold_block(sample, ["num_shots"], "doc_id", "text", seed=42)
    ladder = F.explode(F.array(*[F.lit(s) for s in shots])).alias("num_shots")
    rows = test.select("doc_id", "quality", "text", ladder).join(blocks, "num_shots", "left")
    return rows.select("doc_id", "num_shots", X.prompt(F.col("text"), F.col("block"), F.col("num_shots")).alias("prompt"))


@register(
    "x13_prompts",
    f"""
WITH lab AS (SELECT l.doc_id, l.quality, d.lang, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1
                      < round(0.8 * count(*) OVER (PARTITION BY lang)) THEN 'train' ELSE 'test' END AS split FROM lab),
tr AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS rk
       FROM sp WHERE split = 'train'),
b AS (SELECT CAST(n.n AS INTEGER) AS num_shots,
             string_agg(text, '' ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS block
      FROM tr JOIN (SELECT unnest({_PROMPT_SHOTS}) AS n) n ON tr.rk < n.n GROUP BY n.n),
p AS (SELECT t.doc_id, b.num_shots,
             {X.sql_literal(X.INSTRUCTION)} ||
             CASE WHEN b.num_shots > 0 AND b.block IS NOT NULL AND b.block <> ''
                  THEN {X.sql_literal(X.WITH_EXAMPLES)} || b.block ELSE {X.sql_literal(X.NO_EXAMPLES)} END ||
             {X.sql_literal(X.RECORD_HEAD)} || t.text || {X.sql_literal(X.QUESTION)} AS prompt
      FROM sp t CROSS JOIN b WHERE t.split = 'test')
SELECT doc_id, num_shots, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p""",
)
def x13_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts(spark, sf_dir, _PROMPT_SHOTS)
    return p.select("doc_id", "num_shots", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("prompt_chars"))


def quartile_prompts(spark: SparkSession, sf_dir: str, shots: list[int]) -> DataFrame:
    """X13, quartile template: each example is prefix + text + suffix + end token +
    its outcome as the extreme quartile label + completion token; the test row's
    prompt is the example block followed by its own unanswered query."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    data = stratified_split(lab.join(docs, "doc_id", "inner"), "doc_id", "lang", out="split")
    train = data.filter(F.col("split") == "train").withColumn(
        "example", X.quartile_example(F.col("text"), F.col("quality")))
    test = data.filter(F.col("split") == "test")
    sample = shots_ladder(train, "quality", "doc_id", shots, seed=42)
    blocks = fold_block(sample, ["num_shots"], "doc_id", "example", seed=42)
    ladder = F.explode(F.array(*[F.lit(s) for s in shots])).alias("num_shots")
    rows = test.select("doc_id", "text", ladder).join(blocks, "num_shots", "left")
    return rows.select("doc_id", "num_shots",
                       X.quartile_prompt(F.col("text"), F.col("block"), F.col("num_shots")).alias("prompt"))


@register(
    "x13_quartile_prompts",
    f"""
WITH lab AS (SELECT l.doc_id, l.quality, d.lang, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1
                      < round(0.8 * count(*) OVER (PARTITION BY lang)) THEN 'train' ELSE 'test' END AS split FROM lab),
tr AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS rk,
              {X.sql_literal(X.QUARTILE_PREFIX)} || text || {X.sql_literal(X.QUARTILE_SUFFIX)} || {X.sql_literal(X.END_INPUT)}
              || CASE WHEN quality = 1 THEN {X.sql_literal(X.QUARTILES[3][0])} ELSE {X.sql_literal(X.QUARTILES[0][0])} END
              || {X.sql_literal(X.END_COMPLETION)} || chr(10) AS example
       FROM sp WHERE split = 'train'),
b AS (SELECT CAST(n.n AS INTEGER) AS num_shots,
             string_agg(example, '' ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS block
      FROM tr JOIN (SELECT unnest({_PROMPT_SHOTS}) AS n) n ON tr.rk < n.n GROUP BY n.n),
p AS (SELECT t.doc_id, b.num_shots,
             CASE WHEN b.num_shots > 0 AND b.block IS NOT NULL AND b.block <> '' THEN b.block ELSE '' END ||
             {X.sql_literal(X.QUARTILE_PREFIX)} || t.text || {X.sql_literal(X.QUARTILE_SUFFIX)} ||
             {X.sql_literal(" " + X.END_INPUT)} AS prompt
      FROM sp t, b WHERE t.split = 'test')
SELECT doc_id, num_shots, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM p""",
)
def x13_quartile_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quartile_prompts(spark, sf_dir, _PROMPT_SHOTS)
    return p.select("doc_id", "num_shots", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_chars"))
