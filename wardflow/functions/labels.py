"""Display labels and file-name parsing as column expressions (ops X6-X8, P16, Q19).

Each rule table is an ordered list of (substring, label); the first substring
found in the lower-cased input wins. The tables are fixed values that must
equal the reference's so that labels agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model-name rules, in the reference's order (else: the lower-cased input).
MODEL_RULES = [
    ("logistic", "Logistic"),
    ("xgboost", "XGBoost"),
    ("catboost", "CatBoost"),
    ("lightgbm", "LightGBM"),
    ("tabpfn", "TabPFN"),
    ("kaplanmeier", "Kaplan-Meier"),
    ("cox", "Cox PH"),
    ("qwen", "Qwen"),
    ("tabula", "TabuLa"),
    ("medgemma", "MedGemma"),
]

# Condition rules, in the reference's order (else: "Other").
CONDITION_RULES = [
    ("hourly_stats", "Hourly + Stats"),
    ("forward_fill", "Forward Fill"),
    ("hourly", "Hourly"),
    ("stats", "Statistics"),
    ("minmax", "Min-Max"),
    ("basic", "Basic"),
]

# Canonical condition names, prompt-model ids and result-file patterns.
CONDITIONS = ["basic", "hourly", "forward_fill", "hourly_stats", "minmax", "stats"]
PROMPT_MODEL_IDS = ["qwen_3_8b", "tabula_8b", "medgemma_3_4b"]


def _rules(x: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    low = F.lower(x.cast("string"))
    out = default
    for sub, label in reversed(rules):
        out = F.when(low.contains(sub), F.lit(label)).otherwise(out)
    return out


def _rules_sql(x: str, rules: list[tuple[str, str]], default: str) -> str:
    low = f"lower(CAST({x} AS VARCHAR))"
    whens = " ".join(f"WHEN contains({low}, '{sub}') THEN '{label}'" for sub, label in rules)
    return f"(CASE {whens} ELSE {default} END)"


def model_label(name: Column | str) -> Column:
    """Short model label."""
    c = F.col(name) if isinstance(name, str) else name
    return _rules(c, MODEL_RULES, F.lower(c.cast("string")))


def model_label_sql(x: str) -> str:
    return _rules_sql(x, MODEL_RULES, f"lower(CAST({x} AS VARCHAR))")


def condition_label(args: Column | str) -> Column:
    """Condition label from a model-args string."""
    c = F.col(args) if isinstance(args, str) else args
    return _rules(c, CONDITION_RULES, F.lit("Other"))


def condition_label_sql(x: str) -> str:
    return _rules_sql(x, CONDITION_RULES, "'Other'")


def source_group(entity_id: Column | str, prefix: str = "mimic", yes: str = "MIMIC", no: str = "eICU") -> Column:
    """Group derived from an id prefix (case-insensitive)."""
    c = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return F.when(F.lower(c.cast("string")).startswith(prefix), F.lit(yes)).otherwise(F.lit(no))


def label_01(x: Column | str) -> Column:
    """Q19: one rule for mixed label encodings: true/1/1.0 -> 1, false/0/0.0 -> 0, else null."""
    c = F.lower(F.trim((F.col(x) if isinstance(x, str) else x).cast("string")))
    return (
        F.when(c.isin("true", "1", "1.0"), F.lit(1))
        .when(c.isin("false", "0", "0.0"), F.lit(0))
        .otherwise(F.lit(None).cast("int"))
    )


def label_01_sql(x: str) -> str:
    c = f"lower(trim(CAST({x} AS VARCHAR)))"
    return f"(CASE WHEN {c} IN ('true', '1', '1.0') THEN 1 WHEN {c} IN ('false', '0', '0.0') THEN 0 END)"


def tabular_condition(model_args: Column | str) -> Column:
    """Condition of a few-shot tabular result from its own run arguments:
    without the ``tabpfn_`` prefix, a bare ``tabpfn`` as ``basic``, ``-`` as ``_``."""
    c = F.col(model_args) if isinstance(model_args, str) else model_args
    for old, new in (("tabpfn_", ""), ("tabpfn", "basic"), ("-", "_")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def file_labels(file_name: Column | str, model_args: Column | None = None, num_shots: Column | None = None) -> dict[str, Column]:
    """(family, model_id, condition, shots) from a result file name.

    Patterns: ``llm_<model>_<condition>_<n>-shot_results.csv`` (model from the
    known ids, condition = text up to the last ``_``), ``tabpfn...`` (condition
    and shots from the rows' own ``model_args`` and ``num_shots``), and
    ``baseline..._<condition>_results.csv`` (``baseline_<condition>``, default
    ``baseline_basic``). Anything else gets family null and is dropped.
    """
    f = F.col(file_name) if isinstance(file_name, str) else file_name
    stem = F.regexp_replace(f, r"_results\.csv$", "")
    llm_re = r"^llm_(" + "|".join(PROMPT_MODEL_IDS) + r")_(.+)_([0-9]+)-shot$"
    is_llm = stem.rlike(llm_re)
    cond_re = r"_(" + "|".join(sorted(CONDITIONS, key=len, reverse=True)) + r")$"
    base_cond = F.regexp_extract(stem, cond_re, 1)
    family = (
        F.when(stem.startswith("llm_") & is_llm, F.lit("llm"))
        .when(stem.startswith("tabpfn"), F.lit("tabpfn"))
        .when(stem.startswith("baseline_"), F.lit("baseline"))
    )
    condition = (
        F.when(family == "llm", F.regexp_extract(stem, llm_re, 2))
        .when(family == "baseline", F.concat(F.lit("baseline_"), F.when(base_cond != "", base_cond).otherwise(F.lit("basic"))))
    )
    shots = F.when(family == "llm", F.regexp_extract(stem, llm_re, 3).cast("int"))
    if model_args is not None:
        condition = F.when(family == "tabpfn", tabular_condition(model_args)).otherwise(condition)
    if num_shots is not None:
        shots = F.when(family == "tabpfn", num_shots.cast("int")).otherwise(shots)
    return {
        "family": family,
        "model_id": F.when(family == "llm", F.regexp_extract(stem, llm_re, 1)),
        "condition": condition,
        "shots": shots,
    }
