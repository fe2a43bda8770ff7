import re


from wardflow.functions.labels import condition_label, file_labels, label_01, model_label
from wardflow.functions.text import clean_text, normalize_name, parse_probability, parse_quartile


def py_clean(note):
    # the specification of the cleaning chain, written with Python's re
    ws = "[ \t\n\x0b\f\r]"
    note = re.sub(r"[ \t]+", " ", note)
    note = re.sub(ws + r"*\n" + ws + "*", "\n", note)
    note = re.sub(r"\n{3,}", "\n\n", note)
    note = note.strip(" \t\n\x0b\f\r")
    for p, r in ((r"\.", "."), (",", ","), (":", ":"), (";", ";")):
        note = re.sub(ws + "+" + p, r, note)
    return re.sub(r"\.{2,}", ".", note)


def test_clean_text_matches_specification(spark):
    notes = ["  a\t\tb  .  c ,d :e ;f...  ", "x\n\n\n\ny", "line1 \n  line2", "", "end....", "\t lead", "a \x0b. b"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)] + [(99, None)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, n in enumerate(notes):
        assert got[i] == py_clean(n), repr(n)
    assert got[99] is None


def test_parse_probability_edge_cases(spark):
    cases = {"0.73": 0.73, ".5": 0.5, "-0.5": 0.0, "50%": 1.0, "1e-3": 1.0, "yes": 1.0, "note": 0.0,
             "maybe": None, "": None, "  0.2 then 0.9": 0.2, "YES!": 1.0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string")
    got = {r.a: r.p for r in df.select("a", parse_probability("a").alias("p")).collect()}
    for k, v in cases.items():
        assert got[k] == v, k
    assert got[None] is None


def test_parse_quartile(spark):
    cases = {"0.25-0.5": 0.375, "0.5-0.75 or 0.0-0.25": 0.125, "0.75-1.0": 0.875, "none": None}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.q for r in df.select("a", parse_quartile("a").alias("q")).collect()}
    assert got == cases


def test_labels(spark):
    df = spark.createDataFrame([("XGBoost_clf", "baseline_hourly_stats"), ("Qwen/Qwen3-8B", "tabpfn-forward_fill"),
                                ("Something", "zzz"), ("coxph", "stats")], "m string, a string")
    got = [(r.m, r.c) for r in df.select(model_label("m").alias("m"), condition_label("a").alias("c")).collect()]
    assert got == [("XGBoost", "Hourly + Stats"), ("Qwen", "Forward Fill"), ("something", "Other"),
                   ("Cox PH", "Statistics")]


def test_label_01_and_file_labels(spark):
    df = spark.createDataFrame([("True",), ("1.0",), ("0",), ("false",), ("x",)], "v string")
    assert [r.y for r in df.select(label_01("v").alias("y")).collect()] == [1, 1, 0, 0, None]
    names = ["llm_qwen_3_8b_forward_fill_128-shot_results.csv", "baseline_xgboost_hourly_stats_results.csv",
             "baseline_logistic_results.csv", "tabpfn_basic_4-shot_results.csv", "weird.csv"]
    f = spark.createDataFrame([(n,) for n in names], "f string")
    lab = file_labels("f")
    got = [tuple(r) for r in f.select(*[v.alias(k) for k, v in lab.items()]).collect()]
    assert got[0] == ("llm", "qwen_3_8b", "forward_fill", 128)
    assert got[1] == ("baseline", None, "baseline_hourly_stats", None)
    assert got[2] == ("baseline", None, "baseline_basic", None)
    assert got[3][0] == "tabpfn" and got[4][0] is None


def test_normalize_name():
    assert normalize_name("Pre-ICU LOS (days)") == "pre_icu_los_days"
    assert normalize_name("Temp (C)") == "temp_c"


def test_cleaning_takes_unicode_blanks_like_python(spark):
    import re

    from pyspark.sql import functions as F

    from wardflow.functions.text import clean_text

    def python(t):
        t = re.sub(r"[ \t]+", " ", t)
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"\s*\n\s*", "\n", t)).strip()
        for c in ".,:;":
            t = re.sub(r"\s+" + re.escape(c), c, t)
        return re.sub(r"\.{2,}", ".", t)

    texts = ["\u00a0a \u2003.b\u3000\n\u2028 c\x1f,", "x\x85;y\u202f:", "\u200bkept\u200b .", "a \t b...\r\n\n\n c"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_text(F.col("t")).alias("c")).collect()]
    assert got == [python(t) for t in texts]


def test_missing_flag_is_left_out(spark):
    from pyspark.sql import functions as F

    from wardflow.functions.text import fragment, record_text, yes_no

    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    got = [r.t for r in df.select(record_text([F.lit("Age: 3"), fragment("Sedated", yes_no("f"))]).alias("t")).collect()]
    assert got == ["Age: 3. Sedated: Yes.", "Age: 3. Sedated: No.", "Age: 3."]
