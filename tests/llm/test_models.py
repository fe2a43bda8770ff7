import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow.llm import language, toxicity


def test_languages_are_learned_and_held_out_rows_are_judged(spark, documents):
    model = language.fit(language.training_rows(documents), "text", "lang", "doc_id", per_language=60)
    rows = language.predict(documents.withColumn("lang_pred", F.lit(1)), model).select("*", language.held_out(F.col("doc_id")).alias("out")).collect()
    assert len(rows) == documents.count()
    out = [r for r in rows if r.out and any(c.isalpha() for c in r.text)]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    assert 0 < (model["weights"] != 0).mean() < 1 and model["temperature"] > 0


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ... !"), (4, "Ω"), (None, "abc " * 5000), (5, "abc"), (5, "abc")], "doc_id long, text string")
    train = spark.createDataFrame([(k, f"the of and {k}", "en") for k in range(9)] + [(k, f"der die und {k}", "de") for k in range(9)]
                                  + [(20, None, "fr"), (21, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train, "text", "lang", "doc_id")
    assert model["names"] == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in language.predict(df, model, keep=["doc_id"]).collect()]
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert all(x in ("de", "en") for i, x in got if i not in (1, 2, 3)) and len(got) == 7
    assert language.fit(train.limit(0), "text", "lang", "doc_id") is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
    assert language.predict(df.limit(0), model).collect() == []


def test_gram_counts_match_python():
    texts = ["Hello  World", "", "ÀÉ\n\tx", "ab" * 40]
    data, offsets = language.W.text_buffer(pa.array(texts))
    got = language.gram_counts(*language.code_points(data, offsets))
    for t, row in zip(texts, got):
        n = len(" ".join(t.split())) if t.strip() else len(t)
        assert row.sum() == sum(max(0, n - k) for k in range(3))


def test_toxic_documents_are_found(spark):
    rnd = random.Random(2)
    text = lambda bad: " ".join(rnd.choice(["alpha", "beta", "gamma", "you", "delta", "fine"]) if not bad or rnd.random() < 0.9
                                else rnd.choice(["idiot", "scum", "zorkel", "1d1ot"]) for _ in range(80))
    rows = [(k, text(k % 4 == 0), "x") for k in range(600)]
    docs = spark.createDataFrame(rows + [(None, "a"), (700, None), (701, ""), (5, rows[5][1], "x")][:0] + [(700, None, "x"), (701, "", "x"), (None, "a", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for k, r in got.items() if k is not None and k < 600 and r.held_out]
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert got[700].score < 0.7 and got[701].score < 0.7
    none = toxicity.score_texts(docs, labels.limit(0)).collect()
    assert len(none) == 603 and {r.score for r in none} == {0.0}
    assert toxicity.score_texts(docs.limit(0), labels).collect() == []


def test_features_find_hidden_insults_and_second_person():
    empty = np.zeros(0, toxicity.W.U64), np.zeros(0)
    x = toxicity.features(pa.array(["you are an 1d1ot!", "an apple", None, "YOU IDIOT"]), *empty)
    at = {f: k for k, f in enumerate(toxicity.FEATURES)}
    assert x[0][at["hidden_insults"]] > 0 and x[1][at["hidden_insults"]] == 0
    assert x[3][at["fixed_density"]] == 0.5 and x[3][at["you_near"]] > 0 and x[3][at["shouted"]] == 1
    assert not x[2].any()


def test_sample_of_a_label_is_its_first_rows_by_hash(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "rare").when(F.col("id") % 7 == 0, "few").otherwise("hot").alias("label"))
    df = df.union(df.filter("id < 20")).union(df.filter("id = 4").select("id", F.lit("one").alias("label"))).repartition(5)
    got = sorted(map(tuple, language.first_of_each(df, 700).collect()))
    want, by = [], {}
    for r in df.select("id", "label", F.xxhash64("id").alias("h")).collect():
        by.setdefault(r.label, []).append((r.h, r.id))
    for label, rows in by.items():
        want += [(i, label) for _, i in sorted(rows)[:700]]
    assert got == sorted(want)
    assert language.first_of_each(df.limit(0), 5).collect() == []
