"""The queries over the driver tables against SQL or brute force, and the pipeline stage by stage."""

import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_lines, test_near
from wardflow.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    norm = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_returns_every_row(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    table = "pages" if name[:4] in ("op2_", "op5_") else "embeddings" if name.startswith("op12_") else "documents"
    key = {"pages": "page_id", "embeddings": "vec_id", "documents": "doc_id"}[table]
    want = pd.read_parquet(f"{SF}/{table}.parquet")
    assert sorted(got[key]) == sorted(list(want[key]) * (8 if table == "embeddings" else 1))
    if name.startswith("op4_"):
        rows = test_near.brute(list(zip(want.doc_id, want.text)), 2)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == rows
    if name.startswith("op10_"):
        bench = pd.read_parquet(f"{SF}/benchmark.parquet")
        rows = {i: (w, h, len(x)) for i, w, h, x in test_decontaminate.brute(list(zip(want.doc_id, want.text)), list(zip(bench.item_id, bench.text)), 10)}
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got.itertuples()} == rows


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(P.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in P.STAGES:
        before = docs.toPandas()
        docs = P.checkpoint(stage(spark, docs, SF))
        after = docs.toPandas()
        if name != "mixing":
            assert docs.columns == P.COLUMNS
        if name == "language_id":
            assert len(after) > 0.95 * len(before)
        if name == "line_dedup":
            want = {r[0]: r[3] for r in test_lines.brute(list(zip(before.doc_id, before.text)))}
            import hashlib
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(after.doc_id, after.text)} == want
            assert (after.n_chars == after.text.str.len()).all()
        if name == "near_dedup":
            rows = test_near.brute(list(zip(before.doc_id, before.text)), 5)
            assert sorted(after.doc_id) == sorted(i for i, r in rows.items() if r[2])
        if name == "decontamination":
            bench = pd.read_parquet(f"{SF}/benchmark.parquet")
            rows = test_decontaminate.brute(list(zip(before.doc_id, before.text)), list(zip(bench.item_id, bench.text)), 10)
            assert sorted(after.doc_id) == sorted(r[0] for r in rows if not r[2])
        if name == "mixing":
            assert sorted(after.doc_id) == sorted(before.doc_id) and after.mix_position.is_unique


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_nulls_repeats_and_empty_tables(spark, name):
    stage = dict(P.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id int, score string"
    rows = [(None, None, None, None, None, "x", 1, "s"), (1, "", "en", "a", 0, None, 2, None), (2, "the of and " * 20, "en", "a", 220, None, None, None),
            (2, "the of and " * 20, "en", "a", 220, None, None, None), (4, "der die das " * 4000, "de", None, 9, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, SF)
    assert set(P.COLUMNS) <= set(out.columns)
    assert {4} <= {r.doc_id for r in out.collect()}
    assert stage(spark, df.limit(0), SF).collect() == []


def test_every_stage_reads_its_predecessor_from_parquet(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs)
        return docs.limit(50)

    monkeypatch.setattr(P, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert P.run(spark, SF).count() == 50
    for docs in seen[1:]:
        assert docs.inputFiles() and all(f.endswith(".parquet") and SF not in f for f in docs.inputFiles())
        assert docs.schema == spark.read.parquet(f"{SF}/documents.parquet").schema
