"""The catalogue against its oracle SQL on the smallest driver tables, as the driver does at sf0.01."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    try:
        import pandas as pd
        if not isinstance(v, (str, bytes, list, tuple)) and pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return round(float(v), 4)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in rec) for rec in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "split" in df.columns


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    for a, b in zip(gr, wr):
        for x, y in zip(a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= 1e-3 * max(1.0, abs(x)), (name, a, b)
            else:
                assert x == y, (name, a, b)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    got = entry.queries()[name](spark, SF)
    assert got.columns and got.count() >= 0
    got.limit(5).collect()


def test_every_query_has_an_operator_prefix():
    for name in entry.queries():
        if name.startswith("op") or name == "pipeline":
            continue
        assert name.split("_")[0][0] in "qpfjanxmwlvso", name
