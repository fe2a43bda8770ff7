from pyspark.sql import functions as F

from wardflow.operators.report import ci_cell, flag_best, keep_max, result_table, sort_by_label, table_one


def test_table_one_counts_missing_and_overall(spark):
    rows = [("A", "x", 1.0), ("A", None, 3.0), ("A", "y", None), ("B", "x", 5.0)]
    df = spark.createDataFrame(rows, "grp string, cat string, val double")
    got = {(r.group, r.variable, r.level): r for r in table_one(df, "grp", ["cat"], ["val"]).collect()}
    assert got[("A", "n", None)].n == 3 and got[("Overall", "n", None)].n == 4
    a_x = got[("A", "cat", "x")]
    assert a_x.n == 1 and a_x.pct == 50.0 and a_x.n_missing == 1  # % of non-missing
    assert got[("Overall", "cat", "x")].n == 2
    v = got[("A", "val", None)]
    assert v.n == 2 and v.mean == 2.0 and v.n_missing == 1 and abs(v.sd - 2 ** 0.5) < 1e-12


def test_table_one_reads_its_input_once(spark, tmp_path):
    import statistics

    rows = [(f"g{k % 3}", "ab"[k % 2], None if k % 5 == 0 else k % 4 == 1, *[None if (k + j) % 7 == 0 else float(k * j) for j in range(6)]) for k in range(60)]
    columns = [f"v{j}" for j in range(6)]
    spark.createDataFrame(rows, "g string, c string, d boolean, " + ", ".join(f"{c} double" for c in columns)).write.parquet(str(tmp_path / "t"))
    out = table_one(spark.read.parquet(str(tmp_path / "t")), "g", ["c", "d"], columns)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Join") == 0
    got = {(r.group, r.variable, r.level): r for r in out.collect()}
    for g in ("g0", "g1", "g2", "Overall"):
        mine = [r for r in rows if g in (r[0], "Overall")]
        assert got[g, "n", None].n == len(mine)
        known = [r[2] for r in mine if r[2] is not None]
        assert got[g, "d", "true"].n == sum(known) and got[g, "d", "true"].n_missing == len(mine) - len(known)
        assert abs(got[g, "d", "false"].pct - 100 * known.count(False) / len(known)) < 1e-9
        for j, c in enumerate(columns):
            values = [r[3 + j] for r in mine if r[3 + j] is not None]
            cell = got[g, c, None]
            assert (cell.n, cell.n_missing) == (len(values), len(mine) - len(values))
            assert abs(cell.mean - statistics.mean(values)) < 1e-9 and abs(cell.sd - statistics.stdev(values)) < 1e-9
    assert table_one(spark.read.parquet(str(tmp_path / "t")).limit(0), "g", ["c"], ["v1"]).count() == 0


def test_rows_sort_by_a_derived_label_then_shots(spark):
    rows = [("Zeta b", 2), ("alpha a", 10), (None, 1), ("alpha a", 2), ("Zeta a", 1)]
    df = spark.createDataFrame(rows, "name string, shots int")
    last_word = F.substring_index("name", " ", -1)
    got = sort_by_label(df, last_word, then=["shots", F.col("name").desc()], out="label")
    assert [(r.label, r.shots, r.name) for r in got.collect()] == [
        (None, 1, None), ("a", 1, "Zeta a"), ("a", 2, "alpha a"), ("a", 10, "alpha a"), ("b", 2, "Zeta b")]
    assert sort_by_label(df, last_word).columns == ["name", "shots"]


def test_result_table_grid_best_and_missing(spark):
    m = spark.createDataFrame(
        [("c1", 1, "M1", 0.7, 0.6, 0.8), ("c1", 1, "M2", 0.7, 0.5, 0.9), ("c1", 2, "M1", 0.6, None, 0.7)],
        "cond string, shots int, model string, auc double, lo double, hi double")
    grid = spark.createDataFrame([("c1", s) for s in (1, 2, 4)], "cond string, shots int")
    t = {(r.cond, r.shots): r for r in result_table(m, grid, ["cond", "shots"], "model", ["M1", "M2"],
                                                      lo="lo", hi="hi").collect()}
    assert t[("c1", 1)].M1 == "\\textbf{0.700 [0.600--0.800]}" and t[("c1", 1)].M2.startswith("\\textbf{")
    assert t[("c1", 2)].M1 == "--" and t[("c1", 2)].M2 == "--" and t[("c1", 4)].M1 == "--"


def test_keep_max_and_flag_best(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 4, 0.6), ("b", 2, 0.9), ("b", 2, 0.8)], "m string, s int, v double")
    kept = sorted((r.m, r.s, r.v) for r in keep_max(df, ["m"], "s").collect())
    assert kept == [("a", 4, 0.6), ("b", 2, 0.8), ("b", 2, 0.9)]
    best = {(r.m, r.v): r.is_best for r in flag_best(df, ["m"], "v").collect()}
    assert best[("b", 0.9)] and not best[("b", 0.8)] and best[("a", 0.6)]
    cell = ci_cell(F.lit(0.5), F.lit(0.25), F.lit(None).cast("double"))
    assert spark.range(1).select(cell.alias("c")).first().c == "--"
