from wardflow.operators.sampling import class_balanced_sample, fold_block, shots_ladder, stratified_split


def test_split_exact_fraction_and_partition_independent(spark):
    rows = [(f"id{i}", "A" if i < 7 else "B") for i in range(12)]  # 7 + 5 -> 6 and 4 train
    df = spark.createDataFrame(rows, "stay string, src string")
    s1 = {r.stay: r.split for r in stratified_split(df, "stay", "src").collect()}
    s2 = {r.stay: r.split for r in stratified_split(df.repartition(5), "stay", "src").collect()}
    assert s1 == s2
    a = sum(1 for k, v in s1.items() if v == "train" and int(k[2:]) < 7)
    b = sum(1 for k, v in s1.items() if v == "train" and int(k[2:]) >= 7)
    assert (a, b) == (6, 4)


def test_few_shot_caps_small_class_and_ladder_nests(spark):
    rows = [(i, 1 if i < 3 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, y int")
    s = class_balanced_sample(df, "y", "k", 5).collect()
    assert sum(r.y for r in s) == 3 and sum(1 for r in s if r.y == 0) == 5
    lad = shots_ladder(df, "y", "k", [1, 2, 4]).collect()
    by = {}
    for r in lad:
        by.setdefault(r.num_shots, set()).add(r.k)
    assert by[1] <= by[2] <= by[4]


def test_fold_block_is_ordered_and_bounded(spark):
    df = spark.createDataFrame([(i, "g", f"<{i}>") for i in range(6)], "k long, g string, x string")
    r = fold_block(df, ["g"], "k", "x").first()
    assert r.n_examples == 6 and sorted(r.block.replace(">", "> ").split()) == sorted(f"<{i}>" for i in range(6))


def test_rows_without_a_stratum_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 2}") for i in range(100)], "id long, g string")
    got = stratified_split(df, "id", "g").groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in got} == {
        (None, "train"): 16, (None, "test"): 4, ("s0", "train"): 32, ("s0", "test"): 8, ("s1", "train"): 32, ("s1", "test"): 8}
