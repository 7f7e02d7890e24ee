from proratio.operators import sets


def test_both_sides_in_one_pass(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n"), (3, None)], "g int, k string")
    right = spark.createDataFrame([(2, "b"), (2, "b"), (4, "z"), (None, "n")], "g int, k string")
    got = {(r["g"], r["k"], r["only"]) for r in sets.differences(left, right, ["g", "k"], "l", "r").collect()}
    assert got == {(1, "a", "l"), (3, None, "l"), (4, "z", "r")}
    assert {r["sides"] for r in sets.membership(left, right, ["g", "k"]).collect()} == {1, 2, 3}
    plan = sets.differences(left, right, ["g", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sets.equal(left, left.unionByName(left), ["g", "k"]) and not sets.equal(left, right, ["g", "k"])


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert sets.required_columns(df, ["a", "c"]) == (["c"], ["b"])
