import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewarden.operators.ranking import broadcast_if_small, number_in_units, number_rows, running_total
from gatewarden.session import cut_lineage, temporary_tables


def test_numbers_equal_row_number_with_a_hot_group_and_copies(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        (F.col("id") * 7919 % 500).alias("o"),
        F.when(F.col("id") % 5 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"),
    )
    check(df)
    check(df.distinct())
    # Half of the hot group are copies of one row.
    copies = spark.range(3000).selectExpr("'hot' as g", "7L as o", "'c' as v")
    check(df.unionByName(copies))


def check(df):
    """Numbers follow the order in each group; rows that agree in it may take any order."""
    got = number_rows(df, ["g"], ["o"], "n").collect()
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()
    assert sorted((r.g, r.n, r.o) for r in got) == sorted((r.g, r.n, r.o) for r in want)
    assert sorted((r.g, r.o, r.v) for r in got) == sorted((r.g, r.o, r.v) for r in want)


def test_copies_without_a_group(spark):
    df = spark.range(100).select(F.lit(1).alias("a")).unionByName(spark.range(3).select(F.lit(0).alias("a")))
    got = sorted((r.n, r.a) for r in number_rows(df, [], ["a"], "n").collect())
    assert got == [(i, int(i > 3)) for i in range(1, 104)]


def test_finding_the_ranges_does_not_compute_the_rows_again(spark):
    plan = number_rows(spark.range(50).selectExpr("id", "id % 3 as g"), ["g"], ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "Range (" not in plan


def test_global_descending(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("k"))
    got = {r.id: r.n for r in number_rows(df, [], ["k", "id"], "n", ["k"]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [got[i] for i in want] == list(range(1, 1001))


def test_broadcast_only_below_the_bound(spark):
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(spark.range(5), 5))
    assert "broadcast" not in plan(broadcast_if_small(spark.range(6), 5))


def in_units(df, group, unit, **more):
    got = number_in_units(df, group, unit, ["o"], "n", **more).collect()
    order = [*unit, "o"] if unit != group else ["o"]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).collect()
    return sorted(map(tuple, got), key=str), sorted(map(tuple, want), key=str)


def test_numbers_from_counts_per_unit(spark):
    """A third of the rows are one unit; the order inside a unit names a row."""
    df = spark.range(3000).select(
        F.concat(F.lit("t"), F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90).alias("u"),
        (F.col("id") % 2).cast("int").alias("v"),
        (F.col("id") * 7919 % 3001).alias("o"),
    )
    for most in (10, 100, 100_000):
        for group, unit in ((["g"], ["u", "v"]), (["g"], ["g"]), (["u"], ["u"])):
            got, want = in_units(df, group, unit, max_rows=most)
            assert got == want
    blank = df.withColumn("u", F.when(F.col("u") != 7, F.col("u")))
    got, want = in_units(blank, ["g"], ["u", "v"])
    assert got == want
    assert number_in_units(df.limit(0), ["g"], ["u"], ["o"], "n").count() == 0


def test_rows_move_once_to_their_unit(spark):
    df = spark.range(500).selectExpr("id % 3 as g", "id % 50 as u", "id as o", "repeat('x', 9) as wide")
    numbered = number_in_units(df, ["g"], ["u"], ["o"], "n")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    # The wide column is in one exchange: the scan below it is the only one that reads it.
    assert plan.count("wide") and plan.count("REPARTITION_BY_COL") == 1
    assert sum("ReadSchema" in line and "wide" in line for line in plan.split("\n")) == 1
    by_group = number_in_units(df, ["g"], ["g"], ["o"], "n").groupBy("g", F.expr("n div 10")).count()
    assert by_group._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_running_total_over_many_ranges(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 40)) as g", "id as o", "id % 11 as b")
    before = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("b").over(before), F.lit(0)).cast("long"))
    got = running_total(df, ["g"], ["o"], "b", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = running_total(df, [], ["o"], "b", "t").orderBy("o").collect()
    assert [r.t for r in whole] == [sum(x.b for x in whole[:i]) for i in range(len(whole))]


def test_temporary_tables_are_removed(spark):
    with temporary_tables(spark):
        inside = cut_lineage(spark.range(3)).inputFiles()
        assert inside
    outside = cut_lineage(spark.range(3)).inputFiles()
    exists = [os.path.exists(f.removeprefix("file://")) for f in (inside[0], outside[0])]
    assert exists == [False, True]
