"""Piecewise ranking, running totals and draws equal their plain forms when one group is hot."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions.hashing import uniform
from margrid.operators.noise import interval_assign, weighted_sample
from margrid.operators.ranking import dense_codes, hash_order_number, key_order_number, running_total
from margrid.plans.sampling import deal_child


@pytest.fixture(scope="module")
def hot(spark):
    """5000 rows of which four fifths share one key."""
    return spark.range(5000).select("id", F.when(F.col("id") % 5 == 0, F.col("id") % 40).otherwise(F.lit(3)).alias("k"))


def _same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("pieces", [2, 7, 64])
def test_hash_order_number(hot, pieces):
    u = uniform("s", "id")
    got = hash_order_number(hot, ["k"], u, ["id"], "rn", pieces)
    want = hot.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(u, "id")).cast("bigint"))
    _same(got, want)


def test_hash_order_number_keeps_null_groups(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("k"))
    got = hash_order_number(df, ["k"], uniform("s", "id"), ["id"])
    assert got.count() == 100
    assert got.groupBy("k").agg(F.max("rn").alias("m")).where(F.col("m") == 50).count() == 2


def test_key_order_number(hot):
    u = uniform("s", "id")
    got = key_order_number(hot, "k", u, ["id"])
    want = hot.withColumn("rn", F.row_number().over(Window.orderBy("k", u, "id")).cast("bigint"))
    _same(got, want)


@pytest.mark.parametrize("n", [50, 5000])
def test_running_total(spark, n):
    """Short columns take one window, long ones are range-cut; both agree with the window."""
    df = spark.range(n).select((F.col("id") * 7919 % 104729).alias("v"), (F.col("id") % 13).alias("w"))
    w = Window.orderBy("v")
    got = running_total(df, "v", "w", "before", follow="next")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0))).withColumn("next", F.lead("v").over(w))
    _same(got, want)
    top = running_total(df, "v", "w", "prior", how="max")
    _same(top, df.withColumn("prior", F.max("w").over(upto)))


def test_dense_codes_of_text(spark):
    df = spark.range(3000).select(F.concat(F.lit("Name#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("s"))
    got = dense_codes(df, "s")
    assert got.where(F.substring("s", 6, 6).cast("int") != F.col("code")).count() == 0


def test_interval_assign_is_total_and_exact(spark):
    """One cell holds a third of the unit interval; every row meets exactly one cell."""
    cells = spark.createDataFrame([(0, 0.0, 1 / 3), (1, 1 / 3, 0.34), (2, 0.34, 0.34), (3, 0.34, 1.0)], "c int, lo double, hi double")
    rows = spark.range(4000).withColumn("u", uniform("iv", "id"))
    for buckets in (1, 16, 1024):
        got = interval_assign(rows, "u", cells, "lo", "hi", buckets)
        assert got.count() == 4000
        assert got.where((F.col("u") < F.col("lo")) | (F.col("u") >= F.col("hi"))).count() == 0


def test_weighted_sample_follows_weights(spark):
    cells = spark.range(10).select(F.col("id").alias("c"), F.when(F.col("id") == 4, 5.0).otherwise(1.0).alias("w"))
    got = weighted_sample(cells, "c", "w", spark.range(14_000).withColumnRenamed("id", "r"), "r", "s")
    share = {r["c"]: r["count"] / 14_000 for r in got.groupBy("c").count().collect()}
    assert sum(share.values()) == pytest.approx(1.0)
    assert share[4] == pytest.approx(5 / 14, abs=0.02)
    assert all(share[i] == pytest.approx(1 / 14, abs=0.02) for i in range(10) if i != 4)


def test_rounded_draws_follow_hash_order_without_ranking_all_rows(spark):
    """Codes as by the rank of every row in its group, from a plan that neither sorts nor shuffles rows; ties are split."""
    domain = Domain.of({"a": 2, "b": 3})
    table = spark.createDataFrame([(0, 0, 5.0), (0, 1, 3.0), (0, 2, 2.0), (1, 0, 0.0), (1, 1, 1.0), (1, 2, 9.0)], "a int, b int, value double")
    rows = spark.range(2000).select("id", F.when(F.col("id") < 300, 1).otherwise(0).alias("a"))
    got = deal_child(rows, table, ["a"], "b", "s", domain)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(uniform("s/deal/b", "id"), "id"))
    want = F.when(F.col("a") == 0, F.when(rank <= 850, 0).when(rank <= 1360, 1).otherwise(2)).otherwise(F.when(rank <= 30, 1).otherwise(2))
    _same(got, rows.withColumn("b", want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    twice = deal_child(rows.withColumn("id", F.col("id") % 2), table, ["a"], "b", "s", domain)
    counts = {(r["a"], r["b"]): r["count"] for r in twice.groupBy("a", "b").count().collect()}
    assert counts == {(0, 0): 850, (0, 1): 510, (0, 2): 340, (1, 1): 30, (1, 2): 270}
