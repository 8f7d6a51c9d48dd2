"""Files in and out, and small inputs at the edges."""

import json
import math

import pytest
from pyspark.sql import functions as F

from margrid.domain import Constraint, Domain
from margrid.functions import scalars as X
from margrid.operators import ci as C
from margrid.operators import encode as E
from margrid.operators import factors as K
from margrid.operators import fairness as A
from margrid.operators import fit as T
from margrid.operators import noise as G
from margrid.operators import repair as R
from margrid.operators import select as S
from margrid.sources import results as Q
from margrid.sources import tables as I


def test_load_csv_with_domain(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a-x,w,other\n1,0,0.5,z\n0,2,1.5,z\n")
    (tmp_path / "domain.json").write_text(json.dumps({"a-x": 3, "b": 2}))
    domain = Domain.from_json(str(tmp_path / "domain.json"))
    df = I.load_dataset(spark, str(tmp_path / "t.csv"), domain, weight="w")
    assert df.columns == ["a-x", "b", "w"]
    assert sorted(map(tuple, df.collect())) == [(0, 1, 0.5), (2, 0, 1.5)]
    assert I.load_dataset(spark, str(tmp_path / "t.csv"), domain, drop=["b"]).columns == ["a-x"]
    with pytest.raises(ValueError):
        I.load_dataset(spark, str(tmp_path / "t.csv"), Domain.of({"missing": 2}))


def test_read_raw_strips_blanks(spark, tmp_path):
    (tmp_path / "raw.data").write_text("39, State-gov,  <=50K\n50,Private, >50K\n")
    df = I.read_raw(spark, str(tmp_path / "raw.data"), ["age", "class", "income"], {"age": "int"})
    assert [tuple(r) for r in df.orderBy("age").collect()] == [(39, "State-gov", "<=50K"), (50, "Private", ">50K")]


def test_domain_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (1, "y")], "a int, b string")
    domain = I.dump_domain(df, str(tmp_path / "d"))
    assert domain == Domain.of({"a": 2, "b": 2}) == I.read_domain(spark, str(tmp_path / "d"), ["a", "b"])


def test_epsilon_keys(spark):
    rows = spark.createDataFrame([(v,) for v in ("1.0", "1", "0.5", None, " ", "10.00")], "e string")
    got = [r[0] for r in rows.select(Q.epsilon_key("e")).collect()]
    assert got == ["1", "1", "0.5", "", "", "10"]


def test_upsert_keeps_other_cells(spark):
    old = spark.createDataFrame([("m", 0, "1", 0.5, 7.0)], "method_name string, fold_num int, epsilon string, CMI double, KL double")
    new = spark.createDataFrame([("m", 0, "1.0", "CMI", 0.25), ("m", 1, "1", "TVD", 0.1)], "method_name string, fold_num int, epsilon string, metric string, value double")
    out = {(r["fold_num"]): r for r in Q.upsert_metric(old, new, ["CMI", "TVD"]).collect()}
    assert out[0]["CMI"] == 0.25 and out[0]["KL"] == 7.0 and out[0]["TVD"] is None
    assert out[1]["TVD"] == 0.1 and out[1]["CMI"] is None and len(out) == 2


def test_recodes(spark):
    df = spark.createDataFrame([("Sales", "Germany", "Widowed", 3), ("?", "Laos", "Divorced", 20)], "o string, c string, m string, e int")
    row = df.select(
        X.map_classes("o", X.OCCUPATION_CLASSES).alias("o"), X.map_classes("c", X.COUNTRY_TIERS).alias("c"),
        X.map_classes("m", X.MARITAL_CLASSES, X.MARITAL_OTHER).alias("m"), X.clamp("e", X.EDUCATION_LOW, X.EDUCATION_HIGH).alias("e"),
    ).collect()
    assert [tuple(r) for r in row] == [("NOC-2", 4, "single", 5), ("NOC-7", 1, "divorced", 13)]
    assert spark.range(1).select(X.map_values(F.lit("zzz"), X.SEX_CODES)).first()[0] is None


def test_whole_bins(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 8, 9, 10)], "v int")
    got = sorted(r[0] for r in E.equal_width_bin_mean(df, "v", 2, whole=True).collect())
    assert got == [1, 1, 1, 9, 9, 9]
    same = E.equal_width_bin_mean(spark.createDataFrame([(4,), (4,)], "v int"), "v", 3)
    assert [r[0] for r in same.collect()] == [4.0, 4.0]


def test_all_missing_column_becomes_zero(spark):
    df = spark.range(5).withColumn("v", F.lit(None).cast("int"))
    assert {r["v"] for r in E.impute_random_observed(df, "v", ["id"], "s").collect()} == {0}


def test_division_by_zero_cells(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 4.0)], "x int, value double")
    b = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 2.0)], "x int, value double")
    d = Domain.of({"x": 3})
    plain = {r["x"]: r["value"] for r in K.factor_divide(a, b, d).collect()}
    assert plain[0] == math.inf and math.isnan(plain[1]) and plain[2] == 2.0
    guarded = {r["x"]: r["value"] for r in K.factor_divide_guarded(a, b, d).collect()}
    assert guarded == {0: 0.0, 1: 0.0, 2: 2.0}


def test_rules_without_conditioning(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    rule = Constraint.of("a", "b")
    assert R.ci_projection(df, rule).agg(F.sum("value")).first()[0] == pytest.approx(60)
    joint = df.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("value"))
    assert T.blend_ci(joint, ["a"], ["b"], [], 1.0).agg(F.sum("value")).first()[0] == pytest.approx(60)
    assert C.cmi_plain(df, rule).first()["cmi"] == pytest.approx(0, abs=1e-12)


def test_auc_edges(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3), (1, 0.2)], "y int, s double")
    assert A.auc_binary(df, "y", "s").first()["auc"] == pytest.approx(0.875)
    assert A.auc_binary(df.where("y = 1"), "y", "s").first()["auc"] == 0.0


def test_selection_prefers_the_best_with_a_large_budget(spark):
    c = spark.createDataFrame([("a", 1.0, 1.0), ("b", 9.0, 2.0), ("c", 5.0, 1.0)], "k string, q double, s double")
    assert G.exponential_mechanism(c, "k", "q", 1e6, seed="x").first()["k"] == "b"
    assert G.permute_and_flip(c, "k", "q", 1e6, seed="x").first()["k"] == "b"
    assert {r["k"] for r in G.pareto_front(c, "q", "s").collect()} == {"b", "c"}


def test_pair_scores_of_independent_columns(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("int").alias("a"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("b"))
    d = Domain.of({"a": 3, "b": 2})
    ones = S.single_counts(df, d).withColumnRenamed("n", "value")
    assert S.pair_scores(S.pair_counts(df, d), ones).first()["score"] == pytest.approx(0, abs=1e-9)


def test_upsert_takes_the_last_by_order(spark):
    old = spark.createDataFrame([("m", 0, "1", 0.5)], "method_name string, fold_num int, epsilon string, CMI double")
    new = spark.createDataFrame(
        [("m", 0, "1", "CMI", 0.9, 1), ("m", 0, "1", "CMI", 0.2, 2)],
        "method_name string, fold_num int, epsilon string, metric string, value double, seq int",
    )
    assert Q.upsert_metric(old, new, ["CMI"], order="seq").first()["CMI"] == 0.2
