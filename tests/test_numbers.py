"""Budgets, tails and draws against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from margrid.functions import hashing as H
from margrid.functions.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided
from margrid.operators.ci import _hypergeometric
from margrid.operators import noise as G
from margrid.operators.noise import zcdp_delta, zcdp_epsilon, zcdp_rho, clique_weights, laplace_scale


@pytest.mark.parametrize("eps", [0.1, 0.5, 1.0, 5.0, 10.0])
def test_budget_conversions_invert(eps):
    rho = zcdp_rho(eps, 1e-9)
    assert 0 < rho < eps
    assert zcdp_delta(rho, eps) == pytest.approx(1e-9, rel=1e-6)
    assert zcdp_epsilon(rho, 1e-9) == pytest.approx(eps, rel=1e-6)


def test_budget_edges():
    assert zcdp_rho(1.0, 1.0) == 0.0
    assert zcdp_delta(0, 1.0) == 0.0
    assert zcdp_epsilon(0, 1e-9) == 0.0
    # the optimised bound is never worse than the plain tail bound
    assert zcdp_delta(0.1, 1.0) <= math.exp(-((1.0 - 0.1) ** 2) / 0.4)


def test_scales():
    assert laplace_scale(1.0, 0.5) == 2.0
    assert laplace_scale(1.0, 0.5, bounded=True) == 4.0
    w = clique_weights(["a", "b"], [3.0, 4.0])
    assert w == {"a": 0.6, "b": 0.8}


def test_tails(spark):
    row = spark.range(1).select(
        chi2_sf(F.lit(3.841458820694124), F.lit(1.0)).alias("a"),
        chi2_sf(F.lit(18.307038053275146), F.lit(10.0)).alias("b"),
        chi2_sf(F.lit(2.0), F.lit(2.0)).alias("c"),
        f_sf(F.lit(4.964602743730711), F.lit(1.0), F.lit(10.0)).alias("d"),
        t_two_sided(F.lit(2.2281388519649385), F.lit(10.0)).alias("e"),
        normal_two_sided(F.lit(1.959963984540054)).alias("f"),
    ).first()
    assert row["a"] == pytest.approx(0.05, abs=1e-10)
    assert row["b"] == pytest.approx(0.05, abs=1e-10)
    assert row["c"] == pytest.approx(math.exp(-1.0), abs=1e-12)
    assert row["d"] == pytest.approx(0.05, abs=1e-9)
    assert row["e"] == pytest.approx(0.05, abs=1e-9)
    assert row["f"] == pytest.approx(0.05, abs=1e-9)


def test_draws_have_their_laws(spark):
    n = 200_000
    row = spark.range(n).select(
        H.uniform("t", "id").alias("u"), H.gaussian("t", "id").alias("g"), H.laplace("t", "id").alias("l"), H.gumbel("t", "id").alias("m")
    ).agg(
        F.avg("u").alias("u"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.avg("g").alias("g"), F.stddev("g").alias("sg"),
        F.avg("l").alias("l"), F.stddev("l").alias("sl"), F.avg("m").alias("m"),
    ).first()
    assert 0 < row["lo"] and row["hi"] < 1
    assert row["u"] == pytest.approx(0.5, abs=0.01)
    assert row["g"] == pytest.approx(0.0, abs=0.02) and row["sg"] == pytest.approx(1.0, abs=0.02)
    assert row["l"] == pytest.approx(0.0, abs=0.02) and row["sl"] == pytest.approx(math.sqrt(2), abs=0.03)
    assert row["m"] == pytest.approx(0.5772, abs=0.02)


def test_fresh_seeds_differ():
    assert H.fresh_seed(None) != H.fresh_seed(None)
    assert H.fresh_seed(7) == "7"


def test_large_hypergeometric_matches_moments():
    rng = np.random.default_rng(1)
    good, bad, draws = 3 * 10**9, 2 * 10**9, 10**6
    x = np.array([_hypergeometric(rng, good, bad, draws) for _ in range(300)])
    mean = draws * good / (good + bad)
    sd = math.sqrt(mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1))
    assert abs(x.mean() - mean) < 4 * sd / math.sqrt(300)
    assert 0.8 < x.std() / sd < 1.2


def test_budget_ledger_takes_releases_of_nothing(spark):
    """A release that spends nothing has infinite noise; it neither fails nor ends the owner's budget."""
    spends = spark.createDataFrame([(1, 7, 1, 0.0), (2, 7, 2, 0.5), (3, 7, 3, None)], "id long, who long, t long, rho double")
    out = G.budget_ledger(spends, "who", F.col("t"), F.col("t"), "rho", 0.5, ["id"])
    got = {r["id"]: (r["rho_used"], r["accepted"], r["sigma"], r["epsilon"]) for r in out.where("id < 3").collect()}
    assert got == {1: (0.0, True, float("inf"), 0.0), 2: (0.5, True, 1.0, 2.0)}
    assert out.where("id = 3").first()["sigma"] is None
