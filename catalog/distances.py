"""Distances between tables and errors of answers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import HALVES, ITEM_DOMAIN, ORD, ORDER_DOMAIN, gauss_sql, halves, orders, query, rounded, table
from catalog.counts import _pair_sql
from margrid.operators import distance as D
from margrid.operators import marginals as M
from margrid.operators import noise as G

COLS = ["flag", "status", "qty"]
SUB = ITEM_DOMAIN.project(COLS)

_PQ = f"""{HALVES}, pc AS (SELECT flag, status, qty, disc, line, count(*) / CAST((SELECT count(*) FROM ta) AS DOUBLE) AS p FROM ta GROUP BY flag, status, qty, disc, line),
  qc AS (SELECT flag, status, qty, disc, line, count(*) / CAST((SELECT count(*) FROM tb) AS DOUBLE) AS q FROM tb GROUP BY flag, status, qty, disc, line),
  pq AS (SELECT flag, status, qty, disc, line, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM pc FULL JOIN qc USING (flag, status, qty, disc, line))"""
_PQ3 = f"""{HALVES}, pc AS (SELECT flag, status, qty, count(*) / CAST((SELECT count(*) FROM ta) AS DOUBLE) AS p FROM ta GROUP BY flag, status, qty),
  qc AS (SELECT flag, status, qty, count(*) / CAST((SELECT count(*) FROM tb) AS DOUBLE) AS q FROM tb GROUP BY flag, status, qty),
  pq AS (SELECT flag, status, qty, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM pc FULL JOIN qc USING (flag, status, qty))"""


def _pq(spark, sf):
    a, b = halves(spark, sf)
    return D.pair_of(a, b, list(ITEM_DOMAIN.attrs))


def _pq3(spark, sf):
    a, b = halves(spark, sf)
    return D.pair_of(a, b, COLS)


@query("tvd", f"WITH {_PQ} SELECT round(0.5 * sum(abs(p - q)), 9) AS tvd FROM pq")
def tvd(spark, sf):
    return rounded(D.tvd(_pq(spark, sf)), "tvd", digits=9)


@query("kl", f"WITH {_PQ} SELECT round(sum((p + 1e-12) * ln((p + 1e-12) / (q + 1e-12))), 8) AS kl FROM pq")
def kl(spark, sf):
    return rounded(D.kl(_pq(spark, sf)), "kl", digits=8)


@query("kl_common_support", f"WITH {_PQ} SELECT round(sum(p * ln(p / q)), 9) AS kl FROM pq WHERE p > 0 AND q > 0")
def kl_common_support(spark, sf):
    return rounded(D.kl_common_support(_pq(spark, sf)), "kl", digits=9)


@query("kl_generalized", f"WITH {_PQ} SELECT round(sum(p * ln(p / q)) - sum(p) + sum(q), 9) AS kl FROM pq WHERE p > 0 AND q > 0")
def kl_generalized(spark, sf):
    return rounded(D.kl_generalized(_pq(spark, sf)), "kl", digits=9)


@query(
    "mmd_rbf",
    f"""WITH {_PQ3} SELECT round(sqrt(greatest(sum((a.p - a.q) * (b.p - b.q)
      * exp(-((a.flag - b.flag) * (a.flag - b.flag) + (a.status - b.status) * (a.status - b.status) + (a.qty - b.qty) * (a.qty - b.qty)))), 0.0)), 8) AS mmd
    FROM pq a, pq b""",
)
def mmd_rbf(spark, sf):
    return rounded(D.mmd_rbf(_pq3(spark, sf), SUB), "mmd", digits=8)


@query(
    "cost_matrix",
    f"""WITH {HALVES}, s AS (SELECT DISTINCT flag, status, qty, CAST(flag AS BIGINT) * 10 + status * 5 + qty AS cell FROM itm)
    SELECT a.cell AS src, b.cell AS dst, round(sqrt(CAST((a.flag - b.flag) * (a.flag - b.flag) + (a.status - b.status) * (a.status - b.status)
      + (a.qty - b.qty) * (a.qty - b.qty) AS DOUBLE)), 9) AS cost FROM s a, s b""",
)
def cost_matrix(spark, sf):
    a, b = halves(spark, sf)
    support = a.select(*COLS).union(b.select(*COLS)).distinct()
    return rounded(D.cost_matrix(support, SUB), "cost", digits=9)


@query("sinkhorn")
def sinkhorn(spark, sf):
    return rounded(D.sinkhorn(_pq3(spark, sf), SUB, max_rounds=20), "sinkhorn")


def _w1_sql(col: str) -> str:
    return f"""SELECT '{col}' AS attr, (SELECT round(sum(abs(f) * w), 8) FROM (
      SELECT sum(p - q) OVER (ORDER BY v) AS f, coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS w FROM (
        SELECT v, sum(p) AS p, sum(q) AS q FROM (
          SELECT CAST({col} AS DOUBLE) AS v, 1.0 / CAST((SELECT count(*) FROM ta) AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q FROM ta
          UNION ALL SELECT CAST({col} AS DOUBLE), 0, 1.0 / CAST((SELECT count(*) FROM tb) AS DOUBLE) FROM tb) GROUP BY v))) AS w1"""


@query("wasserstein_1d", f"WITH {HALVES} " + " UNION ALL ".join(_w1_sql(c) for c in ("flag", "qty", "disc", "weight")))
def wasserstein_1d(spark, sf):
    a, b = halves(spark, sf)
    return rounded(D.wasserstein_1d(a, b, ["flag", "qty", "disc", "weight"]), "w1", digits=8)


@query(
    "wasserstein_prices",
    """WITH ta AS (SELECT o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'), tb AS (SELECT o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F') """
    + _w1_sql("price").replace(", 8)", ", 4)"),
)
def wasserstein_prices(spark, sf):
    """A column with mostly different values: both cumulative sums run in range-cut pieces."""
    o = orders(spark, sf).select("status", F.col("total").alias("price"))
    return rounded(D.wasserstein_1d(o.where("status = 0"), o.where("status <> 0"), ["price"]), "w1", digits=4)


@query(
    "wasserstein_heights",
    """WITH ta AS (SELECT value AS v FROM events WHERE event_type IN ('view', 'click')), tb AS (SELECT value AS v FROM events WHERE event_type NOT IN ('view', 'click')),
    e AS (SELECT quantile_cont(value, [i / CAST(20 AS DOUBLE) FOR i IN range(21)]) AS e FROM events),
    s AS (SELECT unnest(range(1, 21)) AS slot, e FROM e),
    x AS (SELECT slot, e[slot] AS lo, e[slot + 1] AS hi FROM s),
    h AS (SELECT slot, (SELECT count(*) FROM ta WHERE v >= lo AND (v < hi OR slot = 20)) / CAST((SELECT count(*) FROM ta) AS DOUBLE) / (hi - lo) AS p,
      (SELECT count(*) FROM tb WHERE v >= lo AND (v < hi OR slot = 20)) / CAST((SELECT count(*) FROM tb) AS DOUBLE) / (hi - lo) AS q FROM x),
    rp AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM h), rq AS (SELECT q, row_number() OVER (ORDER BY q) AS k FROM h)
    SELECT round(avg(abs(p - q)), 8) AS w1_heights FROM rp JOIN rq USING (k)""",
)
def wasserstein_heights(spark, sf):
    e = table(spark, sf, "events")
    few = F.col("event_type").isin("view", "click")
    return rounded(D.wasserstein_heights(e.where(few), e.where(~few), "value", 20), "w1_heights", digits=8)


def _error_sql() -> str:
    parts = []
    for a, b in combinations(ITEM_DOMAIN.attrs, 2):
        parts.append(
            f"SELECT '{a},{b}' AS clique, (SELECT round(0.5 * sum(abs(coalesce(x, 0) - coalesce(y, 0))), 9) FROM "
            f"(SELECT {a}, {b}, count(*) / CAST((SELECT count(*) FROM ta) AS DOUBLE) AS x FROM ta GROUP BY {a}, {b}) FULL JOIN "
            f"(SELECT {a}, {b}, count(*) / CAST((SELECT count(*) FROM tb) AS DOUBLE) AS y FROM tb GROUP BY {a}, {b}) USING ({a}, {b})) AS error"
        )
    return " UNION ALL ".join(parts)


@query("workload_error", f"WITH {HALVES} {_error_sql()}")
def workload_error(spark, sf):
    a, b = halves(spark, sf)
    return rounded(D.workload_error(a, b, ITEM_DOMAIN, M.workload(ITEM_DOMAIN, 2)), "error", digits=9)


@query("mean_error", f"WITH {HALVES}, e AS ({_error_sql()}) SELECT round(avg(error), 8) AS mean_error FROM e")
def mean_error(spark, sf):
    a, b = halves(spark, sf)
    return rounded(D.mean_error(D.workload_error(a, b, ITEM_DOMAIN, M.workload(ITEM_DOMAIN, 2))), "mean_error", digits=8)


_NOISY = f"{ORD}, m AS ({_pair_sql(ORDER_DOMAIN, 'ord', 2)}), y AS (SELECT clique, cell, value, value + 5.0 * {gauss_sql('ml', 'clique', 'cell')} AS noisy, 5.0 AS sd FROM m)"
PAIRS = list(combinations(ORDER_DOMAIN.attrs, 2))


def _noisy(spark, sf):
    m = M.all_marginals(orders(spark, sf), ORDER_DOMAIN, 2)
    return m, G.gaussian_measure(m, 5.0, {M.clique_name(c): 1.0 for c in PAIRS}, "ml")


def _consistency_sql() -> str:
    def shared(clique, common):
        strides = dict(ORDER_DOMAIN.strides(clique))
        return " * 100 + ".join(f"(cell // {strides[a]}) % {ORDER_DOMAIN[a]}" for a in common)

    parts = []
    for i, r in enumerate(PAIRS):
        for s in PAIRS[:i]:
            common = [a for a in ORDER_DOMAIN.attrs if a in r and a in s]
            if common:
                parts.append(
                    f"SELECT '{','.join(s)}|{','.join(r)}' AS pair, (SELECT round(sum(abs(a.v - b.v)) / (0.5 * sum(a.v + b.v)), 8) FROM "
                    f"(SELECT {shared(r, common)} AS k, sum(noisy) AS v FROM y WHERE clique = '{','.join(r)}' GROUP BY 1) a JOIN "
                    f"(SELECT {shared(s, common)} AS k, sum(noisy) AS v FROM y WHERE clique = '{','.join(s)}' GROUP BY 1) b USING (k)) AS disagreement"
                )
    return " UNION ALL ".join(parts)


@query("marginal_consistency", f"WITH {_NOISY} {_consistency_sql()}")
def marginal_consistency(spark, sf):
    _, y = _noisy(spark, sf)
    return rounded(D.marginal_consistency(y.select("clique", "cell", F.col("noisy").alias("value")), ORDER_DOMAIN, PAIRS), "disagreement", digits=8)


@query(
    "measurement_loss",
    f"""WITH {_NOISY} SELECT round(sum((value - noisy) * (value - noisy) / (2 * sd)), 4) AS l2, round(sum(abs(value - noisy) / sd), 4) AS l1,
      round(sum(0.5 * pow((value - noisy) / sd, 2)), 4) AS l2_variance,
      round(sqrt(sum((value - noisy) * (value - noisy) / (2 * sd)) / 6 / 1000.0), 6) AS scaled FROM y""",
)
def measurement_loss(spark, sf):
    m, y = _noisy(spark, sf)
    one = lambda **k: D.measurement_loss(m, y, **k).select("loss").scalar()
    out = D.measurement_loss(m, y).select(
        F.col("loss").alias("l2"), one(norm="l1").alias("l1"), one(scale="variance").alias("l2_variance"),
        one(normalize=True, total=1000.0).alias("scaled"),
    )
    return rounded(rounded(out, "l2", "l1", "l2_variance", digits=4), "scaled")


@query("variation_to_truth", f"WITH {_NOISY} SELECT clique, round(0.5 * sum(abs(noisy - value)) / sum(value), 8) AS variation FROM y GROUP BY clique")
def variation_to_truth(spark, sf):
    m, y = _noisy(spark, sf)
    return rounded(D.variation_to_truth(y.select("clique", "cell", F.col("noisy").alias("value")), m, ["clique", "cell"]), "variation", digits=8)
