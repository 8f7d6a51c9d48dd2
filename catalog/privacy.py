"""Noise, selection, budgets, sampling and error injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ITM, ITEM_DOMAIN, ORD, ORDER_DOMAIN, gauss_sql, gumbel_sql, items, laplace_sql, n_rows, orders, query, rounded, table, u_sql,
)
from catalog.counts import _pair_sql
from margrid.functions.hashing import gaussian, uniform
from margrid.operators import ci as C
from margrid.operators import encode as E
from margrid.operators import marginals as M
from margrid.operators import noise as G

_ONE = f"{ORD}, m AS ({_pair_sql(ORDER_DOMAIN, 'ord', 1)})"


@query(
    "gaussian_measure",
    f"""WITH {ITM}, m AS ({_pair_sql(ITEM_DOMAIN, 'itm', 2)}),
    w AS (SELECT clique, CASE WHEN clique LIKE '%disc%' THEN 2.0 ELSE 1.0 END / sqrt(CAST(22 AS DOUBLE)) AS w FROM (SELECT DISTINCT clique FROM m))
    SELECT clique, cell, round(value + 10.0 / w * {gauss_sql('gm', 'clique', 'cell')}, 4) AS noisy, round(10.0 / w, 6) AS stddev FROM m JOIN w USING (clique)""",
)
def gaussian_measure(spark, sf):
    """All pairs measured; pairs with the discount axis carry double weight."""
    m = M.all_marginals(items(spark, sf), ITEM_DOMAIN, 2)
    names = [M.clique_name(c) for c in M.workload(ITEM_DOMAIN, 2)]
    w = G.clique_weights(names, [2.0 if "disc" in c else 1.0 for c in names])
    return rounded(rounded(G.gaussian_measure(m, 10.0, w, "gm"), "noisy", digits=4), "stddev")


@query(
    "laplace_measure",
    f"WITH {_ONE} SELECT clique, cell, round(value + 4.0 * {laplace_sql('lm', 'clique', 'cell')}, 4) AS noisy, "
    "round(sqrt(CAST(2 AS DOUBLE)) * 4.0, 6) AS stddev FROM m",
)
def laplace_measure(spark, sf):
    m = M.all_marginals(orders(spark, sf), ORDER_DOMAIN, 1)
    out = G.laplace_measure(m, 0.5, "lm", bounded=True)
    return rounded(rounded(out, "noisy", digits=4), "stddev")


@query(
    "choose_noise",
    """SELECT o_custkey, count(*) AS k, CASE WHEN sqrt(CAST(2 AS DOUBLE)) * count(*) < sqrt(CAST(count(*) AS DOUBLE)) * 4.0 THEN 'laplace' ELSE 'gaussian' END AS noise
    FROM orders GROUP BY o_custkey""",
)
def choose_noise(spark, sf):
    """Noise per customer release: L1 scale grows with the order count, L2 scale with its root."""
    k = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    t = k.withColumns({"b": F.col("k").cast("double"), "sigma": F.sqrt("k") * 4.0})
    return G.choose_noise(t).select("o_custkey", "k", "noise")


_CAND = """cand AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS q,
    CAST(1 + count(DISTINCT CAST(floor(c_acctbal / 1000) AS BIGINT)) AS DOUBLE) AS s FROM customer GROUP BY ALL)"""


def _candidates(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")).agg(
        F.count(F.lit(1)).cast("double").alias("q"),
        (F.countDistinct(F.floor(F.col("c_acctbal") / 1000)) + 1).cast("double").alias("s"),
    )


@query(
    "exponential_mechanism",
    f"WITH {_CAND} SELECT nation, arg_max(seg, q * (0.5 * 0.8 / 2.0) + ln(s) + {gumbel_sql('em', 'nation', 'seg')}) AS seg FROM cand GROUP BY nation",
)
def exponential_mechanism(spark, sf):
    """One market segment per nation, drawn by customer count with a base measure."""
    return G.exponential_mechanism(_candidates(spark, sf), "seg", "q", 0.8, 2.0, "s", "em", ["nation"])


@query(
    "permute_and_flip",
    f"""WITH {_CAND}, t AS (SELECT *, max(q) OVER (PARTITION BY nation) AS top FROM cand)
    SELECT nation, arg_min(seg, {u_sql('pf/order', 'nation', 'seg')}) AS seg FROM t
    WHERE {u_sql('pf/flip', 'nation', 'seg')} <= exp(0.5 * 0.8 / 2.0 * (q - top)) GROUP BY nation""",
)
def permute_and_flip(spark, sf):
    return G.permute_and_flip(_candidates(spark, sf), "seg", "q", 0.8, 2.0, "pf", ["nation"])


@query(
    "generalized_exponential_mechanism",
    f"""WITH {_CAND}, k AS (SELECT concat_ws('/', nation, seg) AS k, q, s FROM cand),
    f AS (SELECT DISTINCT q, s FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.q >= a.q AND b.s <= a.s AND (b.q > a.q OR b.s < a.s))),
    t AS (SELECT 2.0 * ln(count(*) / CAST(0.5 AS DOUBLE)) / CAST(1.5 AS DOUBLE) AS t FROM k),
    sc AS (SELECT k.k, -max(((t * k.s - k.q) - (t * f.s - f.q)) / (k.s + f.s)) AS score FROM k, f, t GROUP BY k.k)
    SELECT arg_max(k, score * (0.5 * 1.5) + {gumbel_sql('gem', 'k')}) AS k FROM sc""",
)
def generalized_exponential_mechanism(spark, sf):
    c = _candidates(spark, sf).select(F.concat_ws("/", F.col("nation").cast("string"), "seg").alias("k"), "q", "s")
    return G.generalized_exponential_mechanism(c, "k", "q", "s", 1.5, seed="gem")


@query(
    "pareto_front",
    """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS q, p_retailprice AS s FROM part)
    SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.q >= a.q AND b.s <= a.s AND (b.q > a.q OR b.s < a.s))""",
)
def pareto_front(spark, sf):
    p = table(spark, sf, "part")
    return G.pareto_front(p.select("p_partkey", F.col("p_size").cast("double").alias("q"), F.col("p_retailprice").alias("s")), "q", "s")


@query("zcdp_budget")
def zcdp_budget(spark, sf):
    """rho and sigma for releases per priority class, delta one over ten times the class size."""
    sizes = table(spark, sf, "orders").groupBy("o_orderpriority").agg(n_rows())
    grid = sizes.withColumn("epsilon", F.explode(F.array(*[F.lit(e) for e in (0.1, 0.5, 1.0, 5.0, 10.0)])))
    return G.zcdp_budget(grid.withColumn("delta", F.lit(0.1) / F.col("n")))


@query(
    "budget_ledger",
    """WITH s AS (SELECT event_id, user_id, round(value / 1000, 9) AS rho, ts FROM events),
    l AS (SELECT *, sum(rho) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM s)
    SELECT event_id, user_id, rho, round(used, 6) AS rho_used, round(5.0 - used, 6) AS rho_left, used <= 5.0 AS accepted,
      round(sqrt(0.5 / rho), 6) AS sigma, round(sqrt(8.0 * rho), 6) AS epsilon FROM l""",
)
def budget_ledger(spark, sf):
    """Every event is a release by its user; spending stops at the user's budget."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.round(F.col("value") / 1000, 9).alias("rho"), "ts")
    out = G.budget_ledger(e, "user_id", F.col("ts"), F.to_date("ts"), "rho", 5.0, ["event_id"])
    return rounded(out.drop("ts"), "rho_used", "rho_left", "sigma", "epsilon")


@query(
    "weighted_sample",
    f"""WITH {ITM}, {ORD}, c AS (SELECT flag, status, qty, flag * 10 + status * 5 + qty AS cell, sum(weight) AS w FROM itm GROUP BY ALL),
    k AS (SELECT * FROM c WHERE w / (SELECT sum(w) FROM c) >= CAST(0.5 AS DOUBLE) / (SELECT count(*) FROM c)),
    s AS (SELECT *, sum(w) OVER (ORDER BY cell) / (SELECT sum(w) FROM k) AS hi, row_number() OVER (ORDER BY cell DESC) AS last FROM k),
    b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY cell), 0.0) AS lo FROM s)
    SELECT o.id, b.flag, b.status, b.qty FROM ord o JOIN b ON {u_sql('ws', 'o.id')} >= b.lo AND ({u_sql('ws', 'o.id')} < b.hi OR b.last = 1)""",
)
def weighted_sample(spark, sf):
    """One weighted cell of the line items for every order."""
    cells = items(spark, sf).groupBy("flag", "status", "qty").agg(F.sum("weight").alias("w"))
    cells = cells.withColumn("cell", F.col("flag") * 10 + F.col("status") * 5 + F.col("qty"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.weighted_sample(cells, "cell", "w", rows, "id", "ws").select("id", "flag", "status", "qty")


@query(
    "expand_rounded",
    f"""WITH {ORD}, c AS (SELECT status, prio, CAST(round_even(count(*) / CAST(64 AS DOUBLE), 0) AS BIGINT) AS k FROM ord GROUP BY ALL)
    SELECT status, prio, i AS copy FROM c, range(1, 100000) r(i) WHERE i <= k""",
)
def expand_rounded(spark, sf):
    cells = orders(spark, sf).groupBy("status", "prio").agg((F.count(F.lit(1)) / 64.0).alias("mass"))
    return G.expand_rounded(cells, "mass").select("status", "prio", "copy")


@query(
    "round_counts",
    f"""WITH {ITM}, c AS (SELECT flag, disc, sum(weight) AS v FROM itm GROUP BY ALL),
    s AS (SELECT *, round(v * 1000.0 / sum(v) OVER (PARTITION BY flag), 9) AS x FROM c),
    p AS (SELECT *, floor(x) AS whole, x - floor(x) AS frac FROM s),
    q AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY CASE WHEN frac > 0 THEN -ln({u_sql('rc', 'flag', 'disc')}) / frac END NULLS LAST, disc) AS rk,
      sum(whole) OVER (PARTITION BY flag) AS wholes FROM p)
    SELECT flag, disc, CAST(whole + CAST(rk <= 1000 - wholes AS INTEGER) AS BIGINT) AS rounded FROM q""",
)
def round_counts(spark, sf):
    """Weight per discount scaled to 1000 rows for every flag."""
    c = items(spark, sf).groupBy("flag", "disc").agg(F.sum("weight").alias("v")).withColumn("want", F.lit(1000))
    return G.round_counts(c, ["flag"], "disc", "v", "rc", "want").select("flag", "disc", "rounded")


@query(
    "stratified_kfold",
    f"""SELECT o_orderkey AS id, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u_sql('kf', 'o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def stratified_kfold(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return G.stratified_kfold(o, "o_orderstatus", "id", 5, "kf").select("id", "fold")


@query(
    "inject_missing",
    f"""WITH {ORD}, a AS (SELECT *, row_number() OVER (ORDER BY {u_sql('mc', 'id')}, id) AS rn,
      row_number() OVER (PARTITION BY status ORDER BY {u_sql('ma', 'id')}, id) AS rs FROM ord)
    SELECT id, CASE WHEN rn > floor((SELECT count(*) FROM ord) * CAST(0.13 AS DOUBLE)) THEN prio END AS mcar,
      CASE WHEN status <> 2 OR rs > floor((SELECT count(*) FROM ord WHERE status = 2) * CAST(0.4 AS DOUBLE)) THEN prio END AS mar FROM a""",
)
def inject_missing(spark, sf):
    o = orders(spark, sf).select("id", "status", F.col("prio").alias("mcar"), F.col("prio").alias("mar"))
    o = G.inject_missing(o, "mcar", "id", 0.13, "mc")
    return G.inject_missing(o, "mar", "id", 0.4, "ma", "MAR", "status", 2).select("id", "mcar", "mar")


@query(
    "inject_missing_mnar",
    f"""WITH {ORD}, s AS (SELECT prio, count(*) / CAST((SELECT count(*) FROM ord) AS DOUBLE) AS share FROM ord GROUP BY prio),
    l AS (SELECT prio AS last FROM s ORDER BY share, prio LIMIT 1),
    q AS (SELECT prio, share, {u_sql('mn/rate', 'prio')} * CAST(0.3 AS DOUBLE) AS rate FROM s),
    p AS (SELECT prio, CASE WHEN prio = (SELECT last FROM l) THEN (CAST(0.3 AS DOUBLE) - (SELECT sum(share * rate) FROM q WHERE prio <> (SELECT last FROM l))) / share ELSE rate END AS rate FROM q)
    SELECT id, CASE WHEN {u_sql('mn', 'id')} < rate THEN NULL ELSE o.prio END AS prio FROM ord o JOIN p USING (prio)""",
)
def inject_missing_mnar(spark, sf):
    o = orders(spark, sf).select("id", "prio")
    return G.inject_missing(o, "prio", "id", 0.3, "mn", "MNAR")


_COND = {"status": {0: 1.0, 1: 0.25}, "price": {0: 0.5, 4: 1.0}}


@query(
    "inject_missing_conditional",
    f"""WITH {ORD}, w AS (SELECT *, atan(CASE status WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.0 END + CASE price WHEN 0 THEN 0.5 WHEN 4 THEN 1.0 ELSE 0.0 END)
      / atan(CAST(2 AS DOUBLE)) AS w FROM ord),
    k AS (SELECT *, row_number() OVER (PARTITION BY w > 0 ORDER BY CASE WHEN w > 0 THEN 1.0 - exp(ln({u_sql('mb', 'id')}) / w) END, id) AS rn FROM w)
    SELECT id, CASE WHEN w > 0 AND rn <= floor((SELECT count(*) FROM ord) * CAST(0.2 AS DOUBLE)) THEN NULL ELSE prio END AS prio FROM k""",
)
def inject_missing_conditional(spark, sf):
    o = orders(spark, sf).drop("total")
    return G.inject_missing_conditional(o, "prio", "id", 0.2, _COND, "mb").select("id", "prio")


@query(
    "inject_y_conditioned_noise",
    f"""WITH {ORD}, p AS (SELECT y, floor((1.0 - y / 2.0) * 4) AS peak FROM (SELECT DISTINCT status AS y FROM ord)),
    d AS (SELECT y, x, sum(exp(-abs(x - peak) * CAST(1.5 AS DOUBLE))) OVER (PARTITION BY y ORDER BY x) AS cum,
      sum(exp(-abs(x - peak) * CAST(1.5 AS DOUBLE))) OVER (PARTITION BY y) AS mass FROM p, (SELECT DISTINCT prio AS x FROM ord)),
    s AS (SELECT *, row_number() OVER (ORDER BY {u_sql('yc/row', 'id')}, id) AS rn, {u_sql('yc/x', 'id')} AS u FROM ord)
    SELECT id, status, CASE WHEN rn <= floor((SELECT count(*) FROM ord) * CAST(0.25 AS DOUBLE))
      THEN (SELECT min(x) FROM d WHERE d.y = s.status AND d.cum > s.u * d.mass) ELSE prio END AS prio FROM s""",
)
def inject_y_conditioned_noise(spark, sf):
    o = orders(spark, sf).select("id", "status", "prio")
    return G.inject_y_conditioned_noise(o, "prio", "status", "id", 0.25, 1.5, "yc")


@query(
    "rank_couple_noise",
    f"""WITH {ORD}, st AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM ord),
    c AS (SELECT id, round_even((m + s * {gauss_sql('rk', 'id')}) * CASE WHEN {u_sql('rk/sign', 'id')} < 0.5 THEN -1.0 ELSE 1.0 END, 0) AS noise FROM ord, st),
    a AS (SELECT noise, row_number() OVER (ORDER BY noise, {u_sql('rk/c', 'id')}, id) AS rm FROM c),
    b AS (SELECT id, prio, row_number() OVER (ORDER BY -price, {u_sql('rk/s', 'id')}, id) AS rn FROM ord)
    SELECT id, prio + noise * CASE WHEN {u_sql('rk/mask', 'id')} < CAST(0.7 AS DOUBLE) THEN 1.0 ELSE 0.0 END AS prio FROM a JOIN b ON a.rm = b.rn""",
)
def rank_couple_noise(spark, sf):
    o = orders(spark, sf).select("id", "prio", "price")
    return G.rank_couple_noise(o, ["prio"], "price", "id", "rk", fraction=0.7).select("id", "prio")


@query(
    "rescale_to_domain",
    f"""WITH {ORD}, n AS (SELECT id, prio + 3.0 * {gauss_sql('rs', 'id')} AS x FROM ord), s AS (SELECT min(x) a, max(x) b FROM n)
    SELECT id, round_even((x - a) / (b - a) * 4.0 + 0.0, 0) AS prio FROM n, s""",
)
def rescale_to_domain(spark, sf):
    o = orders(spark, sf).select("id", "prio")
    noisy = o.withColumn("prio", F.col("prio") + F.lit(3.0) * gaussian("rs", "id"))
    return G.rescale_to_domain(noisy, o, ["prio"])


@query(
    "noisy_scores",
    f"""WITH p AS (SELECT o_orderstatus AS a, o_orderpriority AS b, avg(o_totalprice) / 1000 AS score FROM orders GROUP BY ALL)
    SELECT a, b, round(greatest(score + 200.0 * {gauss_sql('ns', 'a', 'b')}, 0.0), 6) AS score FROM p""",
)
def noisy_scores(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(
        (F.avg("o_totalprice") / 1000).alias("score")
    )
    return rounded(G.noisy_scores(p, 200.0, ["a", "b"], "ns"), "score")


@query(
    "one_row_per_group",
    f"""SELECT o_custkey, arg_min(o_orderkey, {u_sql('og', 'o_orderkey')}) AS o_orderkey FROM orders GROUP BY o_custkey""",
)
def one_row_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return E.one_row_per_group(o, "o_custkey", "o_orderkey", "og")


@query(
    "shuffle_rows",
    f"SELECT event_id, row_number() OVER (ORDER BY {u_sql('sh', 'event_id')}, event_id) AS position FROM events",
)
def shuffle_rows(spark, sf):
    return E.shuffle_rows(table(spark, sf, "events").select("event_id"), "event_id", "sh")


@query(
    "permute_within_strata",
    f"""WITH {ORD}, s AS (SELECT id, status, yr, row_number() OVER (PARTITION BY yr ORDER BY {u_sql('pw/slot', 'id')}, id) AS rn FROM ord),
    c AS (SELECT prio, yr, row_number() OVER (PARTITION BY yr ORDER BY {u_sql('pw/card', 'id')}, id) AS rm FROM ord)
    SELECT s.id, s.status, s.yr, c.prio FROM s JOIN c ON s.yr = c.yr AND s.rn = c.rm""",
)
def permute_within_strata(spark, sf):
    o = orders(spark, sf).select("id", "status", "prio", "yr")
    return C.permute_within_strata(o, ["prio"], ["yr"], "id", "pw")


@query(
    "hash_uniform",
    f"SELECT event_id, round({u_sql('hu', 'event_id', 'event_type')}, 12) AS u FROM events",
)
def hash_uniform(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(uniform("hu", "event_id", "event_type"), 12).alias("u"))


