"""Compression, scores, trees, fits and synthetic tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import (
    ITEM_DOMAIN, ITEM_RULE, ITM, ORD, ORDER_DOMAIN, ORDER_RULE, gauss_sql, items, orders, query, r, rounded, table, u_sql,
)
from catalog.counts import _pair_sql
from margrid.domain import Domain
from margrid.operators import distance as D
from margrid.operators import marginals as M
from margrid.operators import noise as G
from margrid.operators import select as S
from margrid.operators.fit import blend_ci
from margrid.plans import adaptive as A
from margrid.plans import grid as P
from margrid.plans import sampling as N
from margrid.plans import synthesis as Y

EPS, DELTA = 1.0, 1e-9
_SIGMA = 60.0
_RARE = f"{ORD}, rare AS (SELECT id, status, prio, yr, CASE WHEN id % 50 = 0 THEN price WHEN price > 2 THEN 2 ELSE price END AS price FROM ord)"


def _rare(spark, sf):
    """Orders whose upper price classes are nearly empty."""
    p = F.when(F.col("id") % 50 == 0, F.col("price")).when(F.col("price") > 2, 2).otherwise(F.col("price"))
    return orders(spark, sf).withColumn("price", p).drop("total")


_ONES = f"""m AS ({_pair_sql(ORDER_DOMAIN, 'rare', 1)}),
  y AS (SELECT clique AS attr, CAST(cell AS INTEGER) AS code, value + {_SIGMA} * 2.0 * {gauss_sql('cd/one', 'clique', 'cell')} AS noisy, {_SIGMA} * 2.0 AS sd FROM m),
  s AS (SELECT *, CAST(noisy >= 3.0 * sd AS INTEGER) AS keep FROM y),
  mp AS (SELECT attr, code, noisy, sd, CAST(CASE WHEN keep = 1 THEN sum(keep) OVER (PARTITION BY attr ORDER BY code) - 1 ELSE sum(keep) OVER (PARTITION BY attr) END AS INTEGER) AS small FROM s)"""


def _compression(spark, sf):
    joint = M.joint_counts(_rare(spark, sf), ORDER_DOMAIN)
    return Y.compress_domain(Y.measure_ones(joint, ORDER_DOMAIN, _SIGMA, "cd"), ORDER_DOMAIN)


@query("compress_domain", f"WITH {_RARE}, {_ONES} SELECT attr, small AS code, round(sum(noisy), 4) AS noisy, round(sqrt(sum(sd * sd)), 4) AS stddev FROM mp GROUP BY ALL")
def compress_domain(spark, sf):
    out = Y.compressed_measurements(_compression(spark, sf).mapping)
    return rounded(out, "noisy", "stddev", digits=4)


@query(
    "restore_domain",
    f"""WITH {_RARE}, {_ONES}, z AS (SELECT id, mp.small FROM rare JOIN mp ON mp.attr = 'price' AND mp.code = rare.price),
    g AS (SELECT small, list(code ORDER BY code) AS codes FROM mp WHERE attr = 'price' GROUP BY small)
    SELECT id, codes[CAST(floor({u_sql('rd/restore/price', 'id')} * len(codes)) AS BIGINT) + 1] AS price FROM z JOIN g USING (small)""",
)
def restore_domain(spark, sf):
    c = _compression(spark, sf)
    return c.restore(c.apply(_rare(spark, sf)), "id", "rd").select("id", "price")


def _scores_sql(domain: Domain, cte: str) -> str:
    parts = []
    for a, b in combinations(domain.attrs, 2):
        parts.append(
            f"SELECT '{a}' AS a, '{b}' AS b, (SELECT sum(abs(coalesce(n, 0) - na * nb / t)) FROM (SELECT * FROM (SELECT {a}, CAST(count(*) AS DOUBLE) AS na FROM {cte} GROUP BY {a}), "
            f"(SELECT {b}, CAST(count(*) AS DOUBLE) AS nb FROM {cte} GROUP BY {b})) LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM {cte} GROUP BY {a}, {b}) USING ({a}, {b}), "
            f"(SELECT CAST(count(*) AS DOUBLE) AS t FROM {cte})) AS score"
        )
    return " UNION ALL ".join(parts)


def exact_scores(df, domain):
    ones = S.single_counts(df, domain).withColumnRenamed("n", "value")
    return S.pair_scores(S.pair_counts(df, domain), ones)


@query("pair_scores", f"WITH {ITM}, sc AS ({_scores_sql(ITEM_DOMAIN, 'itm')}) SELECT a, b, round(score, 6) AS score FROM sc")
def pair_scores(spark, sf):
    return rounded(exact_scores(items(spark, sf), ITEM_DOMAIN), "score")


@query("best_edge", f"WITH {ITM}, sc AS ({_scores_sql(ITEM_DOMAIN, 'itm')}) SELECT a, b, round(score, 6) AS score FROM sc ORDER BY score DESC LIMIT 1")
def best_edge(spark, sf):
    return rounded(S.best_edge(exact_scores(items(spark, sf), ITEM_DOMAIN)), "score")


_FORBIDDEN = "NOT ((a = 'status' AND b <> 'qty') OR (b = 'status' AND a <> 'qty'))"


@query("except_candidates", f"WITH {ITM}, sc AS ({_scores_sql(ITEM_DOMAIN, 'itm')}) SELECT a, b FROM sc WHERE {_FORBIDDEN}")
def except_candidates(spark, sf):
    scores = exact_scores(items(spark, sf), ITEM_DOMAIN)
    pairs = scores.select("a", "b")
    allowed = S.allowed_pairs(scores, ["status"], ["qty"]).select("a", "b")
    return S.except_candidates(pairs, pairs.subtract(allowed))


def _edge_table(spark, edges):
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")


@query(
    "select_tree_fair_greedy",
    f"""WITH RECURSIVE {ITM}, sc AS ({_scores_sql(ITEM_DOMAIN, 'itm')}), e AS (SELECT * FROM sc WHERE {_FORBIDDEN}),
    reach AS (SELECT e.a, e.b, e.score, e.a AS at FROM e
      UNION SELECT r.a, r.b, r.score, CASE WHEN f.a = r.at THEN f.b ELSE f.a END FROM reach r JOIN e f ON f.score > r.score AND (f.a = r.at OR f.b = r.at))
    SELECT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = e.a AND r.b = e.b AND r.at = e.b)""",
)
def select_tree_fair_greedy(spark, sf):
    """Best tree whose outcome only touches the admissible attribute, without noise."""
    scores = exact_scores(items(spark, sf), ITEM_DOMAIN)
    return _edge_table(spark, S.select_tree_fair_greedy(scores, ITEM_DOMAIN, ["status"], ["qty"]))


@query("select_tree")
def select_tree(spark, sf):
    return _edge_table(spark, S.select_tree(exact_scores(items(spark, sf), ITEM_DOMAIN), ITEM_DOMAIN, 0.05, "st"))


@query("select_tree_hard_constraint")
def select_tree_hard_constraint(spark, sf):
    scores = exact_scores(items(spark, sf), ITEM_DOMAIN)
    return _edge_table(spark, S.select_tree_hard_constraint(scores, ITEM_DOMAIN, ["flag"], ["status"], ["qty"], 0.05, "sh"))


@query("select_tree_noisy_max")
def select_tree_noisy_max(spark, sf):
    noisy = G.noisy_scores(exact_scores(items(spark, sf), ITEM_DOMAIN), 5.0, ["a", "b"], "nm")
    return _edge_table(spark, S.select_tree_noisy_max(noisy, ITEM_DOMAIN, ["flag"], ["status"], ["qty"]))


_CHAIN = [("flag", "qty"), ("qty", "disc"), ("line", "disc"), ("status", "qty")]


@query(
    "fit_tree",
    f"WITH {ITM} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, ca, cb, round(CAST(coalesce(n, 0) AS DOUBLE), 4) AS value FROM (SELECT * FROM (SELECT CAST(i AS INTEGER) AS ca FROM range({ITEM_DOMAIN[a]}) x(i)), "
        f"(SELECT CAST(i AS INTEGER) AS cb FROM range({ITEM_DOMAIN[b]}) x(i))) LEFT JOIN (SELECT {a} AS ca, {b} AS cb, count(*) AS n FROM itm GROUP BY ALL) USING (ca, cb)"
        for a, b in _CHAIN
    ),
)
def fit_tree(spark, sf):
    """Without noise the fitted edge tables are the counts."""
    return rounded(Y.exact_tree(items(spark, sf), ITEM_DOMAIN, _CHAIN).pairs, "value", digits=4)


def _draw_sql(child: str, parent: str | None = None) -> str:
    """CTE of cumulative shares of a child, per parent code if there is one."""
    by = f"PARTITION BY {parent} " if parent else ""
    keys = f"{parent}, {child}" if parent else child
    return f"""c_{child} AS (SELECT {keys}, sum(n) OVER ({by}ORDER BY {child}) AS cum, sum(n) OVER ({by}) AS mass
      FROM (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY {keys}))"""


def _pick_sql(child: str, parent: str | None = None) -> str:
    on = f"c.{parent} = s.{parent} AND " if parent else ""
    return f"""(SELECT min(c.{child}) FROM c_{child} c WHERE {on}c.cum > {u_sql(f'rows/{child}', 's.id')} * c.mass)"""


@query(
    "sample_tree",
    f"""WITH {ITM}, {_draw_sql('flag')}, {_draw_sql('qty', 'flag')}, {_draw_sql('disc', 'qty')},
    r0 AS (SELECT row_number() OVER () - 1 AS id FROM itm), r1 AS (SELECT id, {_pick_sql('flag')} AS flag FROM r0 s),
    r2 AS (SELECT id, flag, {_pick_sql('qty', 'flag')} AS qty FROM r1 s), r3 AS (SELECT id, flag, qty, {_pick_sql('disc', 'qty')} AS disc FROM r2 s)
    SELECT flag, qty, disc, count(*) AS n FROM r3 GROUP BY ALL""",
)
def sample_tree(spark, sf):
    """As many rows as there are line items, drawn from the exact tree; counts along one branch."""
    model = Y.exact_tree(items(spark, sf), ITEM_DOMAIN, _CHAIN)
    rows = N.sample_tree(model, int(model.total), "rows")
    return rows.groupBy("flag", "qty", "disc").agg(F.count(F.lit(1)).alias("n"))


@query("sample_tree_round", f"WITH {ITM} SELECT flag, count(*) AS n FROM itm GROUP BY flag")
def sample_tree_round(spark, sf):
    """Rounded sampling reproduces the root's counts exactly."""
    model = Y.exact_tree(items(spark, sf), ITEM_DOMAIN, _CHAIN)
    rows = N.sample_tree(model, int(model.total), "deal", "round")
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("mst_synthesize")
def mst_synthesize(spark, sf):
    return Y.mst_synthesize(orders(spark, sf), ORDER_DOMAIN, EPS, DELTA, "mst")


@query("ci_blend_synthesize")
def ci_blend_synthesize(spark, sf):
    return Y.ci_blend_synthesize(orders(spark, sf), ORDER_DOMAIN, ORDER_RULE, EPS, DELTA, 1.0, "blend")


@query("hard_synthesize")
def hard_synthesize(spark, sf):
    return Y.hard_synthesize(orders(spark, sf), ORDER_DOMAIN, ORDER_RULE, EPS, DELTA, "hard")


@query("fair_greedy_synthesize")
def fair_greedy_synthesize(spark, sf):
    return Y.fair_greedy_synthesize(orders(spark, sf), ORDER_DOMAIN, ORDER_RULE, EPS, DELTA, "greedy")


@query("fair_best_synthesize")
def fair_best_synthesize(spark, sf):
    return Y.fair_best_synthesize(orders(spark, sf), ORDER_DOMAIN, ORDER_RULE, EPS, DELTA, "best")


@query("synthesis_error")
def synthesis_error(spark, sf):
    """Workload error of a generous release against the orders it was made from."""
    o = orders(spark, sf)
    synth = Y.mst_synthesize(o, ORDER_DOMAIN, 100.0, DELTA, "err")
    return D.workload_error(o, synth, ORDER_DOMAIN, M.workload(ORDER_DOMAIN, 2))


_SMALL = ORDER_DOMAIN.project(["status", "prio", "price"])


@query("aim_synthesize")
def aim_synthesize(spark, sf):
    rows, _ = A.aim_synthesize(orders(spark, sf), ORDER_DOMAIN, 10.0, DELTA, seed="aim")
    return rows


@query("mwem_synthesize")
def mwem_synthesize(spark, sf):
    rows, _ = A.mwem_synthesize(orders(spark, sf), ORDER_DOMAIN, 10.0, DELTA, seed="mwem")
    return rows


@query("mwem_laplace")
def mwem_laplace(spark, sf):
    rows, _ = A.mwem_synthesize(orders(spark, sf), ORDER_DOMAIN, 10.0, DELTA, noise="laplace", bounded=True, seed="mweml")
    return rows


@query("adagrid_synthesize")
def adagrid_synthesize(spark, sf):
    return Y.adagrid_synthesize(orders(spark, sf), _SMALL, EPS, DELTA, seed="ada")


@query("adagrid_targets")
def adagrid_targets(spark, sf):
    return Y.adagrid_synthesize(orders(spark, sf), _SMALL, EPS, DELTA, targets=["status"], seed="adat")


_WORK = list(combinations(ORDER_DOMAIN.attrs, 2))
_ANSWER_SD = (0.5 / G.zcdp_rho(EPS, DELTA)) ** 0.5 * len(_WORK) ** 0.5


@query(
    "answer_workload_gaussian",
    f"WITH {ORD}, m AS ({_pair_sql(ORDER_DOMAIN, 'ord', 2)}) SELECT clique, cell, round(value + CAST({_ANSWER_SD!r} AS DOUBLE) * {gauss_sql('aw', 'clique', 'cell')}, 3) AS noisy FROM m",
)
def answer_workload_gaussian(spark, sf):
    out = Y.answer_workload_gaussian(orders(spark, sf), ORDER_DOMAIN, _WORK, EPS, DELTA, "aw")
    return out.select("clique", "cell", r("noisy", 3).alias("noisy"))


def _overlaps_sql() -> str:
    pairs = [(q, p) for i, p in enumerate(_WORK) for q in _WORK[:i] if set(p) & set(q)]
    return " UNION ALL ".join(f"SELECT '{','.join(q)}|{','.join(p)}' AS pair, CAST(0 AS DOUBLE) AS disagreement" for q, p in pairs)


@query("average_overlaps", _overlaps_sql())
def average_overlaps(spark, sf):
    noisy = Y.answer_workload_gaussian(orders(spark, sf), ORDER_DOMAIN, _WORK, EPS, DELTA, "ao")
    agreed = Y.average_overlaps(noisy, ORDER_DOMAIN, _WORK)
    return rounded(D.marginal_consistency(agreed, ORDER_DOMAIN, _WORK), "disagreement")


@query("bayes_net_sample")
def bayes_net_sample(spark, sf):
    return Y.bayes_net_sample(orders(spark, sf), ORDER_DOMAIN, 10.0, "net")


def _mixture(spark, sf):
    """Four components, one per pair of order years, each a product of its columns."""
    o = orders(spark, sf).withColumn("component", F.least(F.floor(F.col("yr") / 2), F.lit(3)))
    attrs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("code")) for a in _SMALL.attrs])
    counts = o.select("component", F.explode(attrs).alias("m")).groupBy("component", "m.attr", "m.code").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("component", "attr").agg(F.sum("n").alias("t"))
    return counts.join(totals, ["component", "attr"]).select("component", "attr", "code", (F.col("n") / F.col("t")).alias("value"))


_MIX = """o AS (SELECT *, least(yr // 2, 3) AS k FROM ord)"""


def _mix_cdf(a: str) -> str:
    return f"""m_{a} AS (SELECT k, {a}, sum(p) OVER (PARTITION BY k ORDER BY {a}) AS cum, sum(p) OVER (PARTITION BY k) AS mass
      FROM (SELECT k, {a}, count(*) / CAST(sum(count(*)) OVER (PARTITION BY k) AS DOUBLE) AS p FROM o GROUP BY k, {a}))"""


@query(
    "mixture_sample",
    f"""WITH {ORD}, {_MIX}, {_mix_cdf('status')}, {_mix_cdf('prio')}, {_mix_cdf('price')}, r AS (SELECT row_number() OVER () - 1 AS id FROM ord)
    SELECT id, """ + ", ".join(
        f"(SELECT min(c.{a}) FROM m_{a} c WHERE c.k = id % 4 AND c.cum > {u_sql(f'mix/{a}', 'r.id')} * c.mass) AS {a}" for a in ("status", "prio", "price")
    ) + " FROM r",
)
def mixture_sample(spark, sf):
    n = table(spark, sf, "orders").count()
    return N.mixture_sample(_mixture(spark, sf), _SMALL, n, 4, "mix")


@query(
    "mixture_cells",
    f"""WITH {ORD}, o AS (SELECT *, least(yr // 2, 3) AS k FROM ord), t AS (SELECT k, CAST(count(*) AS DOUBLE) AS t FROM o GROUP BY k),
    a AS (SELECT k, status, count(*) / any_value(t) AS p FROM o JOIN t USING (k) GROUP BY k, status), b AS (SELECT k, prio, count(*) / any_value(t) AS p FROM o JOIN t USING (k) GROUP BY k, prio),
    c AS (SELECT k, price, count(*) / any_value(t) AS p FROM o JOIN t USING (k) GROUP BY k, price)
    SELECT status, prio, price, round(sum(a.p * b.p * c.p) * 250.0, 8) AS value FROM a JOIN b USING (k) JOIN c USING (k) GROUP BY ALL""",
)
def mixture_cells(spark, sf):
    return rounded(N.mixture_cells(_mixture(spark, sf), _SMALL, 1000.0, 4), "value", digits=8)


@query("run_grid")
def run_grid(spark, sf):
    """Three folds by two budgets in one plan; row counts per key and status."""
    folded = G.stratified_kfold(orders(spark, sf), "status", "id", 3, "grid")
    rows = P.run_grid(folded, _SMALL, 3, [0.5, 5.0], DELTA, "grid")
    return rows.groupBy("cs", "eps", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "training_folds",
    f"""WITH {ORD}, f AS (SELECT id, CAST((row_number() OVER (PARTITION BY status ORDER BY {u_sql('tf', 'id')}, id) - 1) % 3 AS INTEGER) AS fold FROM ord)
    SELECT CAST(c.i AS INTEGER) AS cs, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f, range(3) c(i) WHERE fold <> c.i GROUP BY ALL""",
)
def training_folds(spark, sf):
    folded = G.stratified_kfold(orders(spark, sf), "status", "id", 3, "tf")
    return P.training_folds(folded, 3).groupBy("cs").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "blend_ci",
    f"""WITH {ITM}, c AS (SELECT flag, status, qty, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL)
    SELECT flag, status, qty, round(0.25 * n + 0.75 * sum(n) OVER (PARTITION BY flag, qty) * sum(n) OVER (PARTITION BY status, qty) / sum(n) OVER (PARTITION BY qty), 6) AS value FROM c""",
)
def blend(spark, sf):
    joint = items(spark, sf).groupBy("flag", "status", "qty").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(blend_ci(joint, ITEM_RULE.x, ITEM_RULE.y, ITEM_RULE.z, 0.75), "value")
