"""Repair, reweighting, table fitting and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ITEM_DOMAIN, ITEM_RULE, ITM, ORD, ORDER_DOMAIN, docs, gauss_sql, items, orders, query, rounded, u_sql,
)
from catalog.counts import _pair_sql
from catalog.independence import cells_sql
from margrid.domain import Constraint
from margrid.functions.hashing import uniform
from margrid.operators import factors as K
from margrid.operators import fit as T
from margrid.operators import learn as L
from margrid.operators import marginals as M
from margrid.operators import noise as G
from margrid.operators import repair as R

_CI = f"{ITM}, c AS (SELECT flag, status, qty, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL)"
_FLAT = "sum(n) OVER (PARTITION BY flag, qty) * sum(n) OVER (PARTITION BY status, qty) / sum(n) OVER (PARTITION BY qty)"


@query("ci_projection", f"WITH {_CI} SELECT flag, status, qty, round({_FLAT}, 6) AS value FROM c")
def ci_projection(spark, sf):
    return rounded(R.ci_projection(items(spark, sf), ITEM_RULE), "value")


@query(
    "repair_weights",
    f"WITH {_CI}, w AS (SELECT flag, status, qty, {_FLAT} / n AS w FROM c) "
    "SELECT flag, status, qty, count(*) AS n, round(sum(w), 6) AS weight FROM itm JOIN w USING (flag, status, qty) GROUP BY ALL",
)
def repair_weights(spark, sf):
    rows = R.repair_weights(items(spark, sf).select("flag", "status", "qty"), ITEM_RULE)
    return rows.groupBy("flag", "status", "qty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("repaired_weights"), 6).alias("weight"))


@query(
    "repair_impact",
    f"""WITH {ITM}, {cells_sql('itm', 'flag', 'status', 'qty')}
    SELECT round(sum(n / t * log2(n * nz / (nxz * nyz))), 9) AS cmi_before, CAST(0 AS DOUBLE) AS cmi_after, round(sum(abs(n - nxz * nyz / nz)) / 2, 6) AS moved FROM m""",
)
def repair_impact(spark, sf):
    return rounded(rounded(R.repair_impact(items(spark, sf), ITEM_RULE), "cmi_before", "cmi_after", digits=9), "moved")


_ORDER_PLAN = """cells AS (SELECT status, price, count(*) / CAST((SELECT count(*) FROM ord) AS DOUBLE) AS share FROM ord GROUP BY status, price),
  plan AS (SELECT status, price, (status + 1) % 3 AS t_status, price AS t_price, share * 0.25 AS mass FROM cells
    UNION ALL SELECT status, price, status, (price + 1) % 5, share * 0.125 FROM cells UNION ALL SELECT status, price, status, price, share * 0.625 FROM cells)"""


def _order_plan(spark, sf):
    """Each (status, price) cell sends a quarter to the next status, an eighth to the next price."""
    o = orders(spark, sf)
    c = o.groupBy("status", "price").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / c.select(F.sum("n")).scalar()
    move = lambda s, p, m: c.select("status", "price", s.alias("t_status"), p.alias("t_price"), (share * m).alias("mass"))
    s, p = F.col("status"), F.col("price")
    return move((s + 1) % 3, p, 0.25).unionByName(move(s, (p + 1) % 5, 0.125)).unionByName(move(s, p, 0.625))


@query(
    "apply_repair_plan",
    f"""WITH {ORD}, {_ORDER_PLAN}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ord),
    mv AS (SELECT *, CAST(round_even(mass * n, 0) AS BIGINT) AS k FROM plan, n WHERE mass > 0.5 / n AND NOT (status = t_status AND price = t_price)),
    e AS (SELECT *, sum(k) OVER (PARTITION BY status, price ORDER BY t_status, t_price) AS hi FROM mv), e2 AS (SELECT *, hi - k AS lo FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY status, price ORDER BY {u_sql('rp', 'id')}, id) AS rn FROM ord)
    SELECT o.id, coalesce(e2.t_status, o.status) AS status, coalesce(e2.t_price, o.price) AS price, e2.k IS NOT NULL AS moved
    FROM o LEFT JOIN e2 ON o.status = e2.status AND o.price = e2.price AND o.rn > e2.lo AND o.rn <= e2.hi""",
)
def apply_repair_plan(spark, sf):
    o = orders(spark, sf).select("id", "status", "price")
    return R.apply_repair_plan(o, ["status", "price"], "id", _order_plan(spark, sf), "rp")


@query(
    "top_k_repairs",
    f"""WITH {ORD}, {_ORDER_PLAN}, s AS (SELECT status, price, round(sum(CASE WHEN status = t_status AND price = t_price THEN 0 ELSE mass END), 12) AS score FROM plan GROUP BY status, price)
    SELECT * FROM (SELECT id, status, price, row_number() OVER (ORDER BY -score, {u_sql('tk', 'id')}, id) AS rank FROM ord JOIN s USING (status, price)) WHERE rank <= 2500""",
)
def top_k_repairs(spark, sf):
    o = orders(spark, sf).select("id", "status", "price")
    return R.top_k_repairs(o, ["status", "price"], "id", _order_plan(spark, sf), 2500, "tk")


@query(
    "top_k_best_move",
    f"""WITH {ORD}, {_ORDER_PLAN}, b AS (SELECT status, price, max({{'mass': mass, 't_status': t_status, 't_price': t_price}}) AS b FROM plan GROUP BY status, price)
    SELECT id, status, price, t_status, t_price, rank FROM (SELECT id, status, price, b.t_status AS t_status, b.t_price AS t_price,
      row_number() OVER (ORDER BY -round(b.mass, 12), {u_sql('tb', 'id')}, id) AS rank FROM ord JOIN b USING (status, price)) WHERE rank <= 2500""",
)
def top_k_best_move(spark, sf):
    o = orders(spark, sf).select("id", "status", "price")
    out = R.top_k_repairs(o, ["status", "price"], "id", _order_plan(spark, sf), 2500, "tb", by="best")
    return out.select("id", "status", "price", "t_status", "t_price", "rank")


# ---------------------------------------------------------------- fits


def _counts(df, *attrs):
    return df.groupBy(*attrs).agg(F.count(F.lit(1)).cast("double").alias("value"))


_START = f"{ITM}, t AS (SELECT flag, disc, sum(weight) AS v FROM itm GROUP BY ALL), fm AS (SELECT flag, CAST(count(*) AS DOUBLE) AS m FROM itm GROUP BY flag), dm AS (SELECT disc, CAST(count(*) AS DOUBLE) AS m FROM itm GROUP BY disc)"


@query(
    "ipf_round",
    f"""WITH {_START}, a AS (SELECT flag, disc, v * m / sum(v) OVER (PARTITION BY flag) AS v FROM t JOIN fm USING (flag))
    SELECT flag, disc, round(v * m / sum(v) OVER (PARTITION BY disc), 6) AS value FROM a JOIN dm USING (disc)""",
)
def ipf_round(spark, sf):
    """Quantities raked once to the row counts of both margins."""
    t = items(spark, sf)
    start = t.groupBy("flag", "disc").agg(F.sum("weight").alias("value"))
    margins = [_counts(t, a).withColumnRenamed("value", "target") for a in ("flag", "disc")]
    return rounded(T.ipf(start, margins, 1), "value")


@query(
    "ipf",
    f"WITH {_START} SELECT flag AS code, 'flag' AS attr, round(m, 2) AS value FROM fm UNION ALL SELECT disc, 'disc', round(m, 2) FROM dm",
)
def ipf(spark, sf):
    """After some rounds both margins of the raked table are met."""
    t = items(spark, sf)
    start = t.groupBy("flag", "disc").agg(F.sum("weight").alias("value"))
    margins = [_counts(t, a).withColumnRenamed("value", "target") for a in ("flag", "disc")]
    fitted = T.ipf(start, margins, 4)
    side = lambda a: K.factor_project(fitted, [a]).select(F.col(a).alias("code"), F.lit(a).alias("attr"), F.round("value", 2).alias("value"))
    return side("flag").unionByName(side("disc"))


_OVERLAP = f"""{ITM}, ab AS (SELECT flag, qty, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL), bc AS (SELECT qty, disc, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL),
  b AS (SELECT qty, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL), j AS (SELECT flag, qty, disc, ab.v * bc.v / b.v AS v FROM ab JOIN bc USING (qty) JOIN b USING (qty))"""


@query("kikuchi_marginal", f"WITH {_OVERLAP} SELECT flag, qty, disc, round(v * 1000.0 / (SELECT sum(v) FROM j), 8) AS value FROM j")
def kikuchi_marginal(spark, sf):
    t = items(spark, sf)
    tables = {("flag", "qty"): _counts(t, "flag", "qty"), ("qty", "disc"): _counts(t, "qty", "disc")}
    return rounded(T.kikuchi_marginal(tables, ITEM_DOMAIN, 1000.0), "value", digits=8)


@query("extend_marginal", f"WITH {_OVERLAP} SELECT flag, qty, disc, round(v, 3) AS value FROM j")
def extend_marginal(spark, sf):
    """The new clique is decided by its two overlapping neighbours."""
    t = items(spark, sf)
    tables = {("flag", "qty", "status"): _counts(t, "flag", "qty", "status"), ("qty", "line", "disc"): _counts(t, "qty", "line", "disc")}
    total = float(t.count())
    return rounded(T.extend_marginal(tables, ["flag", "qty", "disc"], ITEM_DOMAIN, total, 3), "value", digits=3)


_SUB = ORDER_DOMAIN.project(["status", "prio", "price"])
_CL = [("status", "prio"), ("price",)]


@query("multiplicative_weights")
def multiplicative_weights(spark, sf):
    """Probability tables fitted to noisy tables of two separate groups, multiplied out."""
    o = orders(spark, sf)
    m = G.gaussian_measure(M.clique_marginals(o, _SUB, _CL), 20.0, {"status,prio": 1.0, "price": 1.0}, "mw")
    state = T.multiplicative_weights(m, _SUB, _CL, float(o.count()), 8)
    a, b = [T.group_table(state, _SUB, c) for c in _CL]
    return rounded(K.factor_product(a, b, _SUB), "value", digits=9)


_MW = f"""{ORD}, m AS ({_pair_sql(_SUB.project(['status', 'prio']), 'ord', 2)}), y AS (SELECT cell, value + 20.0 * {gauss_sql('m1', 'clique', 'cell')} AS noisy FROM m),
  n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ord), w AS (SELECT cell, exp((noisy - n / 15.0) / (2.0 * n)) / 15.0 AS v FROM y, n)"""


@query("multiplicative_weights_round", f"WITH {_MW} SELECT CAST(cell // 5 AS INTEGER) AS status, CAST(cell % 5 AS INTEGER) AS prio, round(v / (SELECT sum(v) FROM w), 9) AS value FROM w")
def multiplicative_weights_round(spark, sf):
    o = orders(spark, sf)
    m = G.gaussian_measure(M.clique_marginals(o, _SUB, [("status", "prio")]), 20.0, {"status,prio": 1.0}, "m1")
    state = T.multiplicative_weights(m, _SUB, [("status", "prio")], float(o.count()), 1)
    return rounded(T.group_table(state, _SUB, ("status", "prio")), "value", digits=9)


@query("reweight_public")
def reweight_public(spark, sf):
    """Early orders weighted so that their marginals match noisy marginals of all orders."""
    o = orders(spark, sf)
    cliques = [("status", "prio"), ("prio", "price")]
    m = G.gaussian_measure(M.clique_marginals(o, _SUB, cliques), 10.0, {"status,prio": 1.0, "prio,price": 1.0}, "pub")
    return rounded(T.reweight_public(o.where(F.col("yr") < 3), _SUB, m, cliques, float(o.count()), 5), "weight", "row_weight")


# ---------------------------------------------------------------- models


def _features(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id", "quality", "toxic", F.log("n_chars").alias("size"), F.substring("source", 4, 2).cast("double").alias("src"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("english"),
    )


FEATURES = ["toxic", "size", "src", "english"]


def _split(spark, sf):
    d = _features(spark, sf)
    u = uniform("split", "doc_id")
    return d.where(u < 0.7), d.where(u >= 0.7)


@query("train_score")
def train_score(spark, sf):
    """Every classifier of the list on the labelled documents."""
    train, test = _split(spark, sf)
    out = None
    for name in ("LR", "RF", "GBT", "SVM", "BSVM", "MLP"):
        row = L.train_score(train, test, FEATURES, "quality", name, key="doc_id")
        out = row if out is None else out.unionByName(row)
    return out


@query("train_score_weighted")
def train_score_weighted(spark, sf):
    """Training with repair weights as row weights."""
    train, test = _split(spark, sf)
    weighted = R.repair_weights(train, Constraint.of("toxic", "quality", "english"))
    return L.train_score(weighted, test, FEATURES, "quality", "LR", weight="repaired_weights")


@query("evaluate_folds")
def evaluate_folds(spark, sf):
    d = G.stratified_kfold(_features(spark, sf), "quality", "doc_id", 2, "ev").withColumnRenamed("fold", "cs")
    half = d.where(uniform("ev/half", "doc_id") < 0.6)
    tag = lambda t, m, e: t.withColumns({"method": F.lit(m), "eps": F.lit(e), "cs": 1 - F.col("cs")})
    folds = tag(d, "Original", "").unionByName(tag(half, "half", "1"))
    return rounded(L.evaluate_folds(folds, d, FEATURES, "quality", ["LR"]), "value")


@query("select_model")
def select_model(spark, sf):
    train, test = _split(spark, sf)
    return L.select_model(train, test, FEATURES, "quality", folds=2)


@query("feature_ranking")
def feature_ranking(spark, sf):
    return L.feature_ranking(_features(spark, sf), FEATURES, "quality")


@query("feature_importance")
def feature_importance(spark, sf):
    return rounded(L.feature_importance(_features(spark, sf), FEATURES, "quality"), "coefficient")


@query("impute_with_model")
def impute_with_model(spark, sf):
    o = orders(spark, sf).withColumn("price", F.when(F.col("id") % 9 != 0, F.col("price")))
    filled = L.impute_with_model(o, "price", ["status", "prio", "yr"])
    return filled.groupBy("price").agg(F.count(F.lit(1)).alias("n"))


