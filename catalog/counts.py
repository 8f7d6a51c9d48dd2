"""Marginals, distributions, factors and grids."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import (
    DOC, HALVES, ITM, ITEM_DOMAIN, ORD, ORDER_DOMAIN, axis_sql, docs, gauss_sql, halves, items, n_rows, orders, query, rounded, table,
)
from margrid.domain import Domain
from margrid.operators import factors as K
from margrid.operators import marginals as M
from margrid.operators import noise as G


TRIPLE = ["flag", "status", "qty"]


@query(
    "marginal",
    f"""WITH {ITM}, c AS (SELECT flag, status, line, disc, qty, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL)
    SELECT flag, status, line, disc, qty, coalesce(n, 0.0) AS value
    FROM (SELECT * FROM {axis_sql(flag=3, status=2, line=7, disc=11, qty=5)}) g LEFT JOIN c USING (flag, status, line, disc, qty)""",
)
def marginal(spark, sf):
    return M.marginal(items(spark, sf), ITEM_DOMAIN, ITEM_DOMAIN.attrs)


@query(
    "marginal_weighted",
    f"""WITH {ITM} SELECT flag, disc, sum(weight) AS value FROM itm GROUP BY ALL""",
)
def marginal_weighted(spark, sf):
    return M.marginal(items(spark, sf), ITEM_DOMAIN, ["flag", "disc"], weight="weight")


def _pair_sql(domain: Domain, cte: str, k: int) -> str:
    parts = []
    for attrs in combinations(domain.attrs, k):
        cell = " + ".join(f"CAST({a} AS BIGINT) * {s}" for a, s in domain.strides(attrs))
        parts.append(
            f"SELECT '{','.join(attrs)}' AS clique, i AS cell, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM range({domain.size(attrs)}) g(i) "
            f"LEFT JOIN (SELECT {cell} AS cell, count(*) AS n FROM {cte} GROUP BY 1) c ON c.cell = g.i"
        )
    return " UNION ALL ".join(parts)


@query("all_marginals", f"WITH {ITM} {_pair_sql(ITEM_DOMAIN, 'itm', 2)}")
def all_marginals(spark, sf):
    return M.all_marginals(items(spark, sf), ITEM_DOMAIN, 2)


@query("all_marginals_3way", f"WITH {ORD} {_pair_sql(ORDER_DOMAIN, 'ord', 3)}")
def all_marginals_3way(spark, sf):
    return M.all_marginals(orders(spark, sf), ORDER_DOMAIN, 3)


@query(
    "empirical_distribution",
    f"""WITH {ORD}, c AS (SELECT status, prio, yr, price, count(*) AS n FROM ord GROUP BY ALL)
    SELECT status, prio, yr, price, round(coalesce(n, 0) / CAST((SELECT count(*) FROM ord) AS DOUBLE), 9) AS p
    FROM (SELECT * FROM {axis_sql(status=3, prio=5, yr=7, price=5)}) g LEFT JOIN c USING (status, prio, yr, price)""",
)
def empirical_distribution(spark, sf):
    return rounded(M.empirical_distribution(orders(spark, sf), ORDER_DOMAIN, ORDER_DOMAIN.attrs), "p", digits=9)


@query(
    "weighted_distribution",
    f"""WITH {ITM} SELECT flag, status, qty, round(sum(weight) / (SELECT sum(weight) FROM itm), 9) AS p FROM itm GROUP BY ALL""",
)
def weighted_distribution(spark, sf):
    return rounded(M.empirical_distribution(items(spark, sf), ITEM_DOMAIN, TRIPLE, weight="weight"), "p", digits=9)


@query(
    "conditional_distribution",
    f"""WITH {DOC}, c AS (SELECT lang, source, quality, count(*) AS n FROM doc GROUP BY ALL),
    t AS (SELECT lang, source, count(*) AS t FROM doc GROUP BY ALL),
    g AS (SELECT * FROM (SELECT DISTINCT lang FROM doc), (SELECT DISTINCT source FROM doc), (SELECT DISTINCT quality FROM doc))
    SELECT g.lang, g.source, g.quality, CAST(coalesce(n, 0) AS DOUBLE) AS n, round(coalesce(n, 0) / CAST(t AS DOUBLE), 9) AS p
    FROM g LEFT JOIN c USING (lang, source, quality) LEFT JOIN t USING (lang, source)""",
)
def conditional_distribution(spark, sf):
    """Labels are sparse, so some combinations of language, source and quality have no rows."""
    return rounded(M.conditional_distribution(docs(spark, sf), "quality", ["lang", "source"]), "p", digits=9)


@query(
    "conditional_distribution_weighted",
    f"""WITH {ITM}, c AS (SELECT flag, qty, status, sum(weight) AS n FROM itm GROUP BY ALL)
    SELECT flag, qty, status, n, round(n / sum(n) OVER (PARTITION BY flag, qty), 9) AS p FROM c""",
)
def conditional_distribution_weighted(spark, sf):
    out = M.conditional_distribution(items(spark, sf), "status", ["flag", "qty"], weight="weight", fill=False)
    return rounded(out, "p", digits=9)


def _rollup_sql(label: str, key: str) -> str:
    return (
        f"SELECT '{label}' AS given, {key} AS key, status, count(*) AS n, "
        f"round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY {key}) AS DOUBLE), 9) AS p FROM itm GROUP BY {key}, status"
    )


@query(
    "conditional_rollups",
    f"WITH {ITM} " + " UNION ALL ".join(
        _rollup_sql(label, key)
        for label, key in {
            "S,N,A": "concat_ws('_', flag, line, qty)", "S,A": "concat_ws('_', flag, qty)",
            "S": "CAST(flag AS VARCHAR)", "A": "CAST(qty AS VARCHAR)",
        }.items()
    ),
)
def conditional_rollups(spark, sf):
    roles = [["flag", "line", "qty"], ["flag", "qty"], ["flag"], ["qty"]]
    return rounded(M.conditional_rollups(items(spark, sf), "status", roles, ["S,N,A", "S,A", "S", "A"]), "p", digits=9)


@query(
    "profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS attr, count(DISTINCT {c}) AS n_distinct, CAST(count(*) - count({c}) AS BIGINT) AS n_null, count(*) AS n_rows, "
        f"(SELECT max(n) FROM (SELECT count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count FROM events"
        for c in ("event_type", "user_id", "props")
    ),
)
def profile(spark, sf):
    return M.profile(table(spark, sf, "events"), ["event_type", "user_id", "props"])


@query(
    "contingency",
    f"""WITH {ORD} SELECT CASE WHEN grouping(x) = 0 THEN x END AS x, CASE WHEN grouping(y) = 0 THEN y END AS y, count(*) AS n
    FROM (SELECT concat_ws('_', status, yr) AS x, CAST(prio AS VARCHAR) AS y FROM ord) GROUP BY CUBE (x, y)""",
)
def contingency(spark, sf):
    return M.contingency(orders(spark, sf), ["status", "yr"], ["prio"])


_CLIQUES = """base AS (SELECT DISTINCT CAST(l_linenumber % 5 AS INTEGER) AS a, CAST(l_linenumber % 3 + 2 AS INTEGER) AS b,
    CAST(l_suppkey % 4 + 3 AS INTEGER) AS c FROM lineitem),
  cl AS (SELECT DISTINCT list_sort(list_distinct([a, b, c])) AS attrs FROM base)"""


def _cliques(spark, sf):
    """Attribute-id sets that occur together in line items, as a workload table."""
    t = table(spark, sf, "lineitem")
    ids = F.array(F.col("l_linenumber") % 5, F.col("l_linenumber") % 3 + 2, (F.col("l_suppkey") % 4 + 3).cast("int"))
    return t.select(F.array_sort(F.array_distinct(ids)).alias("attrs")).distinct()


@query(
    "workload_closure",
    f"""WITH {_CLIQUES}, w AS (SELECT attrs, CAST(len(attrs) AS DOUBLE) AS weight FROM cl),
    m AS (SELECT DISTINCT list_sort([x FOR x, i IN attrs IF ((mask >> (i - 1)) & 1) = 1]) AS sub
      FROM w, range(1, 8) r(mask) WHERE mask < (1 << len(attrs)))
    SELECT array_to_string(sub, ',') AS clique, (SELECT sum(weight * len(list_intersect(m.sub, w.attrs))) FROM w) AS score FROM m""",
)
def workload_closure(spark, sf):
    w = _cliques(spark, sf).withColumn("weight", F.size("attrs").cast("double"))
    out = M.workload_closure(w)
    return out.select(F.array_join(F.col("attrs").cast("array<string>"), ",").alias("clique"), "score")


@query(
    "maximal_cliques",
    f"""WITH {_CLIQUES}, alls AS (SELECT attrs FROM cl UNION SELECT attrs[1:2] FROM cl UNION SELECT attrs[2:] FROM cl)
    SELECT array_to_string(a.attrs, ',') AS clique FROM alls a WHERE len(a.attrs) > 0 AND NOT EXISTS (SELECT 1 FROM alls b
      WHERE len(b.attrs) > len(a.attrs) AND len(list_intersect(a.attrs, b.attrs)) = len(a.attrs))""",
)
def maximal_cliques(spark, sf):
    base = _cliques(spark, sf)
    every = base.unionByName(base.select(F.slice("attrs", 1, 2).alias("attrs"))).unionByName(
        base.select(F.expr("slice(attrs, 2, size(attrs))").alias("attrs"))
    ).where(F.size("attrs") > 0)
    return M.maximal_cliques(every).select(F.array_join(F.col("attrs").cast("array<string>"), ",").alias("clique"))


@query(
    "clique_homes",
    f"""WITH {_CLIQUES}, alls AS (SELECT attrs FROM cl UNION SELECT attrs[1:2] FROM cl),
    big AS (SELECT attrs FROM alls a WHERE NOT EXISTS (SELECT 1 FROM alls b WHERE len(b.attrs) > len(a.attrs)
      AND len(list_intersect(a.attrs, b.attrs)) = len(a.attrs)))
    SELECT array_to_string(a.attrs, ',') AS clique, array_to_string(min(b.attrs), ',') AS home FROM alls a
    JOIN big b ON len(list_intersect(a.attrs, b.attrs)) = len(a.attrs) GROUP BY a.attrs""",
)
def clique_homes(spark, sf):
    base = _cliques(spark, sf)
    homes = M.clique_homes(base.unionByName(base.select(F.slice("attrs", 1, 2).alias("attrs"))))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return homes.select(text("attrs").alias("clique"), text("home").alias("home"))


@query(
    "min_variance_total",
    f"""WITH {ORD}, m AS ({_pair_sql(ORDER_DOMAIN, 'ord', 1)}),
    y AS (SELECT clique, value + 20.0 * {gauss_sql('total', 'clique', 'cell')} AS noisy, 20.0 AS sd FROM m),
    e AS (SELECT clique, sum(noisy) AS est, count(*) * 400.0 AS v FROM y GROUP BY clique)
    SELECT round(greatest(1.0, sum(est / v) / sum(1.0 / v)), 4) AS total FROM e""",
)
def min_variance_total(spark, sf):
    m = M.all_marginals(orders(spark, sf), ORDER_DOMAIN, 1)
    y = G.gaussian_measure(m, 20.0, {a: 1.0 for a in ORDER_DOMAIN.attrs}, "total")
    return rounded(M.min_variance_total(y), "total", digits=4)


@query(
    "functional_dependency",
    """SELECT count(*) AS n_keys, CAST(sum(CAST(k > 1 AS BIGINT)) AS BIGINT) AS n_violating, bool_and(k <= 1) AS holds, 'c_custkey' AS pair
    FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1)
    UNION ALL SELECT count(*), CAST(sum(CAST(k > 1 AS BIGINT)) AS BIGINT), bool_and(k <= 1), 'n_nationkey'
    FROM (SELECT n_nationkey, count(DISTINCT n_regionkey) AS k FROM nation GROUP BY 1)""",
)
def functional_dependency(spark, sf):
    a = M.functional_dependency(table(spark, sf, "orders"), "o_custkey", "o_orderstatus").withColumn("pair", F.lit("c_custkey"))
    b = M.functional_dependency(table(spark, sf, "nation"), "n_nationkey", "n_regionkey").withColumn("pair", F.lit("n_nationkey"))
    return a.unionByName(b)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def distinct_rows(spark, sf):
    return M.distinct_rows(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_discount"])


@query(
    "prefix_marginal",
    f"""WITH {ITM}, c AS (SELECT flag, disc, count(*) AS n FROM itm GROUP BY ALL)
    SELECT flag, disc, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY flag ORDER BY disc) AS DOUBLE) AS value
    FROM (SELECT * FROM {axis_sql(flag=3, disc=11)}) g LEFT JOIN c USING (flag, disc)""",
)
def prefix_marginal(spark, sf):
    return M.prefix_marginal(items(spark, sf), ITEM_DOMAIN, ["flag", "disc"], "disc")


@query(
    "prefix_error",
    f"""WITH {HALVES}, g AS (SELECT * FROM {axis_sql(flag=3, disc=11)}),
    a AS (SELECT flag, disc, sum(coalesce(n, 0)) OVER (PARTITION BY flag ORDER BY disc) AS a FROM g LEFT JOIN (SELECT flag, disc, count(*) n FROM ta GROUP BY ALL) USING (flag, disc)),
    b AS (SELECT flag, disc, sum(coalesce(n, 0)) OVER (PARTITION BY flag ORDER BY disc) AS b FROM g LEFT JOIN (SELECT flag, disc, count(*) n FROM tb GROUP BY ALL) USING (flag, disc))
    SELECT round(sum(abs(a - b)) / CAST(sum(a) AS DOUBLE), 9) AS rel_l1 FROM a JOIN b USING (flag, disc)""",
)
def prefix_error(spark, sf):
    a, b = halves(spark, sf)
    return rounded(M.prefix_error(a, b, ITEM_DOMAIN, ["flag", "disc"], "disc"), "rel_l1", digits=9)


# ---------------------------------------------------------------- factors


def _factor(spark, sf, *attrs):
    t = items(spark, sf)
    return t.groupBy(*attrs).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("factor_sum", f"WITH {ITM} SELECT flag, qty, CAST(count(*) AS DOUBLE) AS value FROM itm GROUP BY ALL")
def factor_sum(spark, sf):
    return K.factor_sum(_factor(spark, sf, "flag", "qty", "line"), ["line"])


@query("factor_project", f"WITH {ITM} SELECT line, CAST(count(*) AS DOUBLE) AS value FROM itm GROUP BY ALL")
def factor_project(spark, sf):
    return K.factor_project(_factor(spark, sf, "flag", "qty", "line"), ["line"])


@query(
    "factor_max",
    f"WITH {ITM} SELECT flag, CAST(max(n) AS DOUBLE) AS value FROM (SELECT flag, qty, line, count(*) AS n FROM itm GROUP BY ALL) GROUP BY flag",
)
def factor_max(spark, sf):
    return K.factor_max(_factor(spark, sf, "flag", "qty", "line"), ["qty", "line"])


@query(
    "factor_logsumexp",
    f"""WITH {ITM}, f AS (SELECT flag, qty, line, count(*) / 10.0 AS v FROM itm GROUP BY ALL),
    m AS (SELECT flag, max(v) AS m FROM f GROUP BY flag)
    SELECT flag, round(max(m) + ln(sum(exp(v - m))), 6) AS value FROM f JOIN m USING (flag) GROUP BY flag""",
)
def factor_logsumexp(spark, sf):
    f = _factor(spark, sf, "flag", "qty", "line").withColumn("value", F.col("value") / 10.0)
    return rounded(K.factor_logsumexp(f, ["qty", "line"]), "value")


@query(
    "normalize",
    f"""WITH {ITM}, f AS (SELECT flag, qty, count(*) AS n FROM itm GROUP BY ALL)
    SELECT flag, qty, round(100.0 * n / CAST((SELECT sum(n) FROM f) AS DOUBLE), 9) AS value, 'linear' AS kind FROM f
    UNION ALL SELECT flag, qty, round(ln(CAST(n AS DOUBLE) / (SELECT sum(n) FROM f)) + ln(100.0), 9), 'log' FROM f""",
)
def normalize(spark, sf):
    f = _factor(spark, sf, "flag", "qty")
    a = K.normalize(f, 100.0).withColumn("kind", F.lit("linear"))
    b = K.normalize(f.withColumn("value", F.log("value")), 100.0, log=True).withColumn("kind", F.lit("log"))
    return rounded(a.unionByName(b), "value", digits=9)


def _binary_sql(op: str) -> str:
    return f"""WITH {ITM}, a AS (SELECT flag, qty, CAST(count(*) AS DOUBLE) AS v FROM itm GROUP BY ALL),
    b AS (SELECT qty, disc, CAST(count(*) AS DOUBLE) AS w FROM itm GROUP BY ALL)
    SELECT flag, qty, disc, round({op}, 6) AS value FROM a JOIN b USING (qty)"""


@query("factor_product", _binary_sql("v * w"))
def factor_product(spark, sf):
    return rounded(K.factor_product(_factor(spark, sf, "flag", "qty"), _factor(spark, sf, "qty", "disc"), ITEM_DOMAIN), "value")


@query("factor_add", _binary_sql("v + w"))
def factor_add(spark, sf):
    return K.factor_add(_factor(spark, sf, "flag", "qty"), _factor(spark, sf, "qty", "disc"), ITEM_DOMAIN)


@query("factor_subtract", _binary_sql("v - w"))
def factor_subtract(spark, sf):
    return K.factor_subtract(_factor(spark, sf, "flag", "qty"), _factor(spark, sf, "qty", "disc"), ITEM_DOMAIN)


@query("factor_divide", _binary_sql("v / w"))
def factor_divide(spark, sf):
    return rounded(K.factor_divide(_factor(spark, sf, "flag", "qty"), _factor(spark, sf, "qty", "disc"), ITEM_DOMAIN), "value")


@query(
    "factor_logaddexp",
    _binary_sql("greatest(v / 100, w / 100) + ln(1 + exp(least(v / 100, w / 100) - greatest(v / 100, w / 100)))"),
)
def factor_logaddexp(spark, sf):
    scale = lambda f: f.withColumn("value", F.col("value") / 100)
    a, b = scale(_factor(spark, sf, "flag", "qty")), scale(_factor(spark, sf, "qty", "disc"))
    return rounded(K.factor_logaddexp(a, b, ITEM_DOMAIN), "value")


@query(
    "factor_divide_guarded",
    f"""WITH {ITM}, a AS (SELECT flag, qty, CAST(count(*) AS DOUBLE) AS v FROM itm GROUP BY ALL),
    b AS (SELECT qty, disc, CAST(sum(CASE WHEN line < 3 AND qty < 3 THEN 1 ELSE 0 END) AS DOUBLE) AS w FROM itm GROUP BY ALL)
    SELECT flag, qty, disc, round(CASE WHEN w > 0 THEN v / w ELSE 0.0 END, 6) AS value FROM a JOIN b USING (qty)""",
)
def factor_divide_guarded(spark, sf):
    few = F.sum(((F.col("line") < 3) & (F.col("qty") < 3)).cast("double")).alias("value")
    b = items(spark, sf).groupBy("qty", "disc").agg(few)
    return rounded(K.factor_divide_guarded(_factor(spark, sf, "flag", "qty"), b, ITEM_DOMAIN), "value")


@query(
    "independent_pair",
    f"""WITH {ITM}, a AS (SELECT flag, status, count(*) AS x FROM itm GROUP BY ALL), b AS (SELECT disc, count(*) AS y FROM itm GROUP BY ALL)
    SELECT flag, status, disc, round(x * y / CAST((SELECT count(*) FROM itm) AS DOUBLE), 6) AS value FROM a, b""",
)
def independent_pair(spark, sf):
    return rounded(K.independent_pair(items(spark, sf), ITEM_DOMAIN, ["flag", "status"], ["disc"]), "value")


# ---------------------------------------------------------------- grids and trees


@query(
    "domain_grid",
    """SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_discount FROM lineitem),
    (SELECT DISTINCT l_linenumber FROM lineitem)""",
)
def domain_grid(spark, sf):
    return M.observed_grid(table(spark, sf, "lineitem"), ["l_returnflag", "l_discount", "l_linenumber"])


# two code values of the year have no orders
_WIDE = Domain.of({"status": 3, "prio": 5, "yr": 9})


@query("observed_cells", f"WITH {ORD} SELECT DISTINCT status, prio, yr FROM ord")
def observed_cells(spark, sf):
    grid = M.domain_grid(spark, _WIDE, _WIDE.attrs)
    return M.observed_cells(grid.drop("cell"), orders(spark, sf), _WIDE.attrs)


@query(
    "initial_distribution",
    f"""WITH {ORD}, c AS (SELECT status, prio, yr, count(*) AS n FROM ord GROUP BY ALL)
    SELECT status, prio, yr, round(coalesce(n, 0) / CAST((SELECT count(*) FROM ord) AS DOUBLE), 9) AS p
    FROM (SELECT * FROM {axis_sql(status=3, prio=5, yr=9)}) g LEFT JOIN c USING (status, prio, yr)""",
)
def initial_distribution(spark, sf):
    grid = M.domain_grid(spark, _WIDE, _WIDE.attrs)
    return rounded(M.initial_distribution(grid, orders(spark, sf), _WIDE.attrs), "p", digits=9)


def _edges(spark, sf):
    return [
        (_factor(spark, sf, "flag", "qty"), ("flag", "qty")),
        (_factor(spark, sf, "qty", "disc"), ("qty", "disc")),
        (_factor(spark, sf, "disc", "line"), ("disc", "line")),
    ]


_TREE = f"""{ITM}, ab AS (SELECT flag, qty, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL),
  bc AS (SELECT qty, disc, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL), b AS (SELECT qty, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL),
  cd AS (SELECT disc, line, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL), c AS (SELECT disc, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL),
  j AS (SELECT flag, qty, disc, line, ab.v * bc.v / b.v * cd.v / c.v AS v FROM ab JOIN bc USING (qty) JOIN b USING (qty) JOIN cd USING (disc) JOIN c USING (disc))"""


@query("query_unmeasured_marginal", f"WITH {_TREE} SELECT flag, line, round(sum(v), 6) AS value FROM j GROUP BY ALL")
def query_unmeasured_marginal(spark, sf):
    return rounded(K.query_unmeasured_marginal(_edges(spark, sf), ["flag", "line"], ITEM_DOMAIN), "value")


@query("full_joint", f"WITH {_TREE} SELECT flag, qty, disc, line, round(v, 6) AS value FROM j")
def full_joint(spark, sf):
    sub = ITEM_DOMAIN.project(["flag", "qty", "disc", "line"])
    return rounded(K.full_joint(_edges(spark, sf), sub), "value")


@query(
    "kron_query",
    f"""WITH {ITM}, j AS (SELECT flag, qty, disc, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL),
    q1 AS (SELECT DISTINCT qty AS qty, CAST(g.k AS INTEGER) AS answer_qty, 1.0 AS coef FROM itm, range(5) g(k) WHERE qty <= g.k),
    q2 AS (SELECT DISTINCT disc, disc % 2 AS answer_disc, CAST(disc AS DOUBLE) AS coef FROM itm)
    SELECT flag, answer_qty, answer_disc, sum(v * q1.coef * q2.coef) AS value FROM j JOIN q1 USING (qty) JOIN q2 USING (disc) GROUP BY ALL""",
)
def kron_query(spark, sf):
    """Prefix sums along quantity, weighted parity classes along discount, identity along flag."""
    joint = _factor(spark, sf, "flag", "qty", "disc")
    t = items(spark, sf)
    prefix = t.select("qty").distinct().select(
        "qty", F.explode(F.sequence(F.col("qty"), F.lit(4))).alias("answer_qty"), F.lit(1.0).alias("coef")
    )
    parity = t.select("disc").distinct().select("disc", (F.col("disc") % 2).alias("answer_disc"), F.col("disc").cast("double").alias("coef"))
    return K.kron_query(joint, {"qty": prefix, "disc": parity})


@query(
    "hierarchy_aggregate",
    f"""WITH {ITM}, c AS (SELECT flag, status, qty, CAST(count(*) AS DOUBLE) v FROM itm GROUP BY ALL)
    SELECT 'flag,status' AS child, concat_ws('_', flag, status) AS key, round(sum(v) / sqrt(CAST(2 AS DOUBLE)), 6) AS value FROM c GROUP BY ALL
    UNION ALL SELECT 'qty', CAST(qty AS VARCHAR), round(sum(v) / sqrt(CAST(2 AS DOUBLE)), 6) FROM c GROUP BY ALL""",
)
def hierarchy_aggregate(spark, sf):
    cells = _factor(spark, sf, *TRIPLE)
    return rounded(K.hierarchy_aggregate(cells, {"flag,status": ["flag", "status"], "qty": ["qty"]}), "value")


_PLAN = """cells AS (SELECT flag, qty, count(*) / CAST((SELECT count(*) FROM itm) AS DOUBLE) AS share FROM itm GROUP BY flag, qty),
  plan AS (SELECT flag, qty, (flag + 1) % 3 AS t_flag, qty AS t_qty, share * 0.25 AS mass FROM cells
  UNION ALL SELECT flag, qty, flag, qty, share * 0.75 FROM cells)"""


def shift_plan(spark, sf):
    """A transport plan that keeps three quarters of each cell and moves the rest to the next flag."""
    c = items(spark, sf).groupBy("flag", "qty").agg(F.count(F.lit(1)).alias("n"))
    total = c.select(F.sum("n")).scalar()
    move = c.select("flag", "qty", ((F.col("flag") + 1) % 3).alias("t_flag"), F.col("qty").alias("t_qty"), (F.col("n") * 0.25 / total).alias("mass"))
    stay = c.select("flag", "qty", F.col("flag").alias("t_flag"), F.col("qty").alias("t_qty"), (F.col("n") * 0.75 / total).alias("mass"))
    return move.unionByName(stay)


@query(
    "extra_feature_join",
    f"""WITH {ITM}, {_PLAN}, s AS (SELECT flag, qty, disc, count(*) / CAST(sum(count(*)) OVER (PARTITION BY flag, qty) AS DOUBLE) AS p FROM itm GROUP BY flag, qty, disc)
    SELECT t_flag, t_qty, disc, round(sum(mass * p), 9) AS mass FROM plan JOIN s USING (flag, qty) GROUP BY ALL""",
)
def extra_feature_join(spark, sf):
    out = K.extra_feature_join(items(spark, sf), ["flag", "qty"], "disc", shift_plan(spark, sf))
    return rounded(out, "mass", digits=9)


@query(
    "union_distinct",
    "SELECT o_orderstatus AS v FROM orders UNION SELECT l_linestatus FROM lineitem UNION SELECT l_returnflag FROM lineitem",
)
def union_distinct(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("v"))
    t = table(spark, sf, "lineitem")
    return a.union(t.select("l_linestatus")).union(t.select("l_returnflag")).distinct()


@query(
    "intersect_attrs",
    "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def intersect_attrs(spark, sf):
    o = table(spark, sf, "orders")
    k = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return k("F").intersect(k("P"))


