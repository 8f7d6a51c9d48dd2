"""Conditional-independence measures and tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import (
    DOC, DOC_RULE, ITM, ITEM_RULE, ORD, ORDER_RULE, docs, items, orders, query, r, rounded, table,
)
from margrid.domain import Constraint
from margrid.operators import ci as C
from margrid.operators import learn as L


def cells_sql(cte: str, x: str, y: str, z: str) -> str:
    """CTE ``m``: cells with all margins, as doubles."""
    return f"""c AS (SELECT {x} AS x, {y} AS y, {z} AS z, CAST(count(*) AS DOUBLE) AS n FROM {cte} GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER (PARTITION BY z) AS nz,
      sum(n) OVER () AS t FROM c)"""


_DOC = f"{DOC}, {cells_sql('doc', 'lang', 'quality', 'source')}"
_ITM = f"{ITM}, {cells_sql('itm', 'flag', 'status', 'qty')}"
_ORD = f"{ORD}, {cells_sql('ord', 'status', 'prio', 'yr')}"
_GRID = """, g AS (SELECT a.x, b.y, a.z, coalesce(m.n, 0.0) AS n, a.nxz, b.nyz, a.nz, a.t
  FROM (SELECT DISTINCT x, z, nxz, nz, t FROM m) a JOIN (SELECT DISTINCT y, z, nyz FROM m) b USING (z)
  LEFT JOIN m ON m.x = a.x AND m.y = b.y AND m.z = a.z)"""


@query("cmi_plain", f"WITH {_DOC} SELECT round(sum(n / t * log2(n * nz / (nxz * nyz))), 9) AS cmi FROM m")
def cmi_plain(spark, sf):
    return rounded(C.cmi_plain(docs(spark, sf), DOC_RULE), "cmi", digits=9)


@query(
    "cmi_by_segment",
    f"""WITH {ITM}, c AS (SELECT line AS seg, flag AS x, status AS y, qty AS z, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY seg, x, z) AS nxz, sum(n) OVER (PARTITION BY seg, y, z) AS nyz, sum(n) OVER (PARTITION BY seg, z) AS nz,
      sum(n) OVER (PARTITION BY seg) AS t FROM c)
    SELECT seg AS line, round(greatest(sum(n / t * log2(n / t * nz / t / (nxz / t * nyz / t + 1e-12) + 1e-12)), 0), 9) AS cmi FROM m GROUP BY seg""",
)
def cmi_by_segment(spark, sf):
    """The measure for every line number in one job: keys ride along instead of a loop."""
    return rounded(C.cmi(items(spark, sf), ITEM_RULE, by=["line"]), "cmi", digits=9)


_SMOOTHED = "n / t * {log}(n / t * (nz / t) / ((nxz / t) * (nyz / t) + 1e-12) + 1e-12)"


@query("cmi", f"WITH {_DOC} SELECT round(greatest(sum({_SMOOTHED.format(log='log2')}), 0.0), 9) AS cmi FROM m")
def cmi(spark, sf):
    return rounded(C.cmi(docs(spark, sf), DOC_RULE), "cmi", digits=9)


@query("cmi_items", f"WITH {_ITM} SELECT round(greatest(sum({_SMOOTHED.format(log='log2')}), 0.0), 9) AS cmi FROM m")
def cmi_items(spark, sf):
    return rounded(C.cmi(items(spark, sf), ITEM_RULE), "cmi", digits=9)


@query("cmi_natural", f"WITH {_ORD} SELECT round(greatest(sum({_SMOOTHED.format(log='ln')}), 0.0), 9) AS cmi FROM m")
def cmi_natural(spark, sf):
    return rounded(C.cmi_natural(orders(spark, sf), ORDER_RULE), "cmi", digits=9)


@query(
    "cmi_entropy",
    f"""WITH {_DOC}, h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM m) AS h_xyz,
      (SELECT -sum(n / t * log2(n / t)) FROM (SELECT DISTINCT x, z, nxz AS n, t FROM m)) AS h_xz,
      (SELECT -sum(n / t * log2(n / t)) FROM (SELECT DISTINCT y, z, nyz AS n, t FROM m)) AS h_yz,
      (SELECT -sum(n / t * log2(n / t)) FROM (SELECT DISTINCT z, nz AS n, t FROM m)) AS h_z)
    SELECT round(h_xyz, 8) AS h_xyz, round(h_xz, 8) AS h_xz, round(h_yz, 8) AS h_yz, round(h_z, 8) AS h_z,
      round(greatest(h_xz + h_yz - h_xyz - h_z, 0), 8) AS cmi FROM h""",
)
def cmi_entropy(spark, sf):
    return rounded(C.cmi_entropy(docs(spark, sf), DOC_RULE), "h_xyz", "h_xz", "h_yz", "h_z", "cmi", digits=8)


@query(
    "mutual_information",
    f"""WITH {DOC}, c AS (SELECT lang AS x, quality AS y, CAST(count(*) AS DOUBLE) AS n FROM doc GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
    SELECT round(sum(n / t * log2((n / t + 1e-12) / ((nx / t) * (ny / t) + 1e-12))), 9) AS mi FROM m""",
)
def mutual_information(spark, sf):
    return rounded(C.mutual_information(docs(spark, sf), ["lang"], ["quality"]), "mi", digits=9)


@query(
    "cmi_chain_rule",
    f"""WITH {_DOC}, mx AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y, z) AS nyzz FROM m),
    a AS (SELECT sum(n / t * ln(n * t / (nx * nyzz))) AS v FROM mx),
    xz AS (SELECT DISTINCT x, z, nxz, nz, t, nx FROM mx), b AS (SELECT sum(nxz / t * ln(nxz * t / (nx * nz))) AS v FROM xz)
    SELECT round(a.v, 9) AS mi_x_yz, round(b.v, 9) AS mi_x_z, round(a.v - b.v, 9) AS cmi FROM a, b""",
)
def cmi_chain_rule(spark, sf):
    return rounded(C.cmi_chain_rule(docs(spark, sf), DOC_RULE), "mi_x_yz", "mi_x_z", "cmi", digits=9)


@query(
    "prob_join",
    f"""WITH {_ITM} SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, CAST(z AS VARCHAR) AS z, round(n / t, 9) AS p_xyz, round(nxz / t, 9) AS p_xz,
    round(nyz / t, 9) AS p_yz, round(nz / t, 9) AS p_z FROM m""",
)
def prob_join(spark, sf):
    return rounded(C.prob_join(items(spark, sf), ITEM_RULE), "p_xyz", "p_xz", "p_yz", "p_z", digits=9)


@query(
    "ci_tvd",
    f"""WITH {_DOC}{_GRID}, d AS (SELECT n / t AS p, nxz / t * (nyz / t) / (nz / t) AS q FROM g)
    SELECT round(0.5 * sum(abs(p - q)), 9) AS l1, round(sum(abs(p - q)), 9) AS l1_full, round(sqrt(sum((p - q) * (p - q)) + 1e-12), 8) AS l2 FROM d""",
)
def ci_tvd(spark, sf):
    d = docs(spark, sf)
    one = C.ci_tvd(d, DOC_RULE)
    full = C.ci_tvd(d, DOC_RULE, half=False).select("tvd").scalar()
    two = C.ci_tvd(d, DOC_RULE, norm="L2").select("tvd").scalar()
    return one.select(r("tvd", 9).alias("l1"), r(full, 9).alias("l1_full"), r(two, 8).alias("l2"))


@query(
    "ci_hellinger",
    f"""WITH {_DOC}{_GRID}, d AS (SELECT greatest(n / t, 1e-10) AS p, greatest(nxz / t, 1e-10) * greatest(nyz / nz, 1e-10) AS q FROM g)
    SELECT round(sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) + 1e-12) / sqrt(CAST(2 AS DOUBLE)), 8) AS hellinger FROM d""",
)
def ci_hellinger(spark, sf):
    return rounded(C.ci_hellinger(docs(spark, sf), DOC_RULE), "hellinger", digits=8)


@query("ci_l1_counts", f"WITH {_DOC}{_GRID} SELECT round(sum(abs(n - nxz * nyz / nz)), 6) AS l1 FROM g")
def ci_l1_counts(spark, sf):
    return rounded(C.ci_l1_counts(docs(spark, sf), DOC_RULE), "l1")


def _test_sql(ctes: str, term: str, name: str) -> str:
    """Sum of a cell term over the grid of each usable stratum, with the 2x2 correction."""
    return f"""WITH {ctes}{_GRID}, s AS (SELECT z, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM g GROUP BY z),
    e AS (SELECT g.*, r, k, nxz * nyz / nz AS e FROM g JOIN s USING (z) WHERE r > 1 AND k > 1),
    o AS (SELECT *, CASE WHEN r = 2 AND k = 2 THEN n + sign(e - n) * least(0.5, abs(e - n)) ELSE n END AS o FROM e)
    SELECT round(sum({term}), 6) AS {name}, CAST((SELECT sum((r - 1) * (k - 1)) FROM s WHERE r > 1 AND k > 1) AS BIGINT) AS dof,
      (SELECT count(*) FROM s WHERE r > 1 AND k > 1) AS strata FROM o"""


@query("chi2_stratified", _test_sql(_DOC, "(o - e) * (o - e) / e", "chi2"))
def chi2_stratified(spark, sf):
    return rounded(C.chi2_stratified(docs(spark, sf), DOC_RULE), "chi2")


_BINARY = f"{DOC}, {cells_sql('doc', 'toxic', 'quality', 'concat_ws(chr(95), source, lang)')}"


@query("chi2_binary", _test_sql(_BINARY, "(o - e) * (o - e) / e", "chi2"))
def chi2_binary(spark, sf):
    """Two-by-two strata, where the continuity correction applies."""
    return rounded(C.chi2_stratified(docs(spark, sf), Constraint.of("toxic", "quality", ["source", "lang"])), "chi2")


@query("g_stratified", _test_sql(_DOC, "CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END", "g"))
def g_stratified(spark, sf):
    return rounded(C.g_stratified(docs(spark, sf), DOC_RULE), "g")


@query("g_binary", _test_sql(_BINARY, "CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END", "g"))
def g_binary(spark, sf):
    return rounded(C.g_stratified(docs(spark, sf), Constraint.of("toxic", "quality", ["source", "lang"])), "g")


_COMPOSITE = f"{ORD}, {cells_sql('ord', 'concat_ws(chr(95), status, price)', 'prio', 'yr')}"
_COMPOSITE_RULE = Constraint.of(["status", "price"], "prio", "yr")


@query("chi2_composite", _test_sql(_COMPOSITE, "(o - e) * (o - e) / e", "chi2"))
def chi2_composite(spark, sf):
    return rounded(C.chi2_stratified(orders(spark, sf), _COMPOSITE_RULE), "chi2")


@query("modified_loglik_test", _test_sql(_COMPOSITE, "CASE WHEN o > 0 AND e > 0 THEN 2 * e * ln(e / o) ELSE 0 END", "stat"))
def modified_loglik_test(spark, sf):
    return rounded(C.modified_loglik_test(orders(spark, sf), _COMPOSITE_RULE), "stat")


@query("ci_test_p_values")
def ci_test_p_values(spark, sf):
    """p-values of the stratified tests on the labelled documents."""
    d = docs(spark, sf)
    chi = C.with_p_value(C.chi2_stratified(d, DOC_RULE), "chi2").select(F.lit("chi2").alias("test"), "dof", r("p_value", 9).alias("p_value"))
    g = C.with_p_value(C.g_stratified(d, DOC_RULE), "g").select(F.lit("g").alias("test"), "dof", r("p_value", 9).alias("p_value"))
    m = C.with_p_value(C.modified_loglik_test(d, DOC_RULE), "stat").select(F.lit("mod").alias("test"), "dof", r("p_value", 9).alias("p_value"))
    return chi.unionByName(g).unionByName(m)


@query("permutation_test")
def permutation_test(spark, sf):
    return C.permutation_test(docs(spark, sf), DOC_RULE, 100, "perm")


def _rank(col: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / CAST(2 AS DOUBLE))"


@query(
    "partial_spearman",
    f"""WITH {ORD}, k AS (SELECT {_rank('price')} AS x, {_rank('prio')} AS y, {_rank('yr')} AS z FROM ord),
    c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, CAST(count(*) AS DOUBLE) AS n FROM k)
    SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS r, n - 3 AS dof FROM c""",
)
def partial_spearman(spark, sf):
    out = C.partial_spearman(orders(spark, sf), Constraint.of("price", "prio", "yr"))
    return rounded(out.select("r", "dof"), "r", digits=8)


@query("partial_spearman_p_value")
def partial_spearman_p_value(spark, sf):
    return C.partial_spearman(orders(spark, sf), Constraint.of("price", "prio", ["yr", "status"]))


@query(
    "average_ranks",
    "SELECT value, avg(rn) AS rank FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM events) GROUP BY value",
)
def average_ranks(spark, sf):
    return C.average_ranks(table(spark, sf, "events"), "value")


@query(
    "pillai_residual_test",
    f"""WITH {ITM}, p AS (SELECT qty, avg(CAST(flag = 0 AS DOUBLE)) AS p0, avg(CAST(flag = 1 AS DOUBLE)) AS p1, avg(CAST(status = 0 AS DOUBLE)) AS q0 FROM itm GROUP BY qty),
    e AS (SELECT CAST(flag = 0 AS DOUBLE) - p0 AS a, CAST(flag = 1 AS DOUBLE) - p1 AS b, CAST(status = 0 AS DOUBLE) - q0 AS c FROM itm JOIN p USING (qty)),
    m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, CAST(count(*) AS DOUBLE) AS n FROM e),
    t AS (SELECT (ac * ac * bb - 2 * ac * bc * ab + bc * bc * aa) / ((aa * bb - ab * ab) * cc) AS trace, n - 3 AS df2 FROM m)
    SELECT round(trace, 11) AS trace, round((trace / 2) * (df2 / (1 - trace)), 6) AS f, CAST(2 AS DOUBLE) AS df1, df2 FROM t""",
)
def pillai_residual_test(spark, sf):
    out = C.pillai_residual_test(items(spark, sf), ITEM_RULE, ["0", "1", "2"], ["0", "1"])
    return rounded(rounded(out.select("trace", "f", "df1", "df2"), "trace", digits=11), "f")


@query("pillai_p_value")
def pillai_p_value(spark, sf):
    return C.pillai_residual_test(items(spark, sf), ITEM_RULE, ["0", "1", "2"], ["0", "1"])


@query("pillai_logistic")
def pillai_logistic(spark, sf):
    return L.pillai_logistic(items(spark, sf), ITEM_RULE)


@query("loglinear_test")
def loglinear_test(spark, sf):
    return C.loglinear_test(items(spark, sf), ITEM_RULE, rounds=10)


def _rank_sql() -> str:
    parts = []
    for s in [c for k in (1, 2) for c in combinations(("yr", "price"), k)]:
        z = f"concat_ws('_', {', '.join(s)})"
        parts.append(
            f"SELECT 'status' AS attr, '{','.join(s)}' AS given, (SELECT round(sum(n / t * log2(n * nz / (nxz * nyz))), 9) FROM "
            f"(SELECT n, t, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER (PARTITION BY z) AS nz FROM "
            f"(SELECT status AS x, prio AS y, {z} AS z, CAST(count(*) AS DOUBLE) AS n, CAST((SELECT count(*) FROM ord) AS DOUBLE) AS t FROM ord GROUP BY status, prio, {z}))) AS cmi"
        )
    return f"WITH {ORD} " + " UNION ALL ".join(parts)


@query("rank_ci_sets", _rank_sql())
def rank_ci_sets(spark, sf):
    pool = [c for k in (1, 2) for c in combinations(("yr", "price"), k)]
    return rounded(C.rank_ci_sets(orders(spark, sf), "status", "prio", pool), "cmi", digits=9)


@query(
    "rank_mutual_information",
    f"WITH {ITM} " + " UNION ALL ".join(
        f"SELECT '{a}' AS attr, (SELECT round(sum(n / t * ln(n * t / (nx * ny))), 9) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, "
        f"sum(n) OVER (PARTITION BY y) AS ny FROM (SELECT {a} AS x, status AS y, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL))) AS mi"
        for a in ("flag", "line", "disc", "qty")
    ),
)
def rank_mutual_information(spark, sf):
    return rounded(C.rank_mutual_information(items(spark, sf), ["flag", "line", "disc", "qty"], "status"), "mi", digits=9)
