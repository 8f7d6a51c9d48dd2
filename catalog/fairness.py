"""Fairness and prediction metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import DOC, ITM, ORD, ORDER_DOMAIN, docs, items, orders, query, rounded, table, u_sql
from margrid.domain import Domain
from margrid.operators import fairness as A
from margrid.operators import learn as L

_BASE = f"{ITM}, b AS (SELECT status AS att, CAST(flag = 2 AS INTEGER) AS y, qty AS adm, line AS n1, CAST(disc > 5 AS INTEGER) AS n2 FROM itm)"


def _roles(spark, sf):
    return items(spark, sf).select(
        F.col("status").alias("att"), (F.col("flag") == 2).cast("int").alias("y"), F.col("qty").alias("adm"),
        F.col("line").alias("n1"), (F.col("disc") > 5).cast("int").alias("n2"),
    )


def _ratio_sql() -> str:
    parts = []
    for s in [c for k in range(3) for c in combinations(("n1", "n2"), k)]:
        keys = ", ".join(("adm", *s))
        parts.append(
            f"SELECT '{','.join(s)}' AS subset, sum(ratio * n) / sum(n) AS ratio FROM (SELECT CASE WHEN min(m) = max(m) THEN 1.0 ELSE min(m) / max(m) END AS ratio, "
            f"sum(n) AS n FROM (SELECT {keys}, att, avg(y) AS m, count(*) AS n FROM b GROUP BY {keys}, att) GROUP BY {keys} HAVING count(*) = 2)"
        )
    return " UNION ALL ".join(parts)


@query("rod_by_subset", f"WITH {_BASE} SELECT subset, round(ratio, 8) AS ratio FROM ({_ratio_sql()})")
def rod_by_subset(spark, sf):
    return rounded(A.rod_by_subset(_roles(spark, sf), "att", "y", ["adm"], ["n1", "n2"]), "ratio", digits=8)


@query("rod", f"WITH {_BASE} SELECT round(least(min(ratio), 1.1), 8) AS rod FROM ({_ratio_sql()})")
def rod(spark, sf):
    return rounded(A.rod(_roles(spark, sf), "att", "y", ["adm"], ["n1", "n2"]), "rod", digits=8)


def _strata_sql(keys: str) -> str:
    return f"""w AS (SELECT {keys}, CAST(sum(CAST(att = 0 AND y = 0 AS INTEGER)) AS DOUBLE) a, CAST(sum(CAST(att = 0 AND y = 1 AS INTEGER)) AS DOUBLE) b,
      CAST(sum(CAST(att = 1 AND y = 0 AS INTEGER)) AS DOUBLE) c, CAST(sum(CAST(att = 1 AND y = 1 AS INTEGER)) AS DOUBLE) d FROM b GROUP BY {keys}),
    v AS (SELECT * FROM w WHERE a + b > 5 AND c + d > 5),
    t AS (SELECT {keys}, CASE WHEN a + c > 0 AND b + d > 0 THEN a + 1 ELSE (a + b + c + d) / 4 END AS a, CASE WHEN a + c > 0 AND b + d > 0 THEN b + 1 ELSE (a + b + c + d) / 4 END AS b,
      CASE WHEN a + c > 0 AND b + d > 0 THEN c + 1 ELSE (a + b + c + d) / 4 END AS c, CASE WHEN a + c > 0 AND b + d > 0 THEN d + 1 ELSE (a + b + c + d) / 4 END AS d FROM v),
    x AS (SELECT *, a + b + c + d AS n FROM t)"""


@query(
    "mantel_haenszel_or",
    f"""WITH {_BASE}, {_strata_sql('adm, n1, n2')}
    SELECT count(*) AS strata, round(sum(a * d / n) / sum(b * c / n), 8) AS odds_ratio,
      round(pow(sum(a - (a + b) * (a + c) / n), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS stat FROM x""",
)
def mantel_haenszel_or(spark, sf):
    out = A.mantel_haenszel_or(_roles(spark, sf), "att", "y", ["adm", "n1", "n2"])
    return rounded(rounded(out, "odds_ratio", digits=8), "stat")


@query("mantel_haenszel_p_value")
def mantel_haenszel_p_value(spark, sf):
    return A.with_or_p_value(A.mantel_haenszel_or(_roles(spark, sf), "att", "y", ["adm", "n1"]))


@query(
    "stratum_odds",
    f"WITH {_BASE}, {_strata_sql('adm, n1, n2')} SELECT adm, n1, n2, round(a * d / (b * c), 8) AS odds_ratio FROM x WHERE a * d / (b * c) >= 1.1",
)
def stratum_odds(spark, sf):
    return rounded(A.stratum_odds(_roles(spark, sf), "att", "y", ["adm", "n1", "n2"], 1.1), "odds_ratio", digits=8)


@query("binarize", f"WITH {ORD} SELECT status, count(*) AS n FROM ord WHERE status < 2 GROUP BY ALL")
def binarize(spark, sf):
    return A.binarize(orders(spark, sf), "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "confusion_metrics",
    f"""WITH {DOC}, m AS (SELECT lang, CAST(sum(CAST(quality = 1 AND toxic = 1 AS INTEGER)) AS BIGINT) tp, CAST(sum(CAST(quality = 0 AND toxic = 0 AS INTEGER)) AS BIGINT) tn,
      CAST(sum(CAST(quality = 0 AND toxic = 1 AS INTEGER)) AS BIGINT) fp, CAST(sum(CAST(quality = 1 AND toxic = 0 AS INTEGER)) AS BIGINT) fn FROM doc GROUP BY lang),
    f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0 FROM m)
    SELECT lang, tp, tn, fp, fn, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 8) AS accuracy, round(CAST(f1 AS DOUBLE), 8) AS f1, round((CAST(f1 AS DOUBLE) + f0) / 2, 8) AS macro_f1,
      round((CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END + CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0 END) / 2, 8) AS macro_precision,
      round((CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END) / 2, 8) AS macro_recall,
      round((CAST(f1 AS DOUBLE) * (tp + fn) + f0 * (tn + fp)) / (tp + tn + fp + fn), 8) AS weighted_f1 FROM f""",
)
def confusion_metrics(spark, sf):
    out = A.confusion_metrics(docs(spark, sf), "quality", "toxic", ["lang"])
    return rounded(out, "accuracy", "f1", "macro_f1", "macro_precision", "macro_recall", "weighted_f1", digits=8)


@query("demographic_parity", f"WITH {DOC} SELECT round(max(v) - min(v), 8) AS gap FROM (SELECT avg(toxic) AS v FROM doc GROUP BY lang)")
def demographic_parity(spark, sf):
    return rounded(A.demographic_parity(docs(spark, sf), "toxic", "lang"), "gap", digits=8)


@query(
    "equalized_odds",
    f"WITH {DOC} SELECT round(max(gap), 8) AS gap FROM (SELECT max(v) - min(v) AS gap FROM (SELECT quality, avg(toxic) AS v FROM doc GROUP BY lang, quality) GROUP BY quality)",
)
def equalized_odds(spark, sf):
    return rounded(A.equalized_odds(docs(spark, sf), "quality", "toxic", "lang"), "gap", digits=8)


def _auc_sql(cte: str, score: str, hit: str) -> str:
    return (
        f"(SELECT (sum(CASE WHEN {hit} THEN rk ELSE 0 END) - p * (p + 1) / 2.0) / (p * q) FROM (SELECT *, rank() OVER (ORDER BY {score}) "
        f"+ (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk, CAST(sum(CAST({hit} AS INTEGER)) OVER () AS DOUBLE) AS p, "
        f"CAST(sum(CAST(NOT ({hit}) AS INTEGER)) OVER () AS DOUBLE) AS q FROM {cte}) GROUP BY p, q)"
    )


@query("auc_binary", f"WITH {DOC} SELECT round({_auc_sql('doc', 'n_chars', 'quality = 1')}, 8) AS auc")
def auc_binary(spark, sf):
    return rounded(A.auc_binary(docs(spark, sf), "quality", "n_chars"), "auc", digits=8)


@query("auc_hard", f"WITH {DOC} SELECT round({_auc_sql('doc', 'toxic', 'quality = 1')}, 8) AS auc")
def auc_hard(spark, sf):
    return rounded(A.auc_binary(docs(spark, sf), "quality", "toxic"), "auc", digits=8)


@query(
    "auc_weighted_ovr",
    f"""WITH {ORD} SELECT round((sum(n * auc)) / sum(n), 8) AS auc FROM (
      SELECT (SELECT count(*) FROM ord WHERE status = 0) AS n, {_auc_sql('ord', 'total', 'status = 0')} AS auc
      UNION ALL SELECT (SELECT count(*) FROM ord WHERE status = 1), {_auc_sql('ord', '-total', 'status = 1')}
      UNION ALL SELECT (SELECT count(*) FROM ord WHERE status = 2), {_auc_sql('ord', 'price', 'status = 2')})""",
)
def auc_weighted_ovr(spark, sf):
    o = orders(spark, sf).withColumn("minus", -F.col("total"))
    return rounded(A.auc_weighted_ovr(o, "status", {0: "total", 1: "minus", 2: "price"}), "auc", digits=8)


_ROC = """s AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, least(value / 200, 1.0) AS score FROM events),
  c AS (SELECT greatest(least(CAST(floor(score * 999 + 1e-9) AS INTEGER), 999), -1) AS slot, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM s GROUP BY 1),
  f AS (SELECT sum(neg) OVER (ORDER BY slot DESC) / (SELECT sum(neg) FROM c) AS fpr, sum(pos) OVER (ORDER BY slot DESC) / (SELECT sum(pos) FROM c) AS tpr FROM c),
  p AS (SELECT DISTINCT * FROM (SELECT fpr, tpr FROM f UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0))"""


def _scores(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("y"), F.least(F.col("value") / 200, F.lit(1.0)).alias("score")
    )


@query("roc_curve", f"WITH {_ROC} SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM p")
def roc_curve(spark, sf):
    return rounded(A.roc_points(_scores(spark, sf), "y", "score"), "fpr", "tpr", digits=9)


@query(
    "roc_auc",
    f"WITH {_ROC} SELECT round(sum(dx * h), 8) AS auc FROM (SELECT fpr - lag(fpr) OVER (ORDER BY fpr, tpr) AS dx, (tpr + lag(tpr) OVER (ORDER BY fpr, tpr)) / 2 AS h FROM p)",
)
def roc_auc(spark, sf):
    return rounded(A.roc_auc(A.roc_points(_scores(spark, sf), "y", "score")), "auc", digits=8)


@query("prediction_consistency")
def prediction_consistency(spark, sf):
    """Share of orders whose predicted class survives flipping the finished flag."""
    o = orders(spark, sf).withColumn("done", (F.col("status") == 0).cast("int")).withColumn("y", (F.col("price") > 2).cast("int"))
    model = L.fit_classifier(o, ["done", "prio", "yr"], "y", "RF")
    plain, flipped = L.predict(model, o), L.predict(model, o.withColumn("done", 1 - F.col("done")))
    return A.prediction_consistency(plain, flipped, "id")


_PEOPLE = """ppl AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS INTEGER) AS marital, CAST(c_nationkey % 9 AS INTEGER) AS education,
    CAST(c_nationkey % 7 AS INTEGER) AS occupation, CAST(floor((c_acctbal + 1000) / 110) AS INTEGER) AS hours, CAST(floor((c_acctbal + 1000) / 150) + 17 AS INTEGER) AS age,
    CAST(c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS INTEGER) AS grp, CAST(c_acctbal > 4500 AS INTEGER) AS label FROM customer)"""


def _people(spark, sf):
    bal = F.col("c_acctbal") + 1000
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).cast("int").alias("marital"), (F.col("c_nationkey") % 9).alias("education"),
        (F.col("c_nationkey") % 7).alias("occupation"), F.floor(bal / 110).cast("int").alias("hours"), (F.floor(bal / 150) + 17).cast("int").alias("age"),
        F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("grp"), (F.col("c_acctbal") > 4500).cast("int").alias("label"),
    )


_DRAWS = f"""{_PEOPLE}, num AS (SELECT *, row_number() OVER (ORDER BY {u_sql('pf/row', 'id')}, id) AS rn FROM ppl), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ppl),
    d0 AS (SELECT CAST(floor({u_sql('pf/i', 'id')} * n) AS BIGINT) + 1 AS i, CAST(floor({u_sql('pf/j', 'id')} * (n - 1)) AS BIGINT) + 1 AS j0 FROM range(20000) r(id), c),
    d1 AS (SELECT i, CASE WHEN j0 >= i THEN j0 + 1 ELSE j0 END AS j FROM d0), d AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM d1),
    p AS (SELECT a.id AS key_a, b.id AS key_b, a.label <> b.label AND a.grp <> b.grp AS apart, abs(a.hours - b.hours) AS h, abs(a.age - b.age) AS g,
      CASE WHEN a.marital <> b.marital THEN 0.04 ELSE 0.0 END AS dm, abs(a.education - b.education) / CAST(8 AS DOUBLE) * 0.15 AS de, abs(a.occupation - b.occupation) / CAST(6 AS DOUBLE) * 0.2 AS dc
      FROM d JOIN num a ON d.i = a.rn JOIN num b ON d.j = b.rn),
    q AS (SELECT *, least(CASE WHEN h > 40 THEN (h - 40) * 3 + 20 * 2 + 20 WHEN h > 20 THEN (h - 20) * 2 + 20 ELSE h END, 98) / CAST(98 AS DOUBLE) * 0.1 AS dh,
      CASE WHEN g > 10 THEN 1.0 ELSE g / CAST(73 AS DOUBLE) END * 0.15 AS da FROM p)"""


@query(
    "pairwise_fairness",
    f"""WITH {_DRAWS}
    SELECT key_a, key_b, round(sqrt(dm * dm + de * de + dc * dc + dh * dh + da * da), 8) AS distance,
      apart AND sqrt(dm * dm + de * de + dc * dc + dh * dh + da * da) < 0.12 AS violation FROM q""",
)
def pairwise_fairness(spark, sf):
    return rounded(A.pairwise_fairness(_people(spark, sf), "id", "grp", "label", 20000, 0.12, "pf"), "distance", digits=8)


@query(
    "fairness_summary",
    f"""WITH {_DRAWS}, d9 AS (SELECT sqrt(dm * dm + de * de + dc * dc + dh * dh + da * da) AS x, apart FROM q)
    SELECT round(avg(CAST(apart AND x < 0.12 AS DOUBLE)), 8) AS rate, round(sum(CASE WHEN apart AND x < 0.12 THEN 0.12 - x ELSE 0 END), 6) AS severity FROM d9""",
)
def fairness_summary(spark, sf):
    pairs = A.pairwise_fairness(_people(spark, sf), "id", "grp", "label", 20000, 0.12, "pf")
    return rounded(rounded(A.fairness_summary(pairs, 0.12), "rate", digits=8), "severity")


@query(
    "knn_consistency",
    f"""WITH {ORD}, s AS (SELECT stddev_samp(prio) a, stddev_samp(yr) b, stddev_samp(price) c FROM ord),
    o AS (SELECT id, prio, yr, price, CAST(status = 1 AS DOUBLE) AS y, row_number() OVER (PARTITION BY prio, yr, price ORDER BY id) AS rn FROM ord),
    cells AS (SELECT prio, yr, price FROM ord GROUP BY ALL),
    near AS (SELECT c.prio, c.yr, c.price, o.y, row_number() OVER (PARTITION BY c.prio, c.yr, c.price ORDER BY
      round(sqrt(pow((c.prio - o.prio) / s.a, 2) + pow((c.yr - o.yr) / s.b, 2) + pow((c.price - o.price) / s.c, 2)), 9), o.id) AS k
      FROM cells c, o, s WHERE o.rn <= 5),
    m AS (SELECT prio, yr, price, avg(y) AS near FROM near WHERE k <= 5 GROUP BY ALL)
    SELECT round(1.0 - avg(abs(o.y - m.near)), 8) AS consistency FROM o JOIN m USING (prio, yr, price)""",
)
def knn_consistency(spark, sf):
    o = orders(spark, sf).withColumn("y", (F.col("status") == 1).cast("double"))
    sub = ORDER_DOMAIN.project(["prio", "yr", "price"])
    return rounded(A.knn_consistency(o, sub, "y", "id"), "consistency", digits=8)


@query(
    "knn_consistency_sparse",
    """WITH e AS (SELECT vec_id AS id, CAST(floor((embedding[1] + 0.5) * 10) AS INTEGER) AS a, CAST(floor((embedding[2] + 0.5) * 10) AS INTEGER) AS b,
      CAST(floor((embedding[3] + 0.5) * 10) AS INTEGER) AS c, CAST(label AS DOUBLE) AS y FROM embeddings),
    s AS (SELECT stddev_samp(a) sa, stddev_samp(b) sb, stddev_samp(c) sc FROM e),
    near AS (SELECT x.id, x.y AS own, o.y, row_number() OVER (PARTITION BY x.id ORDER BY
      round(sqrt(pow((x.a - o.a) / sa, 2) + pow((x.b - o.b) / sb, 2) + pow((x.c - o.c) / sc, 2)), 9), o.id) AS k FROM e x, e o, s)
    SELECT round(1.0 - avg(gap), 8) AS consistency FROM (SELECT id, abs(any_value(own) - avg(y)) AS gap FROM near WHERE k <= 5 GROUP BY id)""",
)
def knn_consistency_sparse(spark, sf):
    """Embedding vectors cut to three coded axes: few rows per cell, so the radius has to grow."""
    axis = lambda i: F.floor((F.element_at("embedding", i).cast("double") + 0.5) * 10).cast("int")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), axis(1).alias("a"), axis(2).alias("b"), axis(3).alias("c"), F.col("label").alias("y")
    )
    return rounded(A.knn_consistency(e, Domain.of({"a": 11, "b": 11, "c": 11}), "y", "id"), "consistency", digits=8)


