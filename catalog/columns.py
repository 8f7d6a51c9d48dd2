"""Projection, recodes, encoders, bins, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ITM, ITEM_DOMAIN, ORD, items, n_rows, orders, query, r, rounded, table, u_sql
from margrid.functions import scalars as X
from margrid.operators import encode as E
from margrid.operators import factors as K
from margrid.operators.marginals import marginal




@query("project", "SELECT o_orderkey, o_orderstatus FROM orders")
def project(spark, sf):
    return E.project(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("drop_roles", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_roles(spark, sf):
    return E.drop_roles(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderdate", "o_totalprice"])


@query(
    "filter_in",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') "
    "AND o_orderstatus IN ('F', 'O') GROUP BY ALL",
)
def filter_in(spark, sf):
    df = E.filter_in(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"], keep=False)
    return E.filter_in(df, "o_orderstatus", ["F", "O"]).groupBy("o_orderpriority").agg(n_rows())


@query(
    "bucket_case",
    """SELECT CASE WHEN l_quantity <= 25 THEN 20 WHEN l_quantity <= 35 THEN 30 WHEN l_quantity <= 45 THEN 40
      WHEN l_quantity <= 60 THEN 50 ELSE 70 END AS age,
    CASE WHEN l_quantity * 2 <= 20 THEN 20 WHEN l_quantity * 2 <= 35 THEN 30 WHEN l_quantity * 2 <= 40 THEN 40
      WHEN l_quantity * 2 <= 45 THEN 45 WHEN l_quantity * 2 <= 60 THEN 60 ELSE 70 END AS hours,
    CASE WHEN l_linenumber - 1 <= 0 THEN 0 WHEN l_linenumber - 1 <= 3 THEN 1 ELSE 2 END AS priors,
    CASE WHEN l_linenumber <= 5 THEN 5 WHEN l_linenumber >= 13 THEN 13 ELSE l_linenumber END AS education,
    count(*) AS n FROM lineitem GROUP BY ALL""",
)
def bucket_case(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.groupBy(
        X.bucket_case("l_quantity", X.AGE_BUCKETS).alias("age"),
        X.bucket_case(F.col("l_quantity") * 2, X.HOURS_BUCKETS).alias("hours"),
        X.bucket_case(F.col("l_linenumber") - 1, X.PRIORS_BUCKETS).alias("priors"),
        X.clamp("l_linenumber", X.EDUCATION_LOW, X.EDUCATION_HIGH).alias("education"),
    ).agg(n_rows())


@query(
    "map_values",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS tier,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'goods' WHEN 'MACHINERY' THEN 'goods' WHEN 'BUILDING' THEN 'site'
        ELSE 'other' END AS class, count(*) AS n FROM customer GROUP BY ALL""",
)
def map_values(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy(
        X.map_values("c_mktsegment", {"AUTOMOBILE": 2, "BUILDING": 1, "MACHINERY": 2}).alias("tier"),
        X.map_classes("c_mktsegment", {"goods": ["AUTOMOBILE", "MACHINERY"], "site": ["BUILDING"]}, "other").alias("class"),
    ).agg(n_rows())


@query("flip_binary", f"WITH {ITM} SELECT 1 - status AS flipped, count(*) AS n FROM itm GROUP BY ALL")
def flip_binary(spark, sf):
    return items(spark, sf).groupBy(X.flip_binary("status").alias("flipped")).agg(n_rows())


@query(
    "cast_columns",
    "SELECT CAST(o_totalprice > 250000 AS INTEGER) AS dear, CAST(o_orderstatus = 'F' AS INTEGER) AS done, count(*) AS n "
    "FROM orders GROUP BY ALL",
)
def cast_columns(spark, sf):
    o = table(spark, sf, "orders").select(
        (F.col("o_totalprice") > 250000).alias("dear"), (F.col("o_orderstatus") == "F").alias("done")
    )
    return E.cast_columns(o, ["dear", "done"], "boolean", "int").groupBy("dear", "done").agg(n_rows())


@query(
    "label_encode",
    """SELECT p_partkey, p_size, CAST(dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS INTEGER) AS size_code,
      CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM part""",
)
def label_encode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_size").alias("size_code"), "p_brand")
    return E.label_encode(p, ["size_code", "p_brand"])


@query(
    "label_encode_wide",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name FROM customer",
)
def label_encode_wide(spark, sf):
    """A column whose values are all different: codes are numbered in range-cut pieces."""
    return E.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])


@query(
    "ordinal_encode_unknown",
    """WITH codes AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 2 AND p_type <> 'ECONOMY'))
    SELECT coalesce(c.code, -1) AS p_brand, count(*) AS n FROM part p LEFT JOIN codes c ON p.p_brand = c.p_brand GROUP BY ALL""",
)
def ordinal_encode_unknown(spark, sf):
    p = table(spark, sf, "part")
    train = p.where((F.col("p_size") <= 2) & (F.col("p_type") != "ECONOMY"))
    return E.ordinal_encode_unknown(train, p, ["p_brand"]).groupBy("p_brand").agg(n_rows())


@query(
    "encode_with_mean_impute",
    """WITH src AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '?' ELSE c_mktsegment END AS seg FROM customer),
    codes AS (SELECT seg, CAST(dense_rank() OVER (ORDER BY seg) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT seg FROM src)),
    mean AS (SELECT CAST(round_even(avg(code), 0) AS INTEGER) AS m FROM src JOIN codes USING (seg) WHERE seg <> '?')
    SELECT c_custkey, CASE WHEN seg = '?' THEN (SELECT m FROM mean) ELSE code END AS seg FROM src JOIN codes USING (seg)""",
)
def encode_with_mean_impute(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment"))
    return E.encode_with_mean_impute(c.select("c_custkey", seg.alias("seg")), ["seg"])


@query(
    "clean_tokens",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL ELSE event_type END AS event_type,
      CAST(event_type = 'purchase' AS INTEGER) AS paid, event_type AS other FROM events""",
)
def clean_tokens(spark, sf):
    """Quoted and blank-padded event types, two of them spelled as missing; one true/false text column."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "view", "").otherwise(
        F.concat(F.lit('  "'), "event_type", F.lit('"'))
    )
    paid = F.when(F.col("event_type") == "purchase", "TRUE").otherwise("False")
    df = e.select("event_id", kind.alias("event_type"), paid.alias("paid"), F.col("event_type").alias("other"))
    return E.boolean_text(E.clean_tokens(df, ["event_type", "other"]), ["paid", "other"])


@query(
    "quantile_bin",
    """WITH q AS (SELECT quantile_cont(l_quantity, 0.2) a, quantile_cont(l_quantity, 0.4) b, quantile_cont(l_quantity, 0.6) c,
      quantile_cont(l_quantity, 0.8) d, quantile_cont(l_extendedprice, 0.2) e, quantile_cont(l_extendedprice, 0.4) f,
      quantile_cont(l_extendedprice, 0.6) g, quantile_cont(l_extendedprice, 0.8) h FROM lineitem)
    SELECT CAST(l_quantity > a AS INTEGER) + CAST(l_quantity > b AS INTEGER) + CAST(l_quantity > c AS INTEGER) + CAST(l_quantity > d AS INTEGER) AS qty,
      CAST(l_extendedprice > e AS INTEGER) + CAST(l_extendedprice > f AS INTEGER) + CAST(l_extendedprice > g AS INTEGER) + CAST(l_extendedprice > h AS INTEGER) AS price,
      count(*) AS n FROM lineitem, q GROUP BY ALL""",
)
def quantile_bin(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    return E.quantile_bin(t, ["qty", "price"], 5).groupBy("qty", "price").agg(n_rows())


@query(
    "exact_quantiles",
    "SELECT round(quantile_cont(value, 0.0), 6) AS q0, round(quantile_cont(value, 0.333), 6) AS q1, "
    "round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.99), 6) AS q3 FROM events",
)
def exact_quantiles(spark, sf):
    return rounded(E.exact_quantiles(table(spark, sf, "events"), "value", [0.0, 0.333, 0.5, 0.99]), "q0", "q1", "q2", "q3")


@query(
    "equal_width_bin_mean",
    """WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
    b AS (SELECT o_totalprice, CAST(greatest(least(ceil((o_totalprice - lo) / ((hi - lo) / CAST(40 AS DOUBLE))), 40), 1) AS INTEGER) AS bin FROM orders, s),
    m AS (SELECT bin, avg(o_totalprice) AS mean FROM b GROUP BY bin)
    SELECT round(mean, 4) AS price, count(*) AS n FROM b JOIN m USING (bin) GROUP BY ALL""",
)
def equal_width_bin_mean(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"))
    return E.equal_width_bin_mean(o, "price", 40).groupBy(r("price", 4).alias("price")).agg(n_rows())


_GAPS = f"""{ORD}, gap AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN -1 ELSE prio END AS prio FROM ord)"""


@query(
    "impute_random_observed",
    f"""WITH {_GAPS}, seen AS (SELECT prio AS v, row_number() OVER (ORDER BY prio) - 1 AS code
      FROM (SELECT DISTINCT prio FROM gap WHERE prio IS NOT NULL AND prio <> -1))
    SELECT g.id, CASE WHEN g.prio IS NULL OR g.prio = -1 THEN s.v ELSE g.prio END AS prio FROM gap g
    LEFT JOIN seen s ON s.code = CAST(floor({u_sql('impute', 'g.id')} * (SELECT count(*) FROM seen)) AS BIGINT)""",
)
def impute_random_observed(spark, sf):
    gap = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, -1).otherwise(F.col("prio"))
    df = orders(spark, sf).select("id", gap.cast("int").alias("prio"))
    return E.impute_random_observed(df, "prio", ["id"], "impute")


@query("drop_constant_columns", "SELECT n_nationkey, n_name FROM nation")
def drop_constant_columns(spark, sf):
    """One constant, one all-NULL and one leaking column are dropped."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name").withColumns(
        {"one": F.lit(1), "none": F.lit(None).cast("int"), "bar1": F.col("n_nationkey")}
    )
    return E.drop_leaky_columns(E.drop_constant_columns(n))


@query(
    "drop_incomplete_rows",
    f"WITH {_GAPS} SELECT prio, count(*) AS n FROM gap WHERE prio IS NOT NULL GROUP BY ALL",
)
def drop_incomplete_rows(spark, sf):
    gap = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, -1).otherwise(F.col("prio"))
    df = orders(spark, sf).select("id", gap.cast("int").alias("prio"))
    return E.drop_incomplete_rows(df).groupBy("prio").agg(n_rows())


@query(
    "composite_key",
    """WITH k AS (SELECT o_orderstatus || '_' || o_orderpriority AS key, o_orderstatus || o_orderpriority AS tight FROM orders)
    SELECT key, tight, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INTEGER) AS code, count(*) AS n FROM k GROUP BY key, tight""",
)
def composite_key(spark, sf):
    cols = ["o_orderstatus", "o_orderpriority"]
    o = table(spark, sf, "orders").select(X.composite_key(cols).alias("key"), X.composite_key(cols, "").alias("tight"))
    o = o.withColumn("code", F.col("key"))
    return E.apply_codes(o, "code", E.fit_codes(o, "code")).withColumn("code", F.col("code").cast("int")).groupBy("key", "tight", "code").agg(n_rows())


@query(
    "scale_by_std",
    """WITH s AS (SELECT stddev_samp(l_quantity) a, stddev_samp(l_linenumber) b FROM lineitem)
    SELECT l_quantity AS raw, round_even(l_quantity / a * CAST(0.5 AS DOUBLE), 4) AS qty, round_even(l_linenumber / b, 4) AS line,
      count(*) AS n FROM lineitem, s GROUP BY ALL""",
)
def scale_by_std(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("raw"), F.col("l_quantity").alias("qty"), F.col("l_linenumber").alias("line")
    )
    return E.scale_by_std(t, ["qty", "line"], {"qty": 0.5}).groupBy("raw", "qty", "line").agg(n_rows())


@query("unscale", "SELECT l_quantity AS qty, CAST(l_linenumber AS DOUBLE) AS line, count(*) AS n FROM lineitem GROUP BY ALL")
def unscale(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_linenumber").alias("line"))
    scaled = E.scale_by_std(t, ["qty", "line"], {"qty": 0.5})
    return E.unscale(scaled, t, ["qty", "line"], {"qty": 0.5}).groupBy("qty", "line").agg(n_rows())


@query(
    "one_hot",
    "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS st_F, CAST(o_orderstatus = 'O' AS INTEGER) AS st_O, "
    "CAST(o_orderstatus = 'P' AS INTEGER) AS st_P FROM orders",
)
def one_hot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return E.one_hot(o, "o_orderstatus", ["F", "O", "P"], "st")


@query("undummify", "SELECT o_orderkey, o_orderstatus AS st FROM orders")
def undummify(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return E.undummify(E.one_hot(o, "o_orderstatus", ["F", "O", "P"], "st"), "st")


@query(
    "condition",
    f"WITH {ITM} SELECT line, CAST(count(*) AS DOUBLE) AS value FROM itm WHERE flag = 1 AND status = 0 GROUP BY line",
)
def condition(spark, sf):
    m = marginal(items(spark, sf), ITEM_DOMAIN, ["flag", "status", "line"])
    return K.condition(m, {"flag": 1, "status": 0})


@query(
    "structural_zeros",
    f"""WITH {ITM}, c AS (SELECT flag, qty, CAST(count(*) AS DOUBLE) AS n FROM itm GROUP BY ALL),
    ok AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM itm i WHERE i.line = 6 AND i.disc = 10 AND i.status = 1
      AND i.flag = c.flag AND i.qty = c.qty AND i.flag <> 2))
    SELECT flag, qty, round(n / (SELECT sum(n) FROM ok), 9) AS value FROM ok""",
)
def structural_zeros(spark, sf):
    """Cells that occur with the last line and largest discount are forbidden for two of the flags."""
    t = items(spark, sf)
    bad = t.where((F.col("line") == 6) & (F.col("disc") == 10) & (F.col("status") == 1) & (F.col("flag") != 2))
    m = t.groupBy("flag", "qty").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(K.structural_zeros(m, bad.select("flag", "qty").distinct()), "value", digits=9)


@query(
    "scalar_math",
    """SELECT event_id, round(exp(value / 100), 6) AS e, round(ln(value + 1e-100), 6) AS l, round(log2(value), 6) AS l2,
      round(sqrt(value), 6) AS s, abs(user_id - 75) AS a, round(1.0 / (1.0 + exp(-value / 100)), 6) AS sg,
      round(atan(value) / atan(CAST(3 AS DOUBLE)), 6) AS at, CASE WHEN user_id % 2 = 1 THEN -1 ELSE 1 END AS sign,
      CAST((user_id % 2) * 4 + (event_id % 2) * 2 + CAST(event_type = 'view' AS INTEGER) AS BIGINT) AS bits FROM events""",
)
def scalar_math(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r(F.exp(v / 100)).alias("e"), r(X.log_floor(v)).alias("l"), r(F.log2(v)).alias("l2"),
        r(F.sqrt(v)).alias("s"), F.abs(F.col("user_id") - 75).alias("a"), r(X.sigmoid(v / 100)).alias("sg"),
        r(X.arctan_ratio(v, 3)).alias("at"), X.parity_sign("user_id").alias("sign"),
        X.bits_to_int(F.col("user_id") % 2, F.col("event_id") % 2, F.col("event_type") == "view").alias("bits"),
    )
