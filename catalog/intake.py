"""Sources, sinks and the results table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import ITM, ORD, ORDER_DOMAIN, docs, items, orders, query, rounded, table, u_sql
from margrid.domain import Domain, validate_domain
from margrid.operators.learn import train_score
from margrid.operators.noise import stratified_kfold
from margrid.session import ensure_checkpoint_dir
from margrid.sources import results as R
from margrid.sources import tables as T


def scratch(spark) -> str:
    """A fresh folder next to the checkpoints (shared on a cluster, temporary in local mode)."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/scratch-{uuid.uuid4().hex}"


@query(
    "load_dataset",
    "SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity, "
    "count(*) AS n FROM lineitem GROUP BY ALL",
)
def load_dataset(spark, sf):
    domain = Domain.of({"l_linenumber": 8, "l_quantity": 51})
    df = T.load_dataset(spark, f"{sf}/lineitem.parquet", domain)
    return df.groupBy(*domain.attrs).agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_domain",
    f"WITH {ITM} SELECT 'disc' AS attr, CAST(count(*) FILTER (disc > 5) AS BIGINT) AS bad_rows FROM itm "
    "UNION ALL SELECT 'flag', CAST(count(*) FILTER (flag > 1) AS BIGINT) FROM itm",
)
def check_domain(spark, sf):
    return validate_domain(items(spark, sf), Domain.of({"flag": 2, "disc": 6}))


@query(
    "dump_domain",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS attr, count(DISTINCT {c}) AS size FROM lineitem"
        for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_shipdate")
    ) + ")",
)
def dump_domain(spark, sf):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_shipdate"]
    t = table(spark, sf, "lineitem")
    domain = T.dump_domain(t, scratch(spark), cols)
    return spark.createDataFrame(list(zip(domain.attrs, domain.sizes)), "attr string, size bigint")


@query(
    "read_raw",
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, "
    "CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY ALL",
)
def read_raw(spark, sf):
    """Orders written as a headerless file with blanks after the commas, read back by name."""
    path = scratch(spark)
    line = F.concat_ws(",  ", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    raw = T.read_raw(spark, path, ["status", "priority", "custkey"], {"custkey": "bigint"})
    return raw.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("custkey").alias("keys"))


def _write_experiment(spark, sf) -> str:
    """Orders as the original table and two filtered variants under two budgets."""
    path = scratch(spark)
    o = orders(spark, sf).select("id", "status", "prio")
    blank = F.lit(None).cast("string")
    base = o.withColumns({"cs": (F.col("id") % 2).cast("int"), "method": F.lit("Original"), "eps": blank})
    half = base.where(F.col("prio") < 3).withColumns({"method": F.lit("greedy"), "eps": F.lit("1")})
    full = base.withColumns({"method": F.lit("tree"), "eps": F.lit("10")})
    T.write_folds(base.unionByName(half).unionByName(full), path)
    return path


@query(
    "load_method_folds",
    f"WITH {ORD}, ex AS (SELECT CAST(id % 2 AS INTEGER) AS cs, 'Original' AS method, '' AS eps, prio FROM ord "
    "UNION ALL SELECT CAST(id % 2 AS INTEGER), 'greedy', '1', prio FROM ord WHERE prio < 3) "
    "SELECT method, cs, eps, prio, count(*) AS n FROM ex GROUP BY ALL",
)
def load_method_folds(spark, sf):
    df = T.load_method_folds(spark, _write_experiment(spark, sf), eps="1")
    return df.groupBy("method", "cs", "eps", "prio").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_folds",
    f"WITH {ORD}, ex AS (SELECT id % 2 AS cs, 'Original' AS method, id FROM ord "
    "UNION ALL SELECT id % 2, 'greedy', id FROM ord WHERE prio < 3 UNION ALL SELECT id % 2, 'tree', id FROM ord) "
    "SELECT method, CAST(cs AS INTEGER) AS cs, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ex GROUP BY ALL",
)
def write_folds(spark, sf):
    df = spark.read.parquet(_write_experiment(spark, sf))
    return df.groupBy("method", "cs").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_RESULTS = """res AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Original' WHEN 'O' THEN 'tree' ELSE 'greedy' END AS method_name,
  CAST(o_custkey % 5 AS INTEGER) AS fold_num,
  CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0.5' END AS epsilon,
  avg(o_totalprice) AS price, stddev_samp(o_totalprice) AS spread FROM orders GROUP BY ALL)"""


def _results(spark, sf):
    """A results table measured on the orders: two metrics per method, fold and budget."""
    o = table(spark, sf, "orders")
    method = F.when(F.col("o_orderstatus") == "F", "Original").when(F.col("o_orderstatus") == "O", "tree").otherwise("greedy")
    eps = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderkey") % 2 == 0, "1.0").otherwise("0.5")
    return (
        o.groupBy(method.alias("method_name"), (F.col("o_custkey") % 5).cast("int").alias("fold_num"), eps.alias("epsilon"))
        .agg(F.avg("o_totalprice").alias("price"), F.stddev_samp("o_totalprice").alias("spread"))
    )


@query(
    "upsert_metric",
    f"WITH {_RESULTS} SELECT method_name, fold_num, epsilon, round(CASE WHEN fold_num < 2 THEN spread ELSE price END, 4) AS price, "
    "CASE WHEN fold_num < 2 THEN round(price / 2, 4) END AS half FROM res WHERE fold_num < 4",
)
def upsert_metric(spark, sf):
    """Folds 0..1 overwrite a metric and add a new one; missing rows appear."""
    res = _results(spark, sf)
    old = res.where((F.col("fold_num") > 0) & (F.col("fold_num") < 4)).select(*R.KEYS, "price")
    new = res.where(F.col("fold_num") < 2)
    updates = new.select(*R.KEYS, F.lit("price").alias("metric"), F.col("spread").alias("value")).unionByName(
        new.select(*R.KEYS, F.lit("half").alias("metric"), (F.col("price") / 2).alias("value"))
    )
    return rounded(R.upsert_metric(old, updates, ["price", "half"]), "price", "half", digits=4)


@query(
    "results_skeleton",
    f"WITH {_RESULTS}, keys AS (SELECT DISTINCT r.method_name, CAST(f.i AS INTEGER) AS fold_num, e.epsilon "
    "FROM res r, range(7) f(i), (VALUES ('1'), ('0.5'), ('10')) e(epsilon) WHERE r.method_name <> 'Original' "
    "UNION SELECT DISTINCT method_name, CAST(f.i AS INTEGER), '' FROM res, range(7) f(i) WHERE method_name = 'Original') "
    "SELECT * FROM keys k WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.method_name = k.method_name "
    "AND r.fold_num = k.fold_num AND r.epsilon = k.epsilon)",
)
def results_skeleton(spark, sf):
    res = _results(spark, sf)
    return R.results_skeleton(res.select("method_name").distinct(), 7, ["1.0", "0.5", "10"], res)


@query(
    "fold_summary",
    f"WITH {_RESULTS} SELECT method_name, epsilon, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, "
    "round(stddev_pop(price), 4) AS price_pstd FROM res GROUP BY ALL",
)
def fold_summary(spark, sf):
    res = _results(spark, sf).withColumn("epsilon", R.epsilon_key("epsilon"))
    return rounded(R.fold_summary(res, ["price"]), "price_mean", "price_std", "price_pstd", digits=4)


@query(
    "random_dataset",
    "SELECT id, " + ", ".join(
        f"CAST(floor({u_sql(f'random/{a}', 'id')} * {n}) AS INTEGER) AS {a}" for a, n in zip(ORDER_DOMAIN.attrs, ORDER_DOMAIN.sizes)
    ) + " FROM (SELECT row_number() OVER () - 1 AS id FROM orders)",
)
def random_dataset(spark, sf):
    """As many uniform rows over the orders' domain as there are orders."""
    n = table(spark, sf, "orders").count()
    return T.random_dataset(spark, ORDER_DOMAIN, n, "random")


@query("model_registry")
def model_registry(spark, sf):
    """A classifier per fold of the labelled documents, its record written and read back."""
    path = scratch(spark)
    d = docs(spark, sf).select(
        "doc_id", "toxic", "quality", F.log("n_chars").alias("size"),
        F.substring("source", 4, 2).cast("int").alias("src"),
    )
    folds = stratified_kfold(d, "quality", "doc_id", 2, "registry")
    for k in range(2):
        row = train_score(
            folds.where(F.col("fold") != k), folds.where(F.col("fold") == k), ["toxic", "size", "src"], "quality", "LR"
        ).first()
        T.write_model_info(spark, path, k, "LR", "maxIter=50", row["accuracy"])
    return T.read_model_info(spark, path).select("fold", "Model Name", "Best Parameters", "Accuracy")


@query(
    "union_all",
    "SELECT n_regionkey AS k, count(*) AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT s_nationkey FROM supplier) "
    "GROUP BY ALL",
)
def union_all(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return T.union_all(a, b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
