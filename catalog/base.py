"""Registry of queries with their SQL, the coded views they share, and small SQL builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrid.domain import Constraint, Domain
from margrid.functions.scalars import bucket_case

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL it must agree with (if there is one)."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- coded orders

ORDER_DOMAIN = Domain.of({"status": 3, "prio": 5, "yr": 7, "price": 5})
ORDER_RULE = Constraint.of("status", "prio", "yr")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as codes: id, status (3), prio (5), yr (7), price (5) and the raw total."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("prio"),
        (F.year("o_orderdate") - 1995).alias("yr"),
        F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int").alias("price"),
        F.col("o_totalprice").alias("total"),
    )


ORD = """ord AS (SELECT o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS prio,
  CAST(year(o_orderdate) - 1995 AS INTEGER) AS yr,
  CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS price,
  o_totalprice AS total FROM orders)"""

# ---------------------------------------------------------------- coded line items

ITEM_DOMAIN = Domain.of({"flag": 3, "status": 2, "line": 7, "disc": 11, "qty": 5})
ITEM_RULE = Constraint.of("flag", "status", "qty")
# Upper bounds and codes of the quantity buckets.
QTY_BUCKETS = [(10, 0), (20, 1), (30, 2), (40, 3), (None, 4)]


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as codes: flag (3), status (2), line (7), disc (11), qty (5); quantity is a weight."""
    t = table(spark, sf, "lineitem")
    return t.select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("status"),
        (F.col("l_linenumber") - 1).alias("line"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
        bucket_case("l_quantity", QTY_BUCKETS).alias("qty"),
        F.col("l_quantity").alias("weight"),
        F.col("l_shipdate").alias("shipped"),
    )


ITM = """itm AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status,
  CAST(l_linenumber - 1 AS INTEGER) AS line,
  CAST(round(l_discount * 100) AS INTEGER) AS disc,
  CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2
       WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS qty,
  l_quantity AS weight, l_shipdate AS shipped FROM lineitem)"""


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items shipped before and from mid-1998, as two tables to compare."""
    t = items(spark, sf)
    cut = F.lit("1998-07-01").cast("timestamp")
    return t.where(F.col("shipped") < cut), t.where(F.col("shipped") >= cut)


HALVES = ITM + """,
ta AS (SELECT * FROM itm WHERE shipped < TIMESTAMP '1998-07-01'),
tb AS (SELECT * FROM itm WHERE shipped >= TIMESTAMP '1998-07-01')"""

# ---------------------------------------------------------------- labelled documents

DOC_RULE = Constraint.of("lang", "quality", "source")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels: lang, source, quality, toxic."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id")


DOC = """doc AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# ---------------------------------------------------------------- SQL builders


def u_sql(seed: str, *cols: str) -> str:
    keys = ", ".join([f"'{seed}'", *cols])
    return (
        f"((CAST('0x' || substr(md5(concat_ws('|', {keys})), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE))"
        " / CAST(4503599627370496 AS DOUBLE))"
    )


def gauss_sql(seed: str, *cols: str) -> str:
    return f"(sqrt(-2.0 * ln({u_sql(seed + '/r', *cols)})) * cos(2.0 * pi() * {u_sql(seed + '/t', *cols)}))"


def laplace_sql(seed: str, *cols: str) -> str:
    v = f"({u_sql(seed + '/l', *cols)} - CAST(0.5 AS DOUBLE))"
    return f"(-sign({v}) * ln(1.0 - 2.0 * abs({v})))"


def gumbel_sql(seed: str, *cols: str) -> str:
    return f"(-ln(-ln({u_sql(seed + '/g', *cols)})))"


def axis_sql(**sizes: int) -> str:
    """Cross product of code ranges: ``axis_sql(a=2, b=3)`` gives a FROM clause."""
    return ", ".join(f"(SELECT CAST(i AS INTEGER) AS {a} FROM range({n}) r(i)) ax_{a}" for a, n in sizes.items())


def r(c, digits: int = 6):
    """Rounded double."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def n_rows():
    """Row count as column ``n``."""
    return F.count(F.lit(1)).alias("n")
