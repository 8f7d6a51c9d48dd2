"""Readers and writers: coded tables, raw files, folds, domains and model records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margrid.domain import Domain
from margrid.functions.hashing import uniform


def load_dataset(
    spark: SparkSession, path: str, domain: Domain, drop: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """A coded table restricted to the domain's attributes, with the sizes as metadata."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True)
    attrs = [a for a in domain.attrs if a not in set(drop)]
    missing = [a for a in attrs if a not in df.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    cols = [F.col(f"`{a}`").cast("int").alias(a) for a in attrs]
    if weight:
        cols.append(F.col(f"`{weight}`").cast("double").alias(weight))
    return domain.project(attrs).annotate(df.select(*cols))


def read_raw(spark: SparkSession, path: str, names: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Headerless comma file with blanks after the commas; names are supplied."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(
        path, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    types = types or {}
    return df.select(*[F.col(f"`{n}`").cast(types.get(n, "string")).alias(n) for n in names])


def domain_sizes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct count per column as (attr, size).

    Values are folded per column before counting; the result sees the table un-noised, so it
    lies outside any privacy guarantee.
    """
    cols = list(cols or df.columns)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").cast("string").alias("v"))
            for c in cols
        ]
    )
    pairs = df.select(F.explode(cells).alias("p")).select("p.attr", "p.v").distinct()
    return pairs.groupBy("attr").agg(F.count("v").alias("size"))


def dump_domain(df: DataFrame, path: str, cols: Sequence[str] | None = None) -> Domain:
    """Write the domain as one JSON record and return it."""
    order = list(cols or df.columns)
    sizes = {r["attr"]: r["size"] for r in domain_sizes(df, order).collect()}
    domain = Domain.of({c: sizes[c] for c in order})
    fields = [F.lit(n).cast("int").alias(a) for a, n in zip(domain.attrs, domain.sizes)]
    df.sparkSession.range(1).select(*fields).write.mode("overwrite").json(path)
    return domain


def read_domain(spark: SparkSession, path: str, order: Sequence[str]) -> Domain:
    row = spark.read.json(path).first()
    return Domain.of({a: row[a] for a in order})


def random_dataset(spark: SparkSession, domain: Domain, rows: int, seed: str) -> DataFrame:
    """Uniform rows over a domain, made in parallel from row numbers."""
    cols = [
        F.floor(uniform(f"{seed}/{a}", "id") * F.lit(n)).cast("int").alias(a)
        for a, n in zip(domain.attrs, domain.sizes)
    ]
    return domain.annotate(spark.range(rows).select("id", *cols))


def write_folds(df: DataFrame, path: str, keys: Sequence[str] = ("cs", "method", "eps")) -> None:
    """Sink train, test or synthetic rows, one directory per key value."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def load_method_folds(
    spark: SparkSession, path: str, cs: int | None = None, eps: str | None = None
) -> DataFrame:
    """All methods, folds and budgets of an experiment; filters prune directories.

    The blank budget of the original table is stored as NULL and read back as "".
    """
    df = spark.read.parquet(path)
    if cs is not None:
        df = df.where(F.col("cs") == cs)
    if eps is not None:
        df = df.where(F.col("eps").isNull() | (F.col("eps").cast("string") == eps))
    return df.withColumn("eps", F.coalesce(F.col("eps").cast("string"), F.lit("")))


def tag_tables(tables: Mapping[tuple[str, int, str], DataFrame]) -> DataFrame:
    """Union of (method, cs, eps)-keyed tables with their keys as columns."""
    tagged = [
        df.withColumns({"method": F.lit(m), "cs": F.lit(cs), "eps": F.lit(eps)})
        for (m, cs, eps), df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def write_model_info(spark: SparkSession, path: str, fold: int, name: str, params: str, accuracy: float) -> None:
    """One JSON record of the best model of a fold."""
    row = [(fold, name, params, float(accuracy))]
    schema = "fold int, `Model Name` string, `Best Parameters` string, Accuracy double"
    spark.createDataFrame(row, schema).write.mode("overwrite").json(f"{path}/cs={fold}/model_info")


def read_model_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/cs=*/model_info")
