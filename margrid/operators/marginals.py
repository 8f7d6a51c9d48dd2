"""Counts over discrete domains: marginals, distributions, grids and workload tables.

Long form of a set of marginals: one row per (clique, cell), where ``clique`` is the attribute
names joined by commas and ``cell`` the row-major cell number of the domain.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from margrid.domain import MAX_CELLS, Domain
from margrid.operators.ranking import dense_codes
from margrid.session import shuffle_width

MAX_JOINT = 5_000_000
_CHUNK = 1 << 16


def clique_name(attrs: Iterable[str]) -> str:
    return ",".join(attrs)


def clique_attrs(name: str) -> tuple[str, ...]:
    return tuple(name.split(","))


def _measure(weight: str | None) -> Column:
    return F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))


# ---------------------------------------------------------------- grids


def domain_grid(
    spark: SparkSession, domain: Domain, attrs: Sequence[str], max_cells: int = MAX_CELLS
) -> DataFrame:
    """Every cell of a clique, laid out by arithmetic on a range instead of a product of tables."""
    cells = domain.guard(attrs, max_cells)
    return spark.range(cells).withColumnRenamed("id", "cell").select(
        *domain.decode(attrs), "cell"
    )


def value_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of the non-NULL values of a column in value order."""
    return dense_codes(df.select(col).where(F.col(col).isNotNull()).distinct(), col)


def observed_grid(df: DataFrame, cols: Sequence[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """All combinations of the values seen in each column."""
    sizes = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    domain = Domain(tuple(f"__{c}" for c in cols), tuple(sizes[c] for c in cols))
    grid = domain_grid(df.sparkSession, domain, domain.attrs, max_cells)
    for c in cols:
        names = value_dictionary(df, c).withColumnRenamed("code", f"__{c}")
        grid = grid.join(names, f"__{c}")
    return grid.select(*cols)


def observed_cells(grid: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells of a grid that occur in the data."""
    return grid.join(df.select(*cols), list(cols), "left_semi")


def initial_distribution(grid: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows in each grid cell, 0 where the cell does not occur."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.select(F.sum("__n")).scalar()
    joined = grid.join(counts, list(cols), "left")
    return joined.select(*cols, (F.coalesce(F.col("__n"), F.lit(0)) / total).alias("p"))


# ---------------------------------------------------------------- one marginal


def marginal(
    df: DataFrame,
    domain: Domain,
    attrs: Sequence[str],
    weight: str | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Dense count vector of a clique: every cell once, zero cells included."""
    counts = df.groupBy(*attrs).agg(_measure(weight).alias("value"))
    grid = domain_grid(df.sparkSession, domain, attrs, max_cells)
    return grid.join(counts, list(attrs), "left").select(
        *attrs, F.coalesce("value", F.lit(0.0)).alias("value")
    )


def empirical_distribution(
    df: DataFrame,
    domain: Domain,
    attrs: Sequence[str],
    weight: str | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Share of rows (or of weight) per cell of a fixed domain, 0 where unseen.

    Rows outside the domain count in the total, as they do in a plain value count; the
    weighted form is normalised over the cells of the domain.
    """
    counts = df.groupBy(*attrs).agg(_measure(weight).alias("n"))
    base = counts if weight is None else counts.where(domain.in_range(attrs))
    total = base.select(F.sum("n")).scalar()
    grid = domain_grid(df.sparkSession, domain, attrs, max_cells)
    return grid.join(counts, list(attrs), "left").select(
        *attrs, (F.coalesce("n", F.lit(0.0)) / total).alias("p")
    )


def conditional_distribution(
    df: DataFrame,
    target: str,
    given: Sequence[str],
    weight: str | None = None,
    fill: bool = True,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """P(target | given) and counts; absent combinations of seen values carry count 0."""
    counts = df.groupBy(*given, target).agg(_measure(weight).alias("n"))
    totals = counts.groupBy(*given).agg(F.sum("n").alias("n_given"))
    if not fill:
        joined = counts.join(totals, list(given))
        return joined.select(*given, target, "n", (F.col("n") / F.col("n_given")).alias("p"))
    grid = observed_grid(counts, [*given, target], max_cells)
    joined = grid.join(counts, [*given, target], "left").join(totals, list(given), "left")
    n = F.coalesce("n", F.lit(0.0))
    p = F.when(F.col("n_given") > 0, n / F.col("n_given"))
    return joined.select(*given, target, n.alias("n"), p.alias("p"))


def conditional_rollups(
    df: DataFrame, target: str, roles: Sequence[Sequence[str]], labels: Sequence[str]
) -> DataFrame:
    """P(target | role columns) for several sets of conditioning columns out of one count table."""
    every = sorted({c for r in roles for c in r})
    base = df.groupBy(*every, target).agg(F.count(F.lit(1)).alias("n"))
    rows = [
        F.struct(
            F.lit(label).alias("given"),
            F.concat_ws("_", *[F.col(c).cast("string") for c in role]).alias("key"),
        )
        for label, role in zip(labels, roles)
    ]
    long = base.select(F.explode(F.array(*rows)).alias("g"), target, "n")
    cells = long.groupBy("g.given", "g.key", target).agg(F.sum("n").alias("n"))
    totals = cells.groupBy("given", "key").agg(F.sum("n").alias("n_given"))
    return cells.join(totals, ["given", "key"]).select(
        "given", "key", target, "n", (F.col("n") / F.col("n_given")).alias("p")
    )


def contingency(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Cross table in long form with X margin, Y margin and total (margin marked by NULL key)."""
    key = lambda cols: F.concat_ws("_", *[F.col(c).cast("string") for c in cols])
    cells = df.groupBy(key(x).alias("x"), key(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return cells.cube("x", "y").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- many marginals


def clique_chunks(spark: SparkSession, domain: Domain, cliques: Sequence[Sequence[str]]) -> DataFrame:
    """All cells of several cliques as (clique, cell); sizes come from the domain metadata."""
    rows = []
    for attrs in cliques:
        cells = domain.guard(attrs)
        for start in range(0, cells, _CHUNK):
            rows.append((clique_name(attrs), start, min(start + _CHUNK, cells) - 1))
    chunks = spark.createDataFrame(rows, "clique string, lo bigint, hi bigint")
    if len(rows) > 64:
        chunks = chunks.repartition(shuffle_width(spark), "clique", "lo")
    return chunks.select("clique", F.explode(F.sequence("lo", "hi")).alias("cell"))


def clique_cells(domain: Domain, cliques: Sequence[Sequence[str]]) -> Column:
    """Array of (clique, cell) pairs a row belongs to, to be exploded and counted."""
    return F.array(
        *[
            F.struct(F.lit(clique_name(a)).alias("clique"), domain.cell(a).alias("cell"))
            for a in cliques
        ]
    )


def clique_sums(
    df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], value: str
) -> DataFrame:
    """Sums of ``value`` for every (clique, cell) out of one pass over the table."""
    long = df.select(F.explode(clique_cells(domain, cliques)).alias("m"), value)
    return long.groupBy("m.clique", "m.cell").agg(F.sum(value).alias("value"))


def joint_counts(df: DataFrame, domain: Domain, weight: str | None = None) -> DataFrame:
    """Distinct cells of the full domain with their counts, as column ``n``."""
    return (
        df.where(domain.in_range()).groupBy(*domain.attrs).agg(_measure(weight).alias("n"))
    )


def clique_marginals(
    df: DataFrame,
    domain: Domain,
    cliques: Sequence[Sequence[str]],
    weight: str | None = None,
    dense: bool = True,
) -> DataFrame:
    """Counts of many cliques in long form.

    A small joint domain is counted once and rolled up; a large one is exploded per row in one
    scan, where map-side aggregation keeps the shuffle at the size of the marginals.
    """
    cliques = [tuple(c) for c in cliques]
    used = [a for a in domain.attrs if any(a in c for c in cliques)]
    sub = domain.project(used)
    if sub.size() <= MAX_JOINT:
        rows = joint_counts(df, sub, weight)
    else:
        one = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        rows = df.where(sub.in_range()).withColumn("n", one)
    sums = clique_sums(rows, domain, cliques, "n")
    if not dense:
        return sums
    grid = clique_chunks(df.sparkSession, domain, cliques)
    return grid.join(sums, ["clique", "cell"], "left").select(
        "clique", "cell", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def workload(domain: Domain, k: int, max_cells: int | None = None) -> list[tuple[str, ...]]:
    """All k-way cliques; only a caller's explicit ``max_cells`` leaves larger ones out."""
    cliques = list(combinations(domain.attrs, k))
    return cliques if max_cells is None else [c for c in cliques if domain.size(c) <= max_cells]


def all_marginals(
    df: DataFrame, domain: Domain, k: int, max_cells: int | None = None, weight: str | None = None
) -> DataFrame:
    """Counts of every k-way clique, or of those within an explicit ``max_cells``."""
    return clique_marginals(df, domain, workload(domain, k, max_cells), weight)


def prefix_marginal(
    df: DataFrame, domain: Domain, attrs: Sequence[str], axis: str, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Cumulative counts along one ordinal axis, identity on the other axes."""
    dense = marginal(df, domain, attrs, max_cells=max_cells)
    others = [a for a in attrs if a != axis]
    w = Window.partitionBy(*others).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*attrs, F.sum("value").over(w).alias("value"))


def prefix_error(
    left: DataFrame, right: DataFrame, domain: Domain, attrs: Sequence[str], axis: str
) -> DataFrame:
    """Relative L1 error of the prefix counts of ``right`` against those of ``left``."""
    a = prefix_marginal(left, domain, attrs, axis).withColumnRenamed("value", "a")
    b = prefix_marginal(right, domain, attrs, axis).withColumnRenamed("value", "b")
    both = a.join(b, list(attrs))
    return both.agg((F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum("a")).alias("rel_l1"))


# ---------------------------------------------------------------- profiles and keys


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct, NULL and row counts of each column, one row per column.

    Values are counted per (column, value) first, so a hot value is folded before the shuffle.
    """
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("v"))
                    for c in cols
                ]
            )
        ).alias("p")
    )
    counts = cells.groupBy("p.attr", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("attr").agg(
        F.count("v").alias("n_distinct"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum("n").alias("n_rows"),
        F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top_count"),
    )


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether column a determines column b, with the number of keys and of violating keys."""
    pairs = df.where(F.col(a).isNotNull()).select(a, b).distinct()
    per_key = pairs.groupBy(a).agg(F.count(b).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("n_violating"),
        F.bool_and(F.col("n") <= 1).alias("holds"),
    )


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of the given columns."""
    return df.select(*cols).distinct()


# ---------------------------------------------------------------- workload algebra


def subsets(cliques: DataFrame, col: str = "attrs") -> DataFrame:
    """All non-empty subsets of every clique, once each (downward closure)."""
    mask = F.explode(F.sequence(F.lit(1), (F.pow(2.0, F.size(col)) - 1).cast("int"))).alias("mask")
    picked = F.expr(f"filter({col}, (a, i) -> (shiftright(mask, i) & 1) = 1)")
    return cliques.select(col, mask).select(picked.alias(col)).distinct()


def workload_closure(cliques: DataFrame, col: str = "attrs", weight: str = "weight") -> DataFrame:
    """Downward closure of a weighted workload with the overlap score of each member.

    The score sums weight * |member and clique| over the workload: each attribute is worth the
    total weight of the cliques that hold it, so no member-by-clique pairing is needed.
    """
    closure = subsets(cliques, col)
    worth = (
        cliques.select(F.explode(col).alias("a"), weight)
        .groupBy("a")
        .agg(F.sum(weight).alias("w"))
    )
    flat = closure.select(col, F.explode(col).alias("a"))
    return flat.join(worth, "a").groupBy(col).agg(F.sum("w").alias("score"))


def maximal_cliques(cliques: DataFrame, col: str = "attrs") -> DataFrame:
    """Cliques not strictly contained in another one (candidates meet on a shared attribute)."""
    left = cliques.select(F.array_sort(col).alias(col)).distinct()
    first = F.element_at(col, 1)
    right = left.select(F.col(col).alias("__big"), F.explode(col).alias("__a"))
    contained = (F.size("__big") > F.size(col)) & (
        F.size(F.array_except(F.col(col), F.col("__big"))) == 0
    )
    return left.join(right, (first == F.col("__a")) & contained, "left_anti")


def clique_homes(cliques: DataFrame, col: str = "attrs") -> DataFrame:
    """For each clique the first maximal clique that holds it."""
    big = maximal_cliques(cliques, col).select(
        F.col(col).alias("__big"), F.explode(col).alias("__a")
    )
    small = cliques.select(F.array_sort(col).alias(col)).distinct()
    holds = F.size(F.array_except(F.col(col), F.col("__big"))) == 0
    return (
        small.join(big, (F.element_at(col, 1) == F.col("__a")) & holds)
        .groupBy(col)
        .agg(F.min("__big").alias("home"))
    )


def min_variance_total(measured: DataFrame) -> DataFrame:
    """Inverse-variance estimate of the row count from noisy identity marginals.

    Input: (clique, cell, noisy, stddev) with every cell of a clique present; output is one row,
    at least 1, and 1 when nothing was measured.
    """
    per = measured.groupBy("clique").agg(
        F.sum("noisy").alias("estimate"),
        (F.max(F.col("stddev") * F.col("stddev")) * F.count(F.lit(1))).alias("variance"),
    )
    total = F.sum(F.col("estimate") / F.col("variance")) / F.sum(F.lit(1.0) / F.col("variance"))
    return per.agg(F.greatest(F.lit(1.0), F.coalesce(total, F.lit(1.0))).alias("total"))
