"""Factor algebra: a factor is a DataFrame of code columns plus ``value``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrid.domain import MAX_CELLS, Domain
from margrid.operators.marginals import domain_grid


def attrs_of(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != "value"]


def factor_sum(factor: DataFrame, drop: Iterable[str]) -> DataFrame:
    """Sum out attributes."""
    return factor_project(factor, [a for a in attrs_of(factor) if a not in set(drop)])


def factor_project(factor: DataFrame, keep: Sequence[str]) -> DataFrame:
    return factor.groupBy(*keep).agg(F.sum("value").alias("value"))


def factor_max(factor: DataFrame, drop: Iterable[str]) -> DataFrame:
    keep = [a for a in attrs_of(factor) if a not in set(drop)]
    return factor.groupBy(*keep).agg(F.max("value").alias("value"))


def factor_logsumexp(factor: DataFrame, drop: Iterable[str]) -> DataFrame:
    """log(sum(exp(value))) over attributes, shifted by the group maximum."""
    keep = [a for a in attrs_of(factor) if a not in set(drop)]
    top = factor.groupBy(*keep).agg(F.max("value").alias("__m"))
    if keep:
        shifted = factor.join(top, keep)
    else:
        shifted = factor.withColumn("__m", top.select("__m").scalar())
    total = F.sum(F.exp(F.col("value") - F.col("__m")))
    return shifted.groupBy(*keep).agg((F.max("__m") + F.log(total)).alias("value"))


def normalize(factor: DataFrame, total: float = 1.0, log: bool = False) -> DataFrame:
    """Scale a factor to a total; with ``log`` the values are log potentials."""
    attrs = attrs_of(factor)
    if log:
        z = factor_logsumexp(factor, attrs).select("value").scalar()
        return factor.select(*attrs, (F.col("value") - z + F.log(F.lit(total))).alias("value"))
    z = factor.select(F.sum("value")).scalar()
    return factor.select(*attrs, (F.col("value") * F.lit(total) / z).alias("value"))


def condition(factor: DataFrame, evidence: dict[str, int]) -> DataFrame:
    """Slice of a factor at fixed codes."""
    keep = F.lit(True)
    for attr, code in evidence.items():
        keep = keep & (F.col(attr) == F.lit(code))
    return factor.where(keep).drop(*evidence)


def _combine(a: DataFrame, b: DataFrame, domain: Domain, op) -> DataFrame:
    left, right = attrs_of(a), attrs_of(b)
    shared = [c for c in left if c in right]
    merged = left + [c for c in right if c not in left]
    a, b = a.withColumnRenamed("value", "__a"), b.withColumnRenamed("value", "__b")
    if shared:
        joined = a.join(b, shared)
    else:
        grid = domain_grid(a.sparkSession, domain, merged).drop("cell")
        joined = grid.join(a, left).join(b, right)
    return joined.select(*merged, op(F.col("__a"), F.col("__b")).alias("value"))


def factor_product(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    """Natural join on shared attributes with values multiplied.

    Without shared attributes the merged domain is laid out first and both sides join by key,
    so no row-by-row product of two tables is run.
    """
    return _combine(a, b, domain, lambda x, y: x * y)


def factor_add(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    return _combine(a, b, domain, lambda x, y: x + y)


def factor_subtract(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    return _combine(a, b, domain, lambda x, y: x - y)


def factor_divide(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    """Plain division: a zero divisor gives a signed infinity, or NaN over zero."""

    def op(x: Column, y: Column) -> Column:
        over_zero = F.when(x == 0, F.lit(float("nan"))).otherwise(x * F.lit(float("inf")))
        return F.when(y != 0, x / y).otherwise(over_zero)

    return _combine(a, b, domain, op)


def factor_divide_guarded(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    """Division with 0 wherever the divisor is not positive."""
    guarded = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return _combine(a, b, domain, guarded)


def factor_logaddexp(a: DataFrame, b: DataFrame, domain: Domain) -> DataFrame:
    """log(exp a + exp b) cell by cell."""

    def op(x: Column, y: Column) -> Column:
        hi, lo = F.greatest(x, y), F.least(x, y)
        return hi + F.log1p(F.exp(lo - hi))

    return _combine(a, b, domain, op)


def independent_pair(
    df: DataFrame, domain: Domain, a: Sequence[str], b: Sequence[str]
) -> DataFrame:
    """count(a) * count(b) / N over the merged grid of two attribute sets."""
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    left = df.groupBy(*a).agg(F.count(F.lit(1)).cast("double").alias("value"))
    right = df.groupBy(*b).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _combine(left, right, domain, lambda x, y: x * y / n)


def structural_zeros(factor: DataFrame, forbidden: DataFrame, total: float = 1.0) -> DataFrame:
    """Drop forbidden cells and scale the rest back to the total."""
    attrs = [c for c in forbidden.columns if c in factor.columns]
    return normalize(factor.join(forbidden, attrs, "left_anti"), total)


# ---------------------------------------------------------------- elimination


def elimination_order(scopes: Sequence[set[str]], drop: Iterable[str], domain: Domain) -> list[str]:
    """Attributes to sum out, smallest intermediate table first (metadata only)."""
    scopes, left, order = [set(s) for s in scopes], set(drop), []
    while left:
        def cost(v: str) -> tuple[int, str]:
            joined = set().union(*[s for s in scopes if v in s] or [{v}])
            return domain.size(joined), v

        v = min(left, key=cost)
        joined = set().union(*[s for s in scopes if v in s] or [set()]) - {v}
        scopes = [s for s in scopes if v not in s] + [joined]
        left.remove(v)
        order.append(v)
    return order


def eliminate(factors: Sequence[DataFrame], keep: Sequence[str], domain: Domain) -> DataFrame:
    """Marginal of a product of factors, summing each attribute out before the next join."""
    pool = list(factors)
    scopes = [set(attrs_of(f)) for f in pool]
    drop = set().union(*scopes) - set(keep)
    for v in elimination_order(scopes, drop, domain):
        touching = [f for f in pool if v in f.columns]
        pool = [f for f in pool if v not in f.columns]
        joined = touching[0]
        for f in touching[1:]:
            joined = factor_product(joined, f, domain)
        pool.append(factor_sum(joined, [v]))
    result = pool[0]
    for f in pool[1:]:
        if attrs_of(f):
            result = factor_product(result, f, domain)
        else:
            result = result.withColumn("value", F.col("value") * f.select("value").scalar())
    return factor_project(result, list(keep))


def tree_factors(
    edges: Sequence[tuple[DataFrame, tuple[str, str]]], root: str
) -> list[DataFrame]:
    """Factors of a tree whose product is its joint: P(root edge) and P(child | parent) tables."""
    placed, out, waiting = {root}, [], list(edges)
    first = True
    while waiting:
        ready = [e for e in waiting if set(e[1]) & placed]
        if not ready:
            raise ValueError("edges do not form one tree")
        for table, (a, b) in ready:
            parent, child = (a, b) if a in placed else (b, a)
            if first:
                out.append(table)
                first = False
            else:
                margin = factor_project(table, [parent]).withColumnRenamed("value", "__m")
                share = F.when(F.col("__m") > 0, F.col("value") / F.col("__m")).otherwise(0.0)
                out.append(
                    table.join(margin, parent).select(parent, child, share.alias("value"))
                )
            placed |= {a, b}
            waiting = [e for e in waiting if e[1] != (a, b)]
    return out


def query_unmeasured_marginal(
    edges: Sequence[tuple[DataFrame, tuple[str, str]]], keep: Sequence[str], domain: Domain
) -> DataFrame:
    """Marginal over attributes that no single edge table holds, by elimination along the tree."""
    return eliminate(tree_factors(edges, edges[0][1][0]), keep, domain)


def full_joint(
    edges: Sequence[tuple[DataFrame, tuple[str, str]]], domain: Domain, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Joint table of a tree, for small domains only."""
    domain.guard(max_cells=max_cells)
    factors = tree_factors(edges, edges[0][1][0])
    joint = factors[0]
    for f in factors[1:]:
        joint = factor_product(joint, f, domain)
    return joint.select(*domain.attrs, "value")


def kron_query(joint: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """Answers of a product query: per axis a table (answer_<axis>, <axis>, coef)."""
    result = joint
    for attr, rows in axes.items():
        keep = [c for c in result.columns if c not in (attr, "value")]
        result = (
            result.join(rows, attr)
            .groupBy(*keep, f"answer_{attr}")
            .agg(F.sum(F.col("value") * F.col("coef")).alias("value"))
        )
    return result


def hierarchy_aggregate(
    cells: DataFrame, children: dict[str, Sequence[str]]
) -> DataFrame:
    """Coarse rows of a clique from its children: sums over the child's attributes.

    Every child gets the coefficient 1/sqrt(number of children), so a record moves the answers
    by at most 1 in L2.
    """
    coef = len(children) ** -0.5
    rows = [
        F.struct(
            F.lit(name).alias("child"),
            F.concat_ws("_", *[F.col(a).cast("string") for a in attrs]).alias("key"),
        )
        for name, attrs in children.items()
    ]
    long = cells.select(F.explode(F.array(*rows)).alias("c"), "value")
    return long.groupBy("c.child", "c.key").agg((F.sum("value") * F.lit(coef)).alias("value"))


def extra_feature_join(
    df: DataFrame, cols: Sequence[str], feature: str, plan: DataFrame
) -> DataFrame:
    """Push P(feature | source) through a plan (source cols, t_<col>..., mass)."""
    counts = df.groupBy(*cols, feature).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*cols).agg(F.sum("__n").alias("__t"))
    share = counts.join(totals, list(cols)).select(
        *cols, feature, (F.col("__n") / F.col("__t")).alias("__p")
    )
    target = [f"t_{c}" for c in cols]
    return (
        plan.join(share, list(cols))
        .groupBy(*target, feature)
        .agg(F.sum(F.col("mass") * F.col("__p")).alias("mass"))
    )
