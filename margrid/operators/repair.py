"""Repair of tables towards conditional independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrid.domain import Constraint
from margrid.functions.hashing import uniform
from margrid.operators.ci import cmi_plain
from margrid.operators.ranking import hash_order_number, key_order_number


def ci_projection(df: DataFrame, c: Constraint, weight: str | None = None) -> DataFrame:
    """Closest conditionally independent table: n_xz n_yz / n_z on the grid of each stratum.

    A rank-one fit of a stratum under KL loss has this closed form.  The x and y sides meet on
    the stratum; the result itself is that grid.
    """
    if not c.z:
        return ci_projection(df.withColumn("__all", F.lit(0)), Constraint.of(c.x, c.y, "__all"), weight).drop("__all")
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    cells = df.dropna(subset=list(c.columns)).groupBy(*c.columns).agg(n.alias("n"))
    z = list(c.z)
    xz = cells.groupBy(*c.x, *z).agg(F.sum("n").alias("n_xz"))
    yz = cells.groupBy(*c.y, *z).agg(F.sum("n").alias("n_yz"))
    nz = cells.groupBy(*z).agg(F.sum("n").alias("n_z"))
    grid = xz.join(yz, z).join(nz, z)
    return grid.select(*c.columns, (F.col("n_xz") * F.col("n_yz") / F.col("n_z")).alias("value"))


def repair_impact(df: DataFrame, c: Constraint) -> DataFrame:
    """Dependence before and after the projection, and the mass that has to move."""
    fixed = ci_projection(df, c)
    before = cmi_plain(df, c).select("cmi").scalar()
    after = cmi_plain(fixed, c, weight="value").select("cmi").scalar()
    counts = df.dropna(subset=list(c.columns)).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))
    both = fixed.join(counts, list(c.columns), "left")
    moved = F.sum(F.abs(F.col("value") - F.coalesce("n", F.lit(0)))) / 2.0
    return both.agg(moved.alias("moved")).select(
        before.alias("cmi_before"), F.abs(F.round(after, 9)).alias("cmi_after"), "moved"
    )


def repair_weights(df: DataFrame, c: Constraint) -> DataFrame:
    """Row weights n_xz n_yz / (n_z n_xyz) that make the weighted rows independent given z."""
    counts = df.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("__n"))
    fixed = ci_projection(df, c)
    ratio = counts.join(fixed, list(c.columns)).select(
        *c.columns, (F.col("value") / F.col("__n")).alias("repaired_weights")
    )
    return df.join(ratio, list(c.columns))


def apply_repair_plan(
    df: DataFrame, cols: Sequence[str], key: str, plan: DataFrame, seed: str
) -> DataFrame:
    """Move rows between cells by a plan (cols, t_<col>..., mass with total 1).

    A source cell sends round(mass * N) rows to each target whose mass exceeds 0.5/N, disjoint
    ranges in target order; which rows go is decided by hash order inside the cell.
    """
    targets = [f"t_{c}" for c in cols]
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(c) == F.col(f"t_{c}"))
    moves = plan.where((F.col("mass") > F.lit(0.5) / n) & ~same).withColumn(
        "__k", F.bround(F.col("mass") * n, 0).cast("bigint")
    )
    w = Window.partitionBy(*cols).orderBy(*targets).rowsBetween(Window.unboundedPreceding, 0)
    ends = moves.withColumn("__end", F.sum("__k").over(w))
    per_source = ends.groupBy(*[F.col(c).alias(f"__s_{c}") for c in cols]).agg(
        F.sort_array(F.collect_list(F.struct("__end", *targets))).alias("__to")
    )
    numbered = hash_order_number(df, cols, uniform(seed, key), [key], "__rn")
    on = F.lit(True)
    for c in cols:
        on = on & (F.col(c) == F.col(f"__s_{c}"))
    joined = numbered.join(per_source, on, "left")
    hit = F.get(F.filter("__to", lambda s: s["__end"] >= F.col("__rn")), 0)
    joined = joined.withColumn("__hit", hit)
    out = {c: F.coalesce(F.col(f"__hit.t_{c}"), F.col(c)) for c in cols}
    return joined.withColumns(out).select(*df.columns, F.col("__hit").isNotNull().alias("moved"))


def top_k_repairs(
    df: DataFrame, cols: Sequence[str], key: str, plan: DataFrame, k: int, seed: str, by: str = "exit"
) -> DataFrame:
    """The k rows to repair first: cells ordered by leaving mass, or by their best single move.

    Cells of equal score are taken together; inside a score rows come in hash order.  With
    by="best" the best target is attached.
    """
    targets = [f"t_{c}" for c in cols]
    if by == "exit":
        same = F.lit(True)
        for c in cols:
            same = same & (F.col(c) == F.col(f"t_{c}"))
        score = plan.groupBy(*cols).agg(
            F.sum(F.when(same, F.lit(0.0)).otherwise(F.col("mass"))).alias("__score")
        )
    else:
        best = F.max(F.struct("mass", *targets))
        score = plan.groupBy(*cols).agg(best.alias("__b")).select(
            *cols, F.col("__b.mass").alias("__score"), *[F.col(f"__b.{t}").alias(t) for t in targets]
        )
    rows = df.join(score, list(cols)).withColumn("__neg", F.round(-F.col("__score"), 12))
    ranked = key_order_number(rows, "__neg", uniform(seed, key), [key], "rank").where(F.col("rank") <= k)
    return ranked.drop("__neg", "__score")
