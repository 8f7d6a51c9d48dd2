"""Iterative fits on tables of cells: raking, multiplicative weights, reweighting, trees.

Every iterate is a table of cells, bounded by the domain.  Its lineage is cut in the reliable
checkpoint folder every few rounds, so a lost executor costs at most those rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.operators.factors import attrs_of, factor_product, factor_project, normalize
from margrid.operators.marginals import (
    clique_cells,
    clique_chunks,
    clique_name,
    clique_sums,
    domain_grid,
)
from margrid.session import cut

CUT_EVERY = 5


# ---------------------------------------------------------------- raking


def ipf_step(table: DataFrame, margin: DataFrame) -> DataFrame:
    """Scale a table (attrs, value) to one target margin (some attrs, target).

    The current sums ride along as a window over the cells, so an iterate is read once and the
    plan grows by one step per margin.
    """
    keys = [c for c in margin.columns if c != "target"]
    attrs = attrs_of(table)
    summed = table.withColumn("__s", F.sum("value").over(Window.partitionBy(*keys)))
    ratio = F.when(F.col("__s") > 0, F.coalesce("target", F.lit(0.0)) / F.col("__s")).otherwise(0.0)
    return summed.join(margin, keys, "left").select(*attrs, (F.col("value") * ratio).alias("value"))


def ipf(table: DataFrame, margins: Sequence[DataFrame], rounds: int = 10) -> DataFrame:
    """Rake a table to several target margins for a number of rounds."""
    table = table.select(*attrs_of(table), "value")
    for i in range(1, rounds + 1):
        for margin in margins:
            table = ipf_step(table, margin)
        if i % CUT_EVERY == 0 and i < rounds:
            table = cut(table)
    return table


# ---------------------------------------------------------------- multiplicative weights


def connected_groups(cliques: Sequence[Sequence[str]], domain: Domain) -> list[tuple[str, ...]]:
    """Attribute sets of cliques that are linked by shared attributes (metadata)."""
    groups: list[set[str]] = []
    for clique in cliques:
        merged = set(clique)
        rest = []
        for g in groups:
            if g & merged:
                merged |= g
            else:
                rest.append(g)
        groups = rest + [merged]
    return [tuple(a for a in domain.attrs if a in g) for g in groups]


def member_cells(
    domain: Domain, groups: Sequence[Sequence[str]], cliques: Sequence[Sequence[str]]
) -> Column:
    """Array of the (clique, ccell) pairs a (grp, cell) row lies in, cliques inside their group."""
    out: Column | None = None
    for g in groups:
        inside = dict(domain.strides(g))
        rows = []
        for c in cliques:
            if set(c) <= set(g):
                cell = F.lit(0).cast("bigint")
                for a, stride in domain.strides(c):
                    cell = cell + F.expr(f"(cell div {inside[a]}L) % {domain[a]}L") * F.lit(stride)
                rows.append(F.struct(F.lit(clique_name(c)).alias("clique"), cell.alias("ccell")))
        hit = F.col("grp") == clique_name(g)
        out = F.when(hit, F.array(*rows)) if out is None else out.when(hit, F.array(*rows))
    return out


def normalize_groups(state: DataFrame) -> DataFrame:
    """Scale each group's table (grp, cell, value) to 1."""
    mass = state.groupBy("grp").agg(F.sum("value").alias("__m"))
    return state.join(mass, "grp").select("grp", "cell", (F.col("value") / F.col("__m")).alias("value"))


def multiplicative_weights(
    measured: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], total: float, rounds: int = 20
) -> DataFrame:
    """One probability table per connected group of measured cliques, as (grp, cell, value).

    Each round multiplies a cell by exp of the summed errors of the measurements it lies in,
    over 2 total, and renormalises; all groups move in the same job.  ``measured`` is
    (clique, cell, noisy) and may hold ``stddev``: errors then count by their precision, the most
    precise measurement by 1.  An iterate is read several times by the next round, so it is cut
    every round.
    """
    groups = connected_groups(cliques, domain)
    names = [clique_name(c) for c in cliques]
    mine = measured.where(F.col("clique").isin(names))
    share = F.lit(1.0)
    if "stddev" in measured.columns:
        best = mine.where(F.col("stddev") > 0).select(F.min("stddev")).scalar()
        share = F.when(F.col("stddev") > 0, F.pow(best / F.col("stddev"), F.lit(2.0))).otherwise(F.lit(1.0))
    target = cut(mine.select("clique", F.col("cell").alias("ccell"), "noisy", share.alias("share")))
    state = clique_chunks(measured.sparkSession, domain, groups).withColumnRenamed("clique", "grp")
    sizes = F.create_map(*[F.lit(v) for g in groups for v in (clique_name(g), 1.0 / domain.size(g))])
    state = state.withColumn("value", F.element_at(sizes, F.col("grp")))
    for _ in range(rounds):
        long = state.select("grp", "cell", "value", F.explode(member_cells(domain, groups, cliques)).alias("m"))
        long = long.select("grp", "cell", "value", "m.clique", "m.ccell")
        hat = long.groupBy("clique", "ccell").agg(F.sum("value").alias("hat"))
        error = target.join(hat, ["clique", "ccell"]).select(
            "clique", "ccell", (F.col("share") * (F.col("noisy") - F.col("hat") * F.lit(float(total)))).alias("err")
        )
        moved = (
            long.join(error, ["clique", "ccell"])
            .groupBy("grp", "cell")
            .agg(F.first("value").alias("v"), F.sum("err").alias("up"))
        )
        raised = F.col("v") * F.exp(F.col("up") / F.lit(2.0 * total))
        state = normalize_groups(cut(moved.select("grp", "cell", raised.alias("value"))))
    return state


def group_table(state: DataFrame, domain: Domain, group: Sequence[str]) -> DataFrame:
    """One group's table with its codes as columns."""
    rows = state.where(F.col("grp") == clique_name(group))
    return rows.select(*domain.decode(group), "value")


# ---------------------------------------------------------------- reweighting rows


def reweight_public(
    public: DataFrame, domain: Domain, measured: DataFrame, cliques: Sequence[Sequence[str]], total: float,
    rounds: int = 20, gain: float = 1e-6,
) -> DataFrame:
    """Weights on the distinct cells of a public table so that its marginals match noisy ones.

    Entropic mirror descent; equal rows share a weight, so cells are iterated.  A step is kept when the
    loss lies under its linear model plus the relative entropy between the weights over the step size,
    else it is taken again with a quarter of the size.  The fit ends when a step gains less than ``gain``
    of the loss, or after ``rounds``.  ``measured`` is
    (clique, cell, noisy, stddev); the result adds ``weight`` (of the cell) and ``row_weight``.
    """
    attrs = list(domain.attrs)
    measured = cut(measured)
    cells = cut(
        public.where(domain.in_range())
        .groupBy(*attrs)
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .withColumn("logw", F.log("n"))
    )

    def scaled(t: DataFrame) -> DataFrame:
        top = t.select(F.max("logw")).scalar()
        mass = t.select(F.sum(F.exp(F.col("logw") - t.select(F.max("logw")).scalar()))).scalar()
        return t.withColumn("logw", F.col("logw") - top - F.log(mass) + F.log(F.lit(float(total))))

    def gradient(t: DataFrame) -> tuple[DataFrame, float]:
        """Cells with their weight and gradient, and the loss."""
        weighted = t.withColumn("__w", F.exp("logw"))
        mu = clique_sums(weighted, domain, cliques, "__w")
        gap = (F.coalesce("value", F.lit(0.0)) - F.col("noisy")) / F.col("stddev")
        diff = cut(
            measured.join(mu, ["clique", "cell"], "left").select("clique", "cell", gap.alias("__d"), "stddev")
        )
        loss = diff.agg((F.lit(0.5) * F.sum(F.col("__d") * F.col("__d"))).alias("l")).first()["l"]
        long = weighted.select(*t.columns, "__w", F.explode(clique_cells(domain, cliques)).alias("__m"))
        grad = (
            long.select(*t.columns, "__w", "__m.clique", "__m.cell")
            .join(diff, ["clique", "cell"])
            .groupBy(*t.columns, "__w")
            .agg(F.sum(F.col("__d") / F.col("stddev")).alias("__g"))
        )
        return cut(grad), loss

    state, loss = gradient(scaled(cells))
    size = 1.0
    for _ in range(rounds):
        before = state.select(*attrs, "__g", F.col("__w").alias("__w0"))
        for _ in range(30):
            moved = state.withColumn("logw", F.col("logw") - F.lit(size) * F.col("__g"))
            trial, trial_loss = gradient(scaled(moved.select(*attrs, "n", "logw")))
            model = before.join(trial.select(*attrs, "__w"), attrs).agg(
                F.sum(F.col("__g") * (F.col("__w") - F.col("__w0"))).alias("linear"),
                F.sum(F.col("__w") * F.log(F.col("__w") / F.col("__w0")) - F.col("__w") + F.col("__w0")).alias("apart"),
            ).first()
            if trial_loss <= loss + model["linear"] + model["apart"] / size:
                break
            size /= 4
        else:
            break
        won, state, loss = loss - trial_loss, trial, trial_loss
        if won <= gain * loss:
            break
        size *= 2
    return state.select(
        *attrs, "n", F.col("__w").alias("weight"), (F.col("__w") / F.col("n")).alias("row_weight")
    )


# ---------------------------------------------------------------- overlapping marginals


def counting_numbers(cliques: Sequence[Sequence[str]], domain: Domain) -> dict[tuple[str, ...], int]:
    """Moebius numbers of the regions: the cliques and all their intersections (metadata)."""
    order = lambda s: tuple(a for a in domain.attrs if a in s)
    regions = {order(c) for c in cliques}
    while True:
        new = {order(set(r) & set(s)) for r in regions for s in regions} - regions - {()}
        if not new:
            break
        regions |= new
    numbers: dict[tuple[str, ...], int] = {}
    for r in sorted(regions, key=len, reverse=True):
        numbers[r] = 1 - sum(numbers[s] for s in numbers if set(r) < set(s))
    return numbers


def kikuchi_marginal(
    tables: dict[tuple[str, ...], DataFrame], domain: Domain, total: float
) -> DataFrame:
    """Joint table proportional to the product of region marginals to their counting numbers."""
    numbers = counting_numbers(list(tables), domain)
    joint = None
    for region, k in numbers.items():
        if k == 0:
            continue
        home = next(c for c in tables if set(region) <= set(c))
        margin = factor_project(tables[home], list(region))
        powered = margin.select(
            *region,
            F.when(F.col("value") > 0, F.pow("value", F.lit(float(k)))).otherwise(0.0).alias("value"),
        )
        joint = powered if joint is None else factor_product(joint, powered, domain)
    return normalize(joint, total)


def extend_marginal(
    tables: dict[tuple[str, ...], DataFrame], attrs: Sequence[str], domain: Domain, total: float, rounds: int = 10
) -> DataFrame:
    """Table of a new clique fitted to what the known cliques say about it.

    Known marginals on the largest overlaps start the table in closed form and are then raked
    in turn; with no overlap the table is uniform.
    """
    attrs = tuple(attrs)
    for clique, table in tables.items():
        if set(attrs) <= set(clique):
            return factor_project(table, list(attrs))
    overlaps = {c: tuple(a for a in attrs if a in c) for c in tables}
    overlaps = {c: o for c, o in overlaps.items() if o}
    kept = {
        o: c for c, o in overlaps.items() if not any(set(o) < set(p) for p in overlaps.values())
    }
    sub = domain.project(attrs)
    cells = sub.guard()
    if not kept:
        spark = next(iter(tables.values())).sparkSession
        return domain_grid(spark, sub, attrs).select(*attrs, F.lit(total / cells).alias("value"))
    parts = {o: factor_project(tables[c], list(o)) for o, c in kept.items()}
    start = kikuchi_marginal(parts, sub, total)
    missing = [a for a in attrs if a not in start.columns]
    if missing:
        flat = domain_grid(start.sparkSession, sub, missing).select(
            *missing, F.lit(1.0 / sub.size(missing)).alias("value")
        )
        start = factor_product(start, flat, sub)
    margins = [t.select(*o, F.col("value").alias("target")) for o, t in parts.items()]
    return ipf(start.select(*attrs, "value"), margins, rounds)


# ---------------------------------------------------------------- trees


@dataclass
class TreeModel:
    """A fitted tree: 1-way table (attr, code, value) and edge table (a, b, ca, cb, value)."""

    domain: Domain
    edges: list[tuple[str, str]]
    ones: DataFrame
    pairs: DataFrame
    total: float

    def one(self, attr: str) -> DataFrame:
        return self.ones.where(F.col("attr") == attr).select(F.col("code").alias(attr), "value")

    def pair(self, a: str, b: str) -> DataFrame:
        rows = self.pairs.where((F.col("a") == a) & (F.col("b") == b))
        return rows.select(F.col("ca").alias(a), F.col("cb").alias(b), "value")

    def edge_tables(self) -> list[tuple[DataFrame, tuple[str, str]]]:
        return [(self.pair(a, b), (a, b)) for a, b in self.edges]

    def components(self) -> list[tuple[str, ...]]:
        singles = [(a,) for a in self.domain.attrs]
        return connected_groups(singles + [tuple(e) for e in self.edges], self.domain)


def fit_tree(
    ones: DataFrame, pairs: DataFrame, edges: Sequence[tuple[str, str]], domain: Domain, total: float,
    rounds: int = 5, spread: float = 1e-9,
) -> TreeModel:
    """Consistent non-negative tree from noisy counts.

    ``ones`` is (attr, code, noisy, stddev), ``pairs`` (a, b, ca, cb, noisy, stddev).  Each
    attribute's estimates, its own and those summed from its edges, are merged by inverse
    variance and clipped; then all edges are raked to their two 1-way tables together, as one
    keyed table.  Without noise the counts come back exactly; with noise this is a closed form,
    not the optimum of a loss over all consistent tables.
    """
    edges = [tuple(e) for e in edges]
    est = ones.select("attr", "code", F.col("noisy").alias("y"), (F.col("stddev") * F.col("stddev")).alias("v"))
    if edges:
        sides = F.array(
            F.struct(F.col("a").alias("attr"), F.col("ca").alias("code")),
            F.struct(F.col("b").alias("attr"), F.col("cb").alias("code")),
        )
        from_pairs = (
            pairs.select("a", "b", F.explode(sides).alias("s"), "noisy", "stddev")
            .groupBy("a", "b", "s.attr", "s.code")
            .agg(F.sum("noisy").alias("y"), F.sum(F.col("stddev") * F.col("stddev")).alias("v"))
            .select("attr", "code", "y", "v")
        )
        est = est.unionByName(from_pairs)
    weight = F.lit(1.0) / F.greatest(F.col("v"), F.lit(1e-18))
    merged = est.groupBy("attr", "code").agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias("y"))
    clipped = merged.withColumn("y", F.greatest("y", F.lit(0.0)))
    sums = clipped.groupBy("attr").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("k"))
    flat = F.lit(float(total)) / F.col("k")
    fitted = cut(
        clipped.join(sums, "attr").select(
            "attr", "code",
            F.when(F.col("s") > 0, F.col("y") * F.lit(float(total)) / F.col("s")).otherwise(flat).alias("value"),
        )
    )
    table = None
    if edges:
        side = lambda x: fitted.select(
            F.col("attr").alias(x), F.col("code").alias(f"c{x}"), F.col("value").alias(f"m{x}")
        )
        table = pairs.join(side("a"), ["a", "ca"]).join(side("b"), ["b", "cb"])
        prior = F.col("ma") * F.col("mb") / F.lit(float(total))
        table = table.select(
            "a", "b", "ca", "cb", "ma", "mb",
            (F.greatest("noisy", F.lit(0.0)) + F.lit(spread) * prior).alias("value"),
        )
        for i in range(1, rounds + 1):
            for x in ("a", "b"):
                w = Window.partitionBy("a", "b", f"c{x}")
                table = table.withColumn("__s", F.sum("value").over(w))
                ratio = F.when(F.col("__s") > 0, F.col(f"m{x}") / F.col("__s")).otherwise(0.0)
                table = table.withColumn("value", F.col("value") * ratio).drop("__s")
            if i % CUT_EVERY == 0 or i == rounds:
                table = cut(table)
        table = table.select("a", "b", "ca", "cb", "value")
    else:
        table = pairs.select("a", "b", "ca", "cb", F.lit(0.0).alias("value")).limit(0)
    return TreeModel(domain, edges, fitted, table, float(total))


def blend_ci(joint: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str], strength: float) -> DataFrame:
    """Mix a joint table (attrs, value) with its conditionally independent projection.

    The result covers the x by y grid of every z, which is the support of the projection.
    """
    if not z:
        return blend_ci(joint.withColumn("__all", F.lit(0)), x, y, ["__all"], strength).drop("__all")
    x, y, z = list(x), list(y), list(z)
    xz = joint.groupBy(*x, *z).agg(F.sum("value").alias("__xz"))
    yz = joint.groupBy(*y, *z).agg(F.sum("value").alias("__yz"))
    zz = joint.groupBy(*z).agg(F.sum("value").alias("__z"))
    full = xz.join(yz, z).join(zz, z).join(joint, [*x, *y, *z], "left")
    flat = F.when(F.col("__z") > 0, F.col("__xz") * F.col("__yz") / F.col("__z")).otherwise(0.0)
    mixed = F.lit(1.0 - strength) * F.coalesce("value", F.lit(0.0)) + F.lit(float(strength)) * flat
    return full.select(*x, *y, *z, mixed.alias("value"))


def cumulative(table: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Per group an array of (key, cum) in key order with the group total, for inverse draws.

    The arrays are as long as one attribute's domain.
    """
    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    steps = table.withColumn("__cum", F.sum(value).over(w))
    return steps.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__cum").alias("cum"), F.col(key).alias("key")))).alias("cdf"),
        F.sum(value).alias("mass"),
    )
