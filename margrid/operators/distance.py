"""Distances between two discrete distributions held as tables of cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.operators.encode import quantile_edges
from margrid.operators.marginals import clique_marginals, clique_name, domain_grid
from margrid.operators.ranking import running_total
from margrid.session import bounded, cut

SMOOTH = 1e-12


def distribution(df: DataFrame, cols: Sequence[str], name: str = "p", weight: str | None = None) -> DataFrame:
    """Share of rows (or weight) of each observed cell; NULL keys are left out of the cells."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    counts = df.dropna(subset=list(cols)).groupBy(*cols).agg(n.alias("__n"))
    total = counts.select(F.sum("__n")).scalar()
    return counts.select(*cols, (F.col("__n") / total).alias(name))


def paired(p: DataFrame, q: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells of either side with (p, q), 0 where a side lacks the cell."""
    both = p.join(q, list(cols), "full_outer")
    return both.select(*cols, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def pair_of(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return paired(distribution(a, cols, "p"), distribution(b, cols, "q"), cols)


def tvd(pq: DataFrame) -> DataFrame:
    """Half the L1 distance."""
    return pq.agg((F.lit(0.5) * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tvd"))


def kl(pq: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """sum (p+s) ln((p+s)/(q+s)) over the full grid; cells absent on both sides add exactly 0."""
    p, q = F.col("p") + F.lit(smooth), F.col("q") + F.lit(smooth)
    return pq.agg(F.sum(p * F.log(p / q)).alias("kl"))


def kl_common_support(pq: DataFrame) -> DataFrame:
    """sum p ln(p/q) over cells present on both sides."""
    both = pq.where((F.col("p") > 0) & (F.col("q") > 0))
    return both.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def kl_generalized(pq: DataFrame) -> DataFrame:
    """sum w ln(w/z) - sum w + sum z over cells present on both sides, for any two masses."""
    both = pq.where((F.col("p") > 0) & (F.col("q") > 0))
    term = F.col("p") * F.log(F.col("p") / F.col("q")) - F.col("p") + F.col("q")
    return both.agg(F.sum(term).alias("kl"))


# ---------------------------------------------------------------- kernels and costs


def mmd_rbf(pq: DataFrame, domain: Domain, gamma: float = 1.0) -> DataFrame:
    """sqrt(max(d'Kd, 0)) for d = p - q and K = exp(-gamma |x - y|^2).

    The kernel of a squared distance is a product over attributes, so Kd is one small blur per
    attribute (each cell reaches the codes of that attribute only); cells are never paired.
    Blurred codes are kept only where an observed cell begins with them, so the work follows
    the support and domains of any size are taken.
    """
    d = pq.select(*domain.attrs, (F.col("p") - F.col("q")).alias("value"))
    blurred = d
    for i, attr in enumerate(domain.attrs):
        others = [a for a in domain.attrs if a != attr]
        begin = list(domain.attrs[:i])
        codes = F.sequence(F.lit(0), F.lit(domain[attr] - 1))
        seen = d.select(*begin, F.col(attr).alias("__to")).distinct()
        spread = blurred.withColumn("__to", F.explode(codes)).join(
            bounded(seen, domain.size([*begin, attr])), [*begin, "__to"], "left_semi"
        )
        k = F.exp(F.lit(-gamma) * F.pow(F.col(attr) - F.col("__to"), F.lit(2.0)))
        blurred = (
            spread.groupBy(*others, F.col("__to").alias(attr))
            .agg(F.sum(F.col("value") * k).alias("value"))
        )
    smooth = blurred.withColumnRenamed("value", "__k")
    quad = d.join(smooth, list(domain.attrs)).agg(F.sum(F.col("value") * F.col("__k")).alias("s"))
    return quad.select(F.sqrt(F.greatest(F.col("s"), F.lit(0.0))).alias("mmd"))


def cost_matrix(support: DataFrame, domain: Domain, max_pairs: int = 10_000_000) -> DataFrame:
    """Euclidean distance between all pairs of support cells (src, dst, cost).

    Pairs are laid out by arithmetic on a range over the squared domain and kept where both
    ends are in the support; the squared size is checked first.
    """
    n = domain.size()
    if n * n > max_pairs:
        raise ValueError(f"{n}^2 cell pairs exceed the limit of {max_pairs}")
    grid = support.sparkSession.range(n * n).select(
        F.expr(f"id div {n}L").alias("src"), F.expr(f"id % {n}L").alias("dst")
    )
    cells = support.select(domain.cell(domain.attrs).alias("cell")).distinct()
    grid = grid.join(cells.withColumnRenamed("cell", "src"), "src", "left_semi")
    grid = grid.join(cells.withColumnRenamed("cell", "dst"), "dst", "left_semi")
    square: Column = F.lit(0.0)
    for attr, stride in domain.strides(domain.attrs):
        at = lambda c: F.expr(f"({c} div {stride}L) % {domain[attr]}L")
        square = square + F.pow((at("src") - at("dst")).cast("double"), F.lit(2.0))
    return grid.select("src", "dst", F.sqrt(square).alias("cost"))


def sinkhorn(
    pq: DataFrame, domain: Domain, reg: float = 0.1, smooth: float = 1e-8, tol: float = 1e-6,
    max_rounds: int = 1000, check_every: int = 10, max_pairs: int = 10_000_000,
) -> DataFrame:
    """Entropic transport cost between p and q on the whole domain, cost scaled by its maximum.

    The scalings are tables of cells; a round is two join-and-sum steps, each reading the last
    scaling once.  They are cut every ``check_every`` rounds, where convergence is one number.
    The column ``converged`` says whether the scalings moved by less than ``tol`` at the end; the
    kernel holds all pairs of cells, so ``max_pairs`` has to be raised for domains of over 3,162.
    """
    spark = pq.sparkSession
    grid = domain_grid(spark, domain, domain.attrs)
    size = domain.size()
    cells = grid.join(pq, list(domain.attrs), "left").select(
        *domain.attrs, "cell",
        *[(F.coalesce(c, F.lit(0.0)) + F.lit(smooth)).alias(c) for c in ("p", "q")],
    )
    total = {c: cells.select(F.sum(c)).scalar() for c in ("p", "q")}
    cells = cells.select(
        *domain.attrs, "cell", *[(F.col(c) / total[c]).alias(c) for c in ("p", "q")]
    )
    raw = cost_matrix(cells, domain, max_pairs)
    top = math.sqrt(sum((n - 1) ** 2 for n in domain.sizes)) or 1.0
    kernel = cut(
        raw.select("src", "dst", (F.col("cost") / top).alias("cost")).withColumn(
            "k", F.exp(-F.col("cost") / F.lit(reg))
        )
    )
    cells = cut(cells.select("cell", "p", "q"))

    def half(side: str, meets: str, weights: DataFrame, mass: str) -> DataFrame:
        """mass / (kernel x weights): the next scaling of one side."""
        hit = weights.select(F.col("cell").alias(meets), F.col("w"))
        sums = kernel.join(hit, meets).groupBy(F.col(side).alias("cell")).agg(F.sum(F.col("k") * F.col("w")).alias("__kw"))
        return cells.join(sums, "cell").select("cell", (F.col(mass) / F.col("__kw")).alias("w"))

    v = cells.select("cell", F.lit(1.0 / size).alias("w"))
    u, converged = v, False
    for round_no in range(1, max_rounds + 1):
        u = half("src", "dst", v, "p")
        if round_no % check_every == 0 or round_no == max_rounds:
            u = cut(u)
            v = cut(half("dst", "src", u, "q"))
            wanted = half("src", "dst", v, "p").withColumnRenamed("w", "next")
            gap = F.sum(F.abs(F.col("w") / F.col("next") - 1.0) * F.col("p"))
            converged = u.join(wanted, "cell").join(cells, "cell").agg(gap.alias("gap")).first()["gap"] < tol
            if converged:
                break
        else:
            v = half("dst", "src", u, "q")
    plan = kernel.join(u.select(F.col("cell").alias("src"), F.col("w").alias("u")), "src").join(
        v.select(F.col("cell").alias("dst"), F.col("w").alias("v")), "dst"
    )
    cost = F.sum(F.col("u") * F.col("k") * F.col("v") * F.col("cost"))
    return plan.agg(cost.alias("sinkhorn"), F.lit(converged).alias("converged"))


# ---------------------------------------------------------------- one-dimensional transport


def wasserstein_1d(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First Wasserstein distance of each numeric column: integral of |F - G|.

    Both tables are unpivoted and counted per (column, value) in one pass; running totals give
    F and G at every distinct value, and the gap to the next value is the width.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("double").alias("v")) for c in cols])
        long = df.select(F.explode(cells).alias("m")).where(F.col("m.v").isNotNull())
        counts = long.groupBy("m.attr", "m.v").agg(F.count(F.lit(1)).alias("__n"))
        totals = counts.groupBy("attr").agg(F.sum("__n").alias("__t"))
        return counts.join(totals, "attr").select("attr", "v", (F.col("__n") / F.col("__t")).alias(name))

    gaps = paired(counted(a, "p"), counted(b, "q"), ["attr", "v"])
    gaps = gaps.select("attr", "v", (F.col("p") - F.col("q")).alias("d"))
    run = running_total(gaps, "v", "d", "before", follow="next", by=["attr"])
    width = F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))
    return run.groupBy("attr").agg(F.sum(F.abs(F.col("before") + F.col("d")) * width).alias("w1"))


def wasserstein_heights(a: DataFrame, b: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Distance between the two sets of histogram heights over joint quantile bins.

    Edges are the quantiles of both tables together; empty-width bins are left out, which is
    where the plain histogram would divide by zero.
    """
    value = lambda df: df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    edges = quantile_edges(value(a).unionByName(value(b)), "v", bins)
    literal = F.array(*[F.lit(e) for e in edges])

    def heights(df: DataFrame, name: str) -> DataFrame:
        counts = value(df).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        slot = F.least(F.size(F.filter(literal, lambda x: x <= F.col("v"))), F.lit(len(edges) - 1))
        binned = counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"))
        total = counts.select(F.sum("n")).scalar()
        width = F.element_at(literal, F.col("slot") + 1) - F.element_at(literal, F.col("slot"))
        return binned.select("slot", (F.col("n") / total / width).alias(name))

    # at most `bins` rows on each side from here on
    pair = heights(a, "p").join(heights(b, "q"), "slot", "full_outer").fillna(0.0)
    rows = pair.agg(
        F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("q")).alias("q")
    )
    diff = F.aggregate(
        F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return rows.select((diff / F.size("p")).alias("w1_heights"))


# ---------------------------------------------------------------- workload errors


def workload_error(
    a: DataFrame, b: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], weights: Sequence[float] | None = None
) -> DataFrame:
    """Half L1 distance of the normalised marginals, per clique, with its weight."""
    left = clique_marginals(a, domain, cliques, dense=False).withColumnRenamed("value", "x")
    right = clique_marginals(b, domain, cliques, dense=False).withColumnRenamed("value", "y")
    return marginal_error(left, right, cliques, weights)


def marginal_error(
    left: DataFrame, right: DataFrame, cliques: Sequence[Sequence[str]], weights: Sequence[float] | None = None
) -> DataFrame:
    """Half L1 distance of two long marginal tables (clique, cell, x) and (clique, cell, y)."""
    tx = left.groupBy("clique").agg(F.sum("x").alias("tx"))
    ty = right.groupBy("clique").agg(F.sum("y").alias("ty"))
    both = left.join(right, ["clique", "cell"], "full_outer").join(tx, "clique").join(ty, "clique")
    x = F.coalesce("x", F.lit(0.0)) / F.col("tx")
    y = F.coalesce("y", F.lit(0.0)) / F.col("ty")
    out = both.groupBy("clique").agg((F.lit(0.5) * F.sum(F.abs(x - y))).alias("error"))
    if weights is None:
        return out
    table = F.create_map(*[F.lit(v) for c, w in zip(cliques, weights) for v in (clique_name(c), float(w))])
    return out.withColumn("weight", F.element_at(table, F.col("clique")))


def mean_error(errors: DataFrame) -> DataFrame:
    """Average of the per-clique errors, times the weight where there is one."""
    value = F.col("error") * F.col("weight") if "weight" in errors.columns else F.col("error")
    return errors.agg(F.avg(value).alias("mean_error"))


def marginal_consistency(marginals: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]]) -> DataFrame:
    """Relative L1 disagreement of every two overlapping marginals on their shared attributes.

    Input is long form (clique, cell, value).  Each clique's cells are sent once to each of its
    overlaps, so both members of a pair meet on (pair, shared cell) in one grouped sum.
    """
    cliques = [tuple(c) for c in cliques]
    routes: dict[str, list[Column]] = {clique_name(c): [] for c in cliques}
    for i, r in enumerate(cliques):
        for s in cliques[:i]:
            shared = [a for a in domain.attrs if a in r and a in s]
            if not shared:
                continue
            pair = f"{clique_name(s)}|{clique_name(r)}"
            for member, sign in ((r, 1.0), (s, -1.0)):
                inside = dict(domain.strides(member))
                cell = F.lit(0).cast("bigint")
                for a, stride in domain.strides(shared):
                    cell = cell + F.expr(f"(cell div {inside[a]}L) % {domain[a]}L") * F.lit(stride)
                routes[clique_name(member)].append(
                    F.struct(F.lit(pair).alias("pair"), cell.alias("shared"), F.lit(sign).alias("sign"))
                )
    sends = None
    for name, targets in routes.items():
        if targets:
            hit = F.col("clique") == name
            sends = F.when(hit, F.array(*targets)) if sends is None else sends.when(hit, F.array(*targets))
    long = marginals.select(F.explode(sends).alias("t"), "value")
    cells = long.groupBy("t.pair", "t.shared").agg(
        F.sum(F.col("t.sign") * F.col("value")).alias("d"), F.sum("value").alias("s")
    )
    return cells.groupBy("pair").agg(
        (F.sum(F.abs("d")) / (F.lit(0.5) * F.sum("s"))).alias("disagreement")
    )


def measurement_loss(
    model: DataFrame, measured: DataFrame, norm: str = "l2", scale: str = "sigma", normalize: bool = False,
    total: float | None = None,
) -> DataFrame:
    """Loss of model marginals (clique, cell, value) against (clique, cell, noisy, stddev[, weight]).

    l2 divides by 2 sigma, or by 2 sigma^2 with scale="variance"; l1 divides by sigma.
    ``normalize`` divides by the number of cliques and the total, with a root for l2.
    """
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be l1 or l2")
    both = measured.join(model, ["clique", "cell"], "left")
    w = F.col("weight") if "weight" in measured.columns else F.lit(1.0)
    d = (F.coalesce("value", F.lit(0.0)) - F.col("noisy")) * w
    if norm == "l1":
        term = F.abs(d) / F.col("stddev")
    elif scale == "variance":
        term = F.lit(0.5) * F.pow(d / F.col("stddev"), F.lit(2.0))
    else:
        term = d * d / (F.lit(2.0) * F.col("stddev"))
    out = both.agg(F.sum(term).alias("loss"), F.countDistinct("clique").alias("k"))
    if normalize:
        scaled = F.col("loss") / F.col("k") / F.lit(float(total))
        return out.select((F.sqrt(scaled) if norm == "l2" else scaled).alias("loss"))
    return out.select("loss")


def variation_to_truth(answers: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half the L1 gap of answers to true answers over the true total, per clique."""
    both = truth.withColumnRenamed("value", "y").join(answers, list(keys), "left")
    gap = F.abs(F.coalesce("value", F.lit(0.0)) - F.col("y"))
    return both.groupBy("clique").agg((F.lit(0.5) * F.sum(gap) / F.sum("y")).alias("variation"))
