"""Conditional-independence measures and tests X vs Y given Z.

Rows are folded once into distinct (x, y, z) cells; the margins are sums of those cells.  Cells
of the z-grid that never occur are covered in closed form, so no grid is laid out and a hot
stratum is only as wide as its distinct cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margrid.domain import Constraint
from margrid.functions.hashing import fresh_seed, uniform
from margrid.functions.scalars import composite_key
from margrid.functions.tails import chi2_sf, f_sf, t_two_sided
from margrid.operators.fit import ipf
from margrid.operators.ranking import hash_order_number, running_total

SMOOTH = 1e-12
_SEP = "\x1f"
_R_DOF = T.StructType([T.StructField("r", T.DoubleType()), T.StructField("dof", T.DoubleType())])


# ---------------------------------------------------------------- cells and margins


def role_counts(
    df: DataFrame,
    c: Constraint,
    by: Sequence[str] = (),
    weight: str | None = None,
    sep: str = _SEP,
) -> DataFrame:
    """Distinct (by, x, y, z) cells with count n; x, y and z are composite text keys.

    Rows with a NULL in any role are left out, as a value group-by does.
    """
    df = df.dropna(subset=list(c.columns))
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    z = composite_key(c.z, sep) if c.z else F.lit("")
    cells = df.groupBy(*by, *c.columns).agg(n.alias("n"))
    return cells.select(
        *by, composite_key(c.x, sep).alias("x"), composite_key(c.y, sep).alias("y"), z.alias("z"), "n"
    )


def with_margins(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach n_xz, n_yz, n_z and total to each cell by joins on small sums of the cells."""
    by = list(by)
    xz = cells.groupBy(*by, "x", "z").agg(F.sum("n").alias("n_xz"))
    yz = cells.groupBy(*by, "y", "z").agg(F.sum("n").alias("n_yz"))
    z = cells.groupBy(*by, "z").agg(F.sum("n").alias("n_z"))
    out = cells.join(xz, [*by, "x", "z"]).join(yz, [*by, "y", "z"]).join(z, [*by, "z"])
    if by:
        return out.join(cells.groupBy(*by).agg(F.sum("n").alias("total")), by)
    return out.withColumn("total", cells.select(F.sum("n")).scalar())


def prob_join(df: DataFrame, c: Constraint) -> DataFrame:
    """P(xyz) with P(xz), P(yz) and P(z) attached; a missing margin reads 1e-12."""
    m = with_margins(role_counts(df, c))
    p = lambda n: F.coalesce(F.col(n) / F.col("total"), F.lit(SMOOTH))
    return m.select(
        "x", "y", "z",
        p("n").alias("p_xyz"), p("n_xz").alias("p_xz"), p("n_yz").alias("p_yz"), p("n_z").alias("p_z"),
    )


def _entropy_parts(cells: DataFrame, by: Sequence[str], base: Column) -> DataFrame:
    """Per key: total and the sums of n*log(n) over xyz, xz, yz and z cells, in one pass.

    Each cell is exploded to its four margins before one combinable sum.
    """
    text = lambda *cols: F.concat_ws("\x1f", *cols)
    margins = F.array(
        F.struct(F.lit("xyz").alias("m"), text("x", "y", "z").alias("k")),
        F.struct(F.lit("xz").alias("m"), text("x", "z").alias("k")),
        F.struct(F.lit("yz").alias("m"), text("y", "z").alias("k")),
        F.struct(F.lit("z").alias("m"), F.col("z").alias("k")),
    )
    long = cells.select(*by, F.explode(margins).alias("g"), "n")
    sums = long.groupBy(*by, "g.m", "g.k").agg(F.sum("n").alias("n"))
    part = lambda m: F.sum(
        F.when((F.col("m") == m) & (F.col("n") > 0), F.col("n") * F.log("n") / base).otherwise(0.0)
    )
    return sums.groupBy(*by).agg(
        F.sum(F.when(F.col("m") == "z", F.col("n"))).alias("total"),
        *[part(m).alias(f"s_{m}") for m in ("xyz", "xz", "yz", "z")],
    )


def _log_base(base: float | None) -> Column:
    return F.lit(1.0 if base is None else math.log(base))


# ---------------------------------------------------------------- information


def cmi_plain(
    df: DataFrame, c: Constraint, by: Sequence[str] = (), base: float | None = 2, delta: float = 1.0,
    weight: str | None = None,
) -> DataFrame:
    """I(X;Y|Z) from counts without smoothing.

    Uses sum n log n over the four margins, so no margin is joined back to the cells.
    """
    parts = _entropy_parts(role_counts(df, c, by, weight), by, _log_base(base))
    value = (F.col("s_xyz") + F.col("s_z") - F.col("s_xz") - F.col("s_yz")) / F.col("total")
    return parts.select(*by, (F.lit(delta) * value).alias("cmi"))


def cmi_entropy(df: DataFrame, c: Constraint, by: Sequence[str] = ()) -> DataFrame:
    """H(XZ) + H(YZ) - H(XYZ) - H(Z) in bits, clamped at 0, with the four entropies."""
    parts = _entropy_parts(role_counts(df, c, by), by, _log_base(2))
    h = lambda m: F.log2("total") - F.col(f"s_{m}") / F.col("total")
    value = h("xz") + h("yz") - h("xyz") - h("z")
    return parts.select(
        *by,
        *[h(m).alias(f"h_{m}") for m in ("xyz", "xz", "yz", "z")],
        F.greatest(value, F.lit(0.0)).alias("cmi"),
    )


def cmi(
    df: DataFrame, c: Constraint, by: Sequence[str] = (), base: float | None = 2, clamp: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Smoothed I(X;Y|Z): sum p log(p p_z / (p_xz p_yz + 1e-12) + 1e-12)."""
    m = with_margins(role_counts(df, c, by, weight), by)
    p, pxz, pyz, pz = [F.col(n) / F.col("total") for n in ("n", "n_xz", "n_yz", "n_z")]
    term = p * F.log(p * pz / (pxz * pyz + SMOOTH) + SMOOTH) / _log_base(base)
    total = F.sum(term)
    value = F.greatest(total, F.lit(0.0)) if clamp else total
    return m.groupBy(*by).agg(value.alias("cmi"))


def cmi_natural(df: DataFrame, c: Constraint, by: Sequence[str] = ()) -> DataFrame:
    """Smoothed I(X;Y|Z) in nats."""
    return cmi(df, c, by, base=None)


def mutual_information(df: DataFrame, x: Sequence[str], y: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smoothed I(X;Y) in bits: sum p log2((p + 1e-12)/(p_x p_y + 1e-12))."""
    m = with_margins(role_counts(df, Constraint.of(x, y), by), by)
    p, px, py = [F.col(n) / F.col("total") for n in ("n", "n_xz", "n_yz")]
    return m.groupBy(*by).agg(F.sum(p * F.log2((p + SMOOTH) / (px * py + SMOOTH))).alias("mi"))


def cmi_chain_rule(df: DataFrame, c: Constraint) -> DataFrame:
    """I(X; YZ) - I(X; Z) on discrete codes, in nats."""
    a = cmi_plain(df, Constraint.of(c.x, c.y + c.z), base=None).select("cmi").scalar()
    b = cmi_plain(df, Constraint.of(c.x, c.z), base=None)
    return b.select(a.alias("mi_x_yz"), F.col("cmi").alias("mi_x_z"), (a - F.col("cmi")).alias("cmi"))


# ---------------------------------------------------------------- distances to independence


def _product_sums(cells: DataFrame, by: Sequence[str], power: float) -> DataFrame:
    """Per key: sum over the whole x,y-grid of every stratum of q**power.

    q = p_xz p_yz / p_z factors within a stratum, so the grid sum is a product of two sums.
    """
    by = list(by)
    xz = cells.groupBy(*by, "x", "z").agg(F.sum("n").alias("n")).groupBy(*by, "z").agg(
        F.sum(F.pow("n", F.lit(power))).alias("sx"), F.count(F.lit(1)).alias("kx"), F.sum("n").alias("nz")
    )
    yz = cells.groupBy(*by, "y", "z").agg(F.sum("n").alias("n")).groupBy(*by, "z").agg(
        F.sum(F.pow("n", F.lit(power))).alias("sy"), F.count(F.lit(1)).alias("ky")
    )
    grid = F.col("sx") * F.col("sy") / F.pow("nz", F.lit(power))
    return xz.join(yz, [*by, "z"]).groupBy(*by).agg(
        F.sum(grid).alias("q_all"), F.sum(F.col("kx") * F.col("ky")).alias("grid_cells")
    )


def _with_grid(parts: DataFrame, grid: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return parts.join(grid, list(by))
    return parts.withColumns({c: grid.select(c).scalar() for c in grid.columns})


def ci_tvd(df: DataFrame, c: Constraint, norm: str = "L1", half: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Distance of P(xyz) from P(xz)P(yz)/P(z): half L1, or L2 as sqrt(sum d^2 + 1e-12)."""
    cells = role_counts(df, c, by)
    m = with_margins(cells, by)
    p = F.col("n") / F.col("total")
    q = F.col("n_xz") * F.col("n_yz") / F.col("n_z") / F.col("total")
    if norm == "L1":
        out = m.groupBy(*by).agg((F.sum(F.abs(p - q)) + F.lit(1.0) - F.sum(q)).alias("d"))
        return out.select(*by, (F.col("d") * F.lit(0.5 if half else 1.0)).alias("tvd"))
    if norm != "L2":
        raise ValueError("norm must be L1 or L2")
    seen = m.groupBy(*by).agg(F.sum(p * p - 2 * p * q).alias("s"), F.max("total").alias("total"))
    out = _with_grid(seen, _product_sums(cells, by, 2.0), by)
    square = F.col("s") + F.col("q_all") / F.col("total") / F.col("total")
    return out.select(*by, F.sqrt(F.greatest(square, F.lit(0.0)) + SMOOTH).alias("tvd"))


def ci_hellinger(df: DataFrame, c: Constraint, by: Sequence[str] = (), floor: float = 1e-10) -> DataFrame:
    """sqrt(sum (sqrt p - sqrt q)^2 + 1e-12)/sqrt 2 over the observed grid of each stratum.

    Probabilities are floored at 1e-10; an absent cell therefore adds (1e-5 - sqrt q)^2, summed
    in closed form from the grid sums of q and sqrt q.
    """
    cells = role_counts(df, c, by)
    m = with_margins(cells, by)
    lo = F.lit(floor)
    p = F.greatest(F.col("n") / F.col("total"), lo)
    q = F.greatest(F.col("n_xz") / F.col("total"), lo) * F.greatest(F.col("n_yz") / F.col("n_z"), lo)
    seen = m.groupBy(*by).agg(
        F.sum(F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2.0))).alias("s"),
        F.sum(q).alias("q_seen"),
        F.sum(F.sqrt(q)).alias("r_seen"),
        F.count(F.lit(1)).alias("k"),
        F.max("total").alias("total"),
    )
    out = _with_grid(seen, _product_sums(cells, by, 0.5), by)
    root = math.sqrt(floor)
    absent = (
        F.lit(floor) * (F.col("grid_cells") - F.col("k"))
        - F.lit(2 * root) * (F.col("q_all") / F.sqrt("total") - F.col("r_seen"))
        + (F.lit(1.0) - F.col("q_seen"))
    )
    value = F.sqrt(F.greatest(F.col("s") + absent, F.lit(0.0)) + SMOOTH) / F.lit(math.sqrt(2.0))
    return out.select(*by, value.alias("hellinger"))


def ci_l1_counts(df: DataFrame, c: Constraint, by: Sequence[str] = ()) -> DataFrame:
    """Sum of |n_xyz - n_xz n_yz / n_z| over the grid of each stratum."""
    m = with_margins(role_counts(df, c, by), by)
    e = F.col("n_xz") * F.col("n_yz") / F.col("n_z")
    value = F.sum(F.abs(F.col("n") - e)) + F.max("total") - F.sum(e)
    return m.groupBy(*by).agg(value.alias("l1"))


# ---------------------------------------------------------------- stratified tests


def _strata(df: DataFrame, c: Constraint, by: Sequence[str], terms: dict[str, Column]) -> DataFrame:
    """Per stratum: sizes of its observed table, sums of the given terms, and its smallest cell."""
    m = with_margins(role_counts(df, c, by), by)
    m = m.withColumn("e", F.col("n_xz") * F.col("n_yz") / F.col("n_z"))
    corner = F.min(F.struct("x", "y", "n", "n_xz", "n_yz", "n_z"))
    cells = m.groupBy(*by, "z").agg(
        corner.alias("corner"), *[F.sum(t).alias(name) for name, t in terms.items()]
    )
    rows = m.select(*by, "z", "x").distinct().groupBy(*by, "z").agg(F.count("x").alias("rows"))
    cols = m.select(*by, "z", "y").distinct().groupBy(*by, "z").agg(F.count("y").alias("cols"))
    keys = [*by, "z"]
    return cells.join(rows, keys).join(cols, keys).where((F.col("rows") > 1) & (F.col("cols") > 1))


def _two_by_two() -> tuple[list[Column], list[Column]]:
    """Observed and expected counts of a 2x2 stratum, all four cells from one corner."""
    o, r, k, n = [F.col(f"corner.{f}") for f in ("n", "n_xz", "n_yz", "n_z")]
    observed = [o, r - o, k - o, n - r - k + o]
    expected = [r * k / n, r * (n - k) / n, (n - r) * k / n, (n - r) * (n - k) / n]
    return observed, expected


def _stratified(
    df: DataFrame, c: Constraint, by: Sequence[str], term: Column, general, corrected, yates: bool, name: str
) -> DataFrame:
    s = _strata(df, c, by, {"t": term})
    small = (F.col("rows") == 2) & (F.col("cols") == 2)
    stat = F.when(small, corrected()).otherwise(general) if yates else general
    return s.groupBy(*by).agg(
        F.sum(stat).alias(name),
        F.sum((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
        F.count(F.lit(1)).alias("strata"),
    )


def _pull(o: Column, e: Column) -> Column:
    """Continuity correction: the observed count moves by up to one half towards the expected."""
    d = e - o
    return o + F.signum(d) * F.least(F.lit(0.5), F.abs(d))


def chi2_stratified(df: DataFrame, c: Constraint, by: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """Chi-square summed over strata that have at least two rows and two columns.

    A stratum's statistic is sum o^2/e - n, so cells that never occur need no row of their own.
    """
    def corrected() -> Column:
        obs, exp = _two_by_two()
        return sum((F.pow(_pull(o, e) - e, F.lit(2.0)) / e for o, e in zip(obs, exp)), F.lit(0.0))

    general = F.col("t") - F.col("corner.n_z")
    term = F.col("n") * F.col("n") / F.col("e")
    return _stratified(df, c, by, term, general, corrected, yates, "chi2")


def _xlogx(o: Column, e: Column) -> Column:
    return F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))


def g_stratified(df: DataFrame, c: Constraint, by: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """Log-likelihood ratio 2 sum o ln(o/e) summed over strata."""
    def corrected() -> Column:
        obs, exp = _two_by_two()
        return sum((2 * _xlogx(_pull(o, e), e) for o, e in zip(obs, exp)), F.lit(0.0))

    term = 2 * _xlogx(F.col("n"), F.col("e"))
    return _stratified(df, c, by, term, F.col("t"), corrected, yates, "g")


def modified_loglik_test(df: DataFrame, c: Constraint, by: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """Power divergence with the modified log-likelihood, 2 sum e ln(e/o) over non-empty cells."""
    def part(o: Column, e: Column) -> Column:
        return F.when((o > 0) & (e > 0), 2 * e * F.log(e / o)).otherwise(F.lit(0.0))

    def corrected() -> Column:
        obs, exp = _two_by_two()
        return sum((part(_pull(o, e), e) for o, e in zip(obs, exp)), F.lit(0.0))

    return _stratified(df, c, by, part(F.col("n"), F.col("e")), F.col("t"), corrected, yates, "stat")


def with_p_value(test: DataFrame, stat: str) -> DataFrame:
    """Append the chi-square upper tail of a (stat, dof) result."""
    return test.withColumn("p_value", chi2_sf(F.col(stat), F.col("dof").cast("double")))


# ---------------------------------------------------------------- permutations


def permute_within_strata(
    df: DataFrame, y: Sequence[str], z: Sequence[str], key: str, seed: str
) -> DataFrame:
    """Rows with their y values shuffled inside each z stratum.

    Both sides are numbered inside the stratum by independent hashes and meet on the number.
    """
    slots = hash_order_number(df.drop(*y), z, uniform(f"{seed}/slot", key), [key], "__rn")
    cards = hash_order_number(df.select(*y, *z, key), z, uniform(f"{seed}/card", key), [key], "__rm")
    cards = cards.select(*y, *[F.col(c).alias(f"__z{i}") for i, c in enumerate(z)], "__rm")
    on = F.col("__rn") == F.col("__rm")
    for i, c in enumerate(z):
        on = on & F.col(c).eqNullSafe(F.col(f"__z{i}"))
    return slots.join(cards, on).select(*df.columns)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Marked items among ``draws`` out of good+bad; exact inversion where numpy's sampler stops."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mean = draws * (good / n)
    sd = math.sqrt(mean * (bad / n) * ((n - draws) / max(n - 1, 1))) + 1.0
    lo = max(0, draws - bad, int(mean - 12 * sd))
    hi = min(good, draws, int(mean + 12 * sd))
    k = np.arange(lo, hi, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return lo + int(np.searchsorted(cdf, rng.random() * cdf[-1]))


_BLOCK = 25


def _shuffled_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    """Random contingency tables with the margins of a stratum, one per permutation of a block."""
    z, block, rounds = pdf["z"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["rounds"].iloc[0])
    rng = np.random.default_rng(int(pdf["h"].iloc[0]) & (2**63 - 1))
    xs, ys = (pdf[pdf["side"] == s].sort_values("k") for s in ("x", "y"))
    needs, sizes = ([int(round(v)) for v in t["n"]] for t in (xs, ys))
    x_keys, y_keys = xs["k"].to_list(), ys["k"].to_list()
    out = []
    for b in range(block * _BLOCK, min((block + 1) * _BLOCK, rounds)):
        left = list(sizes)
        for x, need in zip(x_keys, needs):
            pool = sum(left)
            for j, y in enumerate(y_keys):
                pool -= left[j]
                take = _hypergeometric(rng, left[j], pool, need) if need and left[j] else 0
                if take:
                    out.append((b, x, y, z, float(take)))
                    left[j] -= take
                    need -= take
    return pd.DataFrame(out, columns=["b", "x", "y", "z", "n"])


def permutation_test(
    df: DataFrame, c: Constraint, rounds: int = 100, seed: str | None = None
) -> DataFrame:
    """Permutation test of I(X;Y|Z): observed value, null summary and p = (#{T >= T_obs}+1)/(B+1).

    Shuffling y inside a stratum only matters through the table of counts, whose law given the
    margins is multivariate hypergeometric; so each stratum draws its tables from its
    margins, a block of rounds per group, and the rows of a hot stratum are never moved.
    """
    seed = fresh_seed(seed)
    cells = role_counts(df, c)
    xs = cells.groupBy("z", F.col("x").alias("k")).agg(F.sum("n").alias("n"))
    ys = cells.groupBy("z", F.col("y").alias("k")).agg(F.sum("n").alias("n"))
    sides = xs.withColumn("side", F.lit("x")).unionByName(ys.withColumn("side", F.lit("y")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // _BLOCK)))
    draws = (
        sides.withColumn("block", blocks)
        .withColumns({"h": F.xxhash64(F.lit(seed), F.col("block"), F.col("z")), "rounds": F.lit(rounds)})
        .groupBy("block", "z")
        .applyInPandas(_shuffled_tables, "b int, x string, y string, z string, n double")
    )
    null = _cmi_of_cells(draws, ["b"])
    observed = _cmi_of_cells(cells, []).select("cmi").scalar()
    slack = F.lit(1e-12)
    return null.withColumn("observed", observed).agg(
        F.max("observed").alias("observed"),
        F.avg("cmi").alias("null_mean"),
        F.min("cmi").alias("null_min"),
        F.max("cmi").alias("null_max"),
        F.stddev_pop("cmi").alias("null_std"),
        ((F.sum((F.col("cmi") + slack >= F.col("observed")).cast("int")) + 1) / F.lit(rounds + 1.0)).alias("p_value"),
    )


def _cmi_of_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    parts = _entropy_parts(cells, by, _log_base(2))
    value = (F.col("s_xyz") + F.col("s_z") - F.col("s_xz") - F.col("s_yz")) / F.col("total")
    return parts.select(*by, F.greatest(value, F.lit(0.0)).alias("cmi"))


# ---------------------------------------------------------------- correlation and residual tests


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, rank) with ties sharing their average rank."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, col, "n")
    return ranked.select(col, (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


@F.pandas_udf(_R_DOF)
def _partial_r(moments: pd.Series, n: pd.Series, d: pd.Series) -> pd.DataFrame:
    out = []
    for flat, rows, size in zip(moments, n, d):
        cov = np.asarray(flat, dtype=float).reshape(int(size), int(size))
        inv = np.linalg.pinv(cov)
        out.append((-inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1]), rows - 2 - (size - 2)))
    return pd.DataFrame(out, columns=["r", "dof"])


def partial_spearman(df: DataFrame, c: Constraint) -> DataFrame:
    """Spearman correlation of X and Y codes controlling for Z, with a two-sided t tail.

    Ranks are attached to distinct cells; the covariance matrix is one aggregate.
    """
    z = list(c.z)
    cells = (
        df.dropna(subset=list(c.columns))
        .groupBy(composite_key(c.x).alias("__x"), composite_key(c.y).alias("__y"), *z)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cols = ["__x", "__y", *z]
    base = cells
    for i, col in enumerate(cols):
        counts = base.groupBy(col).agg(F.sum("n").alias("m"))
        ranked = running_total(counts, col, "m").select(
            col, (F.col("before") + (F.col("m") + 1) / 2.0).alias(f"r{i}")
        )
        cells = cells.join(ranked, col)
    total = F.sum("n")
    mean = [F.sum(F.col("n") * F.col(f"r{i}")) / total for i in range(len(cols))]
    moments = F.array(
        *[
            F.sum(F.col("n") * F.col(f"r{i}") * F.col(f"r{j}")) / total - mean[i] * mean[j]
            for i in range(len(cols))
            for j in range(len(cols))
        ]
    )
    row = cells.agg(moments.alias("m"), total.cast("double").alias("n"))
    out = row.select(_partial_r("m", "n", F.lit(float(len(cols)))).alias("t")).select("t.*")
    t = F.col("r") * F.sqrt(F.col("dof") / F.greatest(F.lit(1e-300), 1 - F.col("r") * F.col("r")))
    return out.withColumn("p_value", t_two_sided(t, F.col("dof")))


@F.pandas_udf(T.DoubleType())
def _pillai(moments: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    out = []
    for flat, a, b in zip(moments, dx, dy):
        a, b = int(a), int(b)
        s = np.asarray(flat, dtype=float).reshape(a + b, a + b)
        sxx, syy, sxy = s[:a, :a], s[a:, a:], s[:a, a:]
        out.append(float(np.trace(np.linalg.pinv(sxx) @ sxy @ np.linalg.pinv(syy) @ sxy.T)))
    return pd.Series(out)


def pillai_from_residuals(rows: DataFrame, rx: Sequence[str], ry: Sequence[str], n: str) -> DataFrame:
    """Pillai trace of two residual blocks with the F approximation, from one covariance aggregate."""
    cols = [*rx, *ry]
    total = F.sum(n)
    mean = {c: F.sum(F.col(n) * F.col(c)) / total for c in cols}
    moments = F.array(
        *[
            F.sum(F.col(n) * F.col(a) * F.col(b)) / total - mean[a] * mean[b]
            for a in cols
            for b in cols
        ]
    )
    row = rows.agg(moments.alias("m"), total.cast("double").alias("n"))
    k, dx, dy = min(len(rx), len(ry)), len(rx), len(ry)
    out = row.withColumn("trace", _pillai("m", F.lit(float(dx)), F.lit(float(dy))))
    df1 = F.lit(float(dx * dy))
    df2 = F.lit(float(k)) * (F.col("n") - 1 + k - dx - dy)
    f = (F.col("trace") / df1) * (df2 / (F.lit(float(k)) - F.col("trace")))
    return out.select("trace", f.alias("f"), df1.alias("df1"), df2.alias("df2")).withColumn(
        "p_value", f_sf("f", "df1", "df2")
    )


def pillai_residual_test(df: DataFrame, c: Constraint, x_values: Sequence[str], y_values: Sequence[str]) -> DataFrame:
    """Residualise one-hot X and Y on Z and test their association.

    The predictor is the saturated one, P(x|z) = n_xz/n_z, so the residuals live on distinct
    cells; ``learn.pillai_logistic`` uses fitted probabilities instead.
    """
    m = with_margins(role_counts(df, c))
    xz = m.select("x", "z", (F.col("n_xz") / F.col("n_z")).alias("p")).distinct()
    yz = m.select("y", "z", (F.col("n_yz") / F.col("n_z")).alias("p")).distinct()
    share = lambda t, key, v: F.sum(F.when(F.col(key) == v, F.col("p")).otherwise(0.0))
    xs, ys = list(x_values)[:-1], list(y_values)[:-1]
    px = xz.groupBy("z").agg(*[share(xz, "x", v).alias(f"px{i}") for i, v in enumerate(xs)])
    py = yz.groupBy("z").agg(*[share(yz, "y", v).alias(f"py{i}") for i, v in enumerate(ys)])
    rows = m.join(px, "z").join(py, "z")
    one = lambda key, v: (F.col(key) == v).cast("double")
    rows = rows.select(
        "n",
        *[(one("x", v) - F.col(f"px{i}")).alias(f"rx{i}") for i, v in enumerate(xs)],
        *[(one("y", v) - F.col(f"py{i}")).alias(f"ry{i}") for i, v in enumerate(ys)],
    )
    return pillai_from_residuals(
        rows, [f"rx{i}" for i in range(len(xs))], [f"ry{i}" for i in range(len(ys))], "n"
    )


# ---------------------------------------------------------------- rankings of attributes


def rank_ci_sets(df: DataFrame, attr: str, target: str, pool: Iterable[Sequence[str]]) -> DataFrame:
    """I(attr; target | S) in bits for every conditioning set S of the pool.

    All sets are counted in one pass: a row of the joint count table is exploded to one cell per
    set, and the sets stay a grouping key throughout.
    """
    sets = [tuple(s) for s in pool]
    used = sorted({a for s in sets for a in s})
    joint = df.dropna(subset=[attr, target, *used]).groupBy(attr, target, *used).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    keyed = F.array(
        *[F.struct(F.lit(",".join(s)).alias("given"), composite_key(s).alias("z")) for s in sets]
    )
    cells = (
        joint.select(
            F.col(attr).cast("string").alias("x"), F.col(target).cast("string").alias("y"),
            F.explode(keyed).alias("g"), "n",
        )
        .groupBy("g.given", "x", "y", "g.z")
        .agg(F.sum("n").alias("n"))
    )
    parts = _entropy_parts(cells, ["given"], _log_base(2))
    value = (F.col("s_xyz") + F.col("s_z") - F.col("s_xz") - F.col("s_yz")) / F.col("total")
    return parts.select(F.lit(attr).alias("attr"), "given", value.alias("cmi")).orderBy(F.desc("cmi"), "given")


def rank_mutual_information(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """I(column; target) in nats for each column, highest first, from one unpivoted count."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("x")) for c in cols]
    )
    cells = (
        df.select(F.explode(pairs).alias("g"), F.col(target).cast("string").alias("y"))
        .groupBy("g.attr", "g.x", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .withColumn("z", F.lit(""))
    )
    parts = _entropy_parts(cells, ["attr"], _log_base(None))
    value = (F.col("s_xyz") + F.col("s_z") - F.col("s_xz") - F.col("s_yz")) / F.col("total")
    return parts.select("attr", value.alias("mi")).orderBy(F.desc("mi"), "attr")


# ---------------------------------------------------------------- log-linear models


def loglinear_test(df: DataFrame, c: Constraint, rounds: int = 20) -> DataFrame:
    """Likelihood-ratio test of X and Y independent given Z against the no-three-way model.

    The null fit n_xz n_yz / n_z is closed form; the alternative is raked to its three margins.
    """
    cells = role_counts(df, c)
    xy = cells.groupBy("x", "y").agg(F.sum("n").alias("target"))
    xz = cells.groupBy("x", "z").agg(F.sum("n").alias("target"))
    yz = cells.groupBy("y", "z").agg(F.sum("n").alias("target"))
    # every observed (x, y) in every stratum that holds both sides; other cells have fit 0
    start = xy.select("x", "y").join(xz.select("x", "z"), "x").join(yz.select("y", "z"), ["y", "z"], "left_semi")
    alt = ipf(start.select("x", "y", "z", F.lit(1.0).alias("value")), [xy, xz, yz], rounds)
    null = with_margins(cells).withColumn("e", F.col("n_xz") * F.col("n_yz") / F.col("n_z"))
    both = null.join(alt, ["x", "y", "z"])
    stat = F.lit(2.0) * F.sum(F.col("n") * F.log(F.col("value") / F.col("e")))
    kx = cells.select(F.countDistinct("x")).scalar()
    ky = cells.select(F.countDistinct("y")).scalar()
    out = both.agg(stat.alias("lr")).select("lr", ((kx - 1) * (ky - 1)).alias("dof"))
    return out.withColumn("p_value", chi2_sf(F.greatest("lr", F.lit(0.0)), F.col("dof").cast("double")))
