"""Noise, private selection and sampling, all from keyed hashes.

Floating-point noise is not safe against attacks on the low bits, and a fixed seed is
repeatable, not private: leave ``seed=None`` for a release.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margrid.functions import hashing as H
from margrid.functions.scalars import arctan_ratio
from margrid.operators.ranking import (
    dense_codes,
    hash_order_number,
    key_order_number,
    running_total,
)
from margrid.session import bounded, shuffle_width

# ---------------------------------------------------------------- measurements


def clique_weights(cliques: Sequence[str], weights: Sequence[float] | None = None) -> dict[str, float]:
    """Clique weights scaled to unit L2 norm."""
    w = [1.0] * len(cliques) if weights is None else [float(v) for v in weights]
    norm = math.sqrt(sum(v * v for v in w))
    return {c: v / norm for c, v in zip(cliques, w)}


def gaussian_measure(
    marginals: DataFrame, sigma: float, weights: Mapping[str, float], seed: str | None = None
) -> DataFrame:
    """Noisy marginals: value + N(0, (sigma/w)^2) per cell of (clique, cell, value)."""
    seed = H.fresh_seed(seed)
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    std = F.lit(float(sigma)) / F.element_at(table, F.col("clique"))
    return marginals.select(
        "clique", "cell", (F.col("value") + std * H.gaussian(seed, "clique", "cell")).alias("noisy"), std.alias("stddev"),
    )


def laplace_scale(l1_sensitivity: float, epsilon: float, bounded: bool = False) -> float:
    """Laplace scale for a budget; replacing a record moves the answers twice as far."""
    return l1_sensitivity * (2.0 if bounded else 1.0) / epsilon


def laplace_measure(
    marginals: DataFrame, epsilon: float, seed: str | None = None, l1_sensitivity: float = 1.0, bounded: bool = False
) -> DataFrame:
    """Noisy marginals with Laplace noise; stddev is sqrt(2) times the scale."""
    seed = H.fresh_seed(seed)
    b = laplace_scale(l1_sensitivity, epsilon, bounded)
    return marginals.select(
        "clique", "cell",
        (F.col("value") + F.lit(b) * H.laplace(seed, "clique", "cell")).alias("noisy"),
        F.lit(math.sqrt(2.0) * b).alias("stddev"),
    )


def choose_noise(table: DataFrame, b: str = "b", sigma: str = "sigma") -> DataFrame:
    """Laplace where sqrt(2) b < sigma, Gaussian otherwise."""
    pick = F.when(F.lit(math.sqrt(2.0)) * F.col(b) < F.col(sigma), F.lit("laplace")).otherwise(F.lit("gaussian"))
    return table.withColumn("noise", pick)


def noisy_scores(scores: DataFrame, sigma: float, keys: Sequence[str], seed: str | None = None) -> DataFrame:
    """Scores with Gaussian noise, clipped at 0."""
    seed = H.fresh_seed(seed)
    noisy = F.col("score") + F.lit(float(sigma)) * H.gaussian(seed, *keys)
    return scores.withColumn("score", F.greatest(noisy, F.lit(0.0)))


# ---------------------------------------------------------------- selection


def exponential_mechanism(
    candidates: DataFrame,
    key: str,
    quality: str,
    epsilon: float,
    sensitivity: float = 1.0,
    base: str | None = None,
    seed: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One candidate per group, drawn with probability proportional to base * exp(eps q / 2s).

    Adding Gumbel noise and taking the maximum draws the same law without normalising.
    """
    seed = H.fresh_seed(seed)
    score = F.col(quality) * F.lit(0.5 * epsilon / sensitivity)
    if base:
        score = score + F.log(F.col(base))
    score = score + H.gumbel(seed, *by, key)
    return candidates.groupBy(*by).agg(F.max_by(F.col(key), score).alias(key))


def permute_and_flip(
    candidates: DataFrame, key: str, quality: str, epsilon: float, sensitivity: float = 1.0,
    seed: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """First candidate, in random order, that accepts with probability exp(eps (q - qmax) / 2s)."""
    seed = H.fresh_seed(seed)
    tops = candidates.groupBy(*by).agg(F.max(quality).alias("__top"))
    if by:
        rows = candidates.join(tops, list(by))
    else:
        rows = candidates.withColumn("__top", tops.select("__top").scalar())
    p = F.exp(F.lit(0.5 * epsilon / sensitivity) * (F.col(quality) - F.col("__top")))
    accepted = rows.where(H.uniform(f"{seed}/flip", *by, key) <= p)
    return accepted.groupBy(*by).agg(F.min_by(F.col(key), H.uniform(f"{seed}/order", *by, key)).alias(key))


def pareto_front(points: DataFrame, quality: str, cost: str, by: Sequence[str] = ()) -> DataFrame:
    """Points that no other point beats (higher quality at no more cost, or equal at less).

    Sorted by cost, a point survives when its quality exceeds every cheaper one: a running
    maximum over distinct cost levels instead of comparing all pairs.
    """
    by = list(by)
    best = points.groupBy(*by, cost).agg(F.max(quality).alias("__best"))
    if by:
        w = Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
        levels = best.withColumn("__prior", F.max("__best").over(w))
    else:
        levels = running_total(best, cost, "__best", "__prior", how="max")
    levels = levels.where(F.col("__prior").isNull() | (F.col("__best") > F.col("__prior")))
    front = levels.select(*by, cost, F.col("__best").alias(quality))
    return points.join(front, [*by, cost, quality], "left_semi")


def generalized_scores(
    candidates: DataFrame, key: str, quality: str, sensitivity: str, t: Column
) -> DataFrame:
    """Scores with per-candidate sensitivities: minus the largest normalised gap to the front."""
    front = pareto_front(candidates, quality, sensitivity).select(
        F.col(quality).alias("__q"), F.col(sensitivity).alias("__s")
    ).distinct()
    rivals = front.agg(F.collect_set(F.struct("__q", "__s")).alias("__front")).select("__front").scalar()
    mine = F.col("__t") * F.col(sensitivity) - F.col(quality)
    gaps = F.transform(
        "__rivals",
        lambda r: (mine - (F.col("__t") * r["__s"] - r["__q"])) / (F.col(sensitivity) + r["__s"]),
    )
    rows = candidates.withColumns({"__t": t, "__rivals": rivals})
    return rows.withColumn("score", -F.array_max(gaps)).drop("__t", "__rivals")


def generalized_exponential_mechanism(
    candidates: DataFrame, key: str, quality: str, sensitivity: str, epsilon: float,
    t: float | None = None, base: str | None = None, seed: str | None = None,
) -> DataFrame:
    """Exponential mechanism over the normalised scores; t defaults to 2 ln(2m)/eps for m candidates."""
    if t is None:
        m = candidates.select(F.count(F.lit(1)).cast("double")).scalar()
        threshold = F.lit(2.0) * F.log(m / F.lit(0.5)) / F.lit(float(epsilon))
    else:
        threshold = F.lit(float(t))
    scored = generalized_scores(candidates, key, quality, sensitivity, threshold)
    return exponential_mechanism(scored, key, "score", epsilon, 1.0, base, seed)


# ---------------------------------------------------------------- budgets


def _log_delta(rho: float, eps: float) -> float:
    """log of min over a > 1 of exp((a - 1)(a rho - eps)) (1 - 1/a)^a / (a - 1), the published bound.

    Its derivative vanishes where (2 a - 1) rho - eps + log(1 - 1/a) = 0.  That function rises and is
    concave, and is negative at a = (1 + eps / rho) / 2, so Newton steps from there climb to the root.
    """
    order = max((1 + eps / rho) / 2, 1 + math.exp(-2 * rho - 1))
    for _ in range(200):
        value = (2 * order - 1) * rho - eps + math.log1p(-1 / order)
        step = -value / (2 * rho + 1 / (order * (order - 1)))
        order += step
        if abs(step) <= 1e-14 * order:
            break
    return (order - 1) * (order * rho - eps) + order * math.log1p(-1 / order) - math.log(order - 1)


def _crossing(f, low: float, high: float) -> tuple[float, float]:
    """Narrow a bracket with f(low) <= 0 < f(high) by false position, the stale end's value halved."""
    at_low, at_high = f(low), f(high)
    stale = 0
    for _ in range(200):
        if high - low <= 1e-14 * abs(high) or at_low == 0:
            break
        guess = (low * at_high - high * at_low) / (at_high - at_low)
        if not low < guess < high:
            break
        value = f(guess)
        if value <= 0:
            low, at_low = guess, value
            at_high, stale = (at_high / 2 if stale == -1 else at_high), -1
        else:
            high, at_high = guess, value
            at_low, stale = (at_low / 2 if stale == 1 else at_low), 1
    return low, high


def zcdp_delta(rho: float, eps: float) -> float:
    """Smallest delta such that rho-zCDP implies (eps, delta)-DP."""
    return min(math.exp(_log_delta(rho, eps)), 1.0) if rho > 0 else 0.0


def zcdp_rho(eps: float, delta: float) -> float:
    """Largest rho such that rho-zCDP implies (eps, delta)-DP (0 if delta is 1 or more).

    The simpler bound eps = rho + 2 sqrt(rho log(1/delta)) gives a rho from below.
    """
    if delta >= 1:
        return 0.0
    odds = math.log(1 / delta)
    low = (math.sqrt(eps + odds) - math.sqrt(odds)) ** 2
    high = low
    while _log_delta(high, eps) <= -odds:
        low, high = high, 1.25 * high
    return _crossing(lambda rho: _log_delta(rho, eps) + odds, low, high)[0]


def zcdp_epsilon(rho: float, delta: float) -> float:
    """Smallest eps such that rho-zCDP implies (eps, delta)-DP."""
    if delta >= 1 or rho == 0:
        return 0.0
    odds = math.log(1 / delta)
    high = rho + 2 * math.sqrt(rho * odds)
    low = high
    while low > 1e-12 and _log_delta(rho, low) <= -odds:
        low, high = 0.8 * low, low
    if low <= 1e-12:
        return 0.0
    return -_crossing(lambda neg: _log_delta(rho, -neg) + odds, -high, -low)[0]


@F.pandas_udf(T.DoubleType())
def _rho_udf(eps: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([zcdp_rho(float(e), float(d)) for e, d in zip(eps, delta)])


def zcdp_budget(grid: DataFrame, eps: str = "epsilon", delta: str = "delta") -> DataFrame:
    """rho for each distinct (epsilon, delta) of a budget table, and the noise of a 3-part release."""
    pairs = grid.select(eps, delta).distinct().withColumn("rho", _rho_udf(eps, delta))
    out = grid.join(pairs, [eps, delta])
    return out.withColumn("sigma", F.sqrt(F.lit(3.0) / (F.lit(2.0) * F.col("rho"))))


def budget_ledger(
    spends: DataFrame, owner: str, order: Column, piece: Column, rho: str, limit: float, ties: Sequence[str]
) -> DataFrame:
    """Running spend, remaining budget and acceptance per release of each owner.

    ``piece`` is a coarse, order-preserving cut of ``order`` (a day, a month): totals of earlier
    pieces offset the running sum inside a piece, so an owner with most of the releases is not
    one task.  A release of budget 0 is accepted with infinite noise.
    """
    rows = spends.withColumns({"__o": order, "__p": piece})
    inside = Window.partitionBy(owner, "__p").orderBy("__o", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum(rho).over(inside))
    across = Window.partitionBy(owner).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = spends.withColumn("__p", piece).groupBy(owner, "__p").agg(F.sum(rho).alias("__s"))
    before = sums.select(owner, "__p", F.coalesce(F.sum("__s").over(across), F.lit(0.0)).alias("__before"))
    used = F.col("__before") + F.col("__in")
    out = rows.join(before, [owner, "__p"])
    left = F.lit(float(limit)) - used
    return out.select(
        *spends.columns,
        used.alias("rho_used"),
        left.alias("rho_left"),
        (used <= F.lit(float(limit))).alias("accepted"),
        F.when(F.col(rho) == 0, F.lit(math.inf)).otherwise(F.sqrt(F.lit(0.5) / F.col(rho))).alias("sigma"),
        F.sqrt(F.lit(8.0) * F.col(rho)).alias("epsilon"),
    )


# ---------------------------------------------------------------- sampling


def interval_assign(
    rows: DataFrame, u: str, cells: DataFrame, lo: str, hi: str, buckets: int, cells_bound: int | None = None
) -> DataFrame:
    """Join each row to the one cell whose [lo, hi) holds its u in [0, 1).

    Cells are laid over equal slices of the unit interval and rows meet them by slice number; a
    heavy cell covers many slices, so its rows spread over many keys.  There are at least
    ``buckets`` slices, four per shuffle partition and one per cell, so a slice holds two cells
    or so however many there are.  A known bound on the number of cells (each cell and slice
    adds at most one row) lets a small table be broadcast.
    """
    least = max(buckets, 4 * shuffle_width(rows.sparkSession))
    slices = F.greatest(F.lit(least).cast("bigint"), cells.select(F.count(F.lit(1))).scalar())
    slot = lambda c: F.least(F.floor(F.col(c) * slices), slices - 1)
    covered = cells.where(F.col(hi) > F.col(lo)).withColumn(
        "__slot", F.explode(F.sequence(slot(lo), slot(hi)))
    )
    keyed = rows.withColumn("__slot", slot(u))
    hit = (F.col(u) >= F.col(lo)) & (F.col(u) < F.col(hi))
    if cells_bound is not None:
        covered = bounded(covered, cells_bound + max(least, cells_bound))
    return keyed.join(covered, "__slot").where(hit).drop("__slot")


def weighted_sample(
    cells: DataFrame, order: str, weight: str, rows: DataFrame, key: str, seed: str,
    buckets: int = 1024, trim: bool = True,
) -> DataFrame:
    """One cell per input row, drawn proportional to the cell's weight.

    With ``trim`` cells below half of the uniform share are dropped first and the rest rescaled.
    """
    if trim:
        k = cells.select(F.count(F.lit(1)).cast("double")).scalar()
        total = cells.select(F.sum(weight)).scalar()
        cells = cells.where(F.col(weight) / total >= F.lit(0.5) / k)
    cum = running_total(cells, order, weight, "__before")
    mass = cells.select(F.sum(weight)).scalar()
    top = cells.select(F.max(order)).scalar()
    spans = cum.withColumn("__lo", F.col("__before") / mass).withColumn(
        "__hi", F.when(F.col(order) == top, F.lit(1.0)).otherwise((F.col("__before") + F.col(weight)) / mass)
    )
    drawn = rows.withColumn("__u", H.uniform(seed, key))
    out = interval_assign(drawn, "__u", spans, "__lo", "__hi", buckets)
    return out.drop("__u", "__lo", "__hi", "__before")


def expand_rounded(cells: DataFrame, mass: str) -> DataFrame:
    """Each cell repeated as often as its rounded mass."""
    n = F.bround(F.col(mass), 0).cast("bigint")
    return cells.where(n >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))


def round_counts(
    counts: DataFrame, by: Sequence[str], key: str, value: str, seed: str, total: str | None = None
) -> DataFrame:
    """Whole counts per group: integer parts plus extras drawn without replacement by fraction.

    ``total`` names the wanted group total (default: the rounded sum); values are scaled to it.
    """
    by = list(by)
    want = F.bround(F.sum(value), 0) if total is None else F.max(total)
    sums = counts.groupBy(*by).agg(F.sum(value).alias("__sum"), want.cast("double").alias("__want"))
    joined = counts.join(sums, by) if by else counts.withColumns(
        {c: sums.select(c).scalar() for c in ("__sum", "__want")}
    )
    scaled = F.round(F.col(value) * F.col("__want") / F.col("__sum"), 9)
    parts = joined.withColumn("__x", scaled).withColumn("__int", F.floor("__x"))
    parts = parts.withColumn("__frac", F.col("__x") - F.col("__int"))
    race = F.when(F.col("__frac") > 0, -F.log(H.uniform(seed, *by, key)) / F.col("__frac"))
    w = Window.partitionBy(*by).orderBy(F.col("__race").asc_nulls_last(), key)
    ranked = parts.withColumn("__race", race).withColumn("__rank", F.row_number().over(w))
    ints = parts.groupBy(*by).agg(F.sum("__int").alias("__ints"))
    ranked = ranked.join(ints, by) if by else ranked.withColumn("__ints", ints.select("__ints").scalar())
    extra = (F.col("__rank") <= F.col("__want") - F.col("__ints")).cast("bigint")
    return ranked.select(*counts.columns, (F.col("__int") + extra).cast("bigint").alias("rounded"))


def stratified_kfold(df: DataFrame, label: str, key: str, k: int, seed: str) -> DataFrame:
    """Fold 0..k-1 per row, balanced inside each label by hash order."""
    numbered = hash_order_number(df, [label], H.uniform(seed, key), [key], "__rn")
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % F.lit(k)).cast("int")).drop("__rn")


# ---------------------------------------------------------------- error injection


def inject_missing(
    df: DataFrame, col: str, key: str, fraction: float, seed: str, method: str = "MCAR",
    label: str | None = None, label_value=None,
) -> DataFrame:
    """Blank an exact share of a column: of all rows (MCAR) or of the rows with one label (MAR)."""
    if method == "MNAR":
        return inject_missing_mnar(df, col, key, fraction, seed)
    pool = F.lit(True) if method == "MCAR" else F.col(label).eqNullSafe(F.lit(label_value))
    marked = df.withColumn("__pool", pool)
    n = marked.where("__pool").select(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    numbered = hash_order_number(marked, ["__pool"], H.uniform(seed, key), [key], "__rn")
    gone = F.col("__pool") & (F.col("__rn") <= n)
    return numbered.withColumn(col, F.when(~gone, F.col(col))).select(*df.columns)


def mnar_rates(df: DataFrame, col: str, fraction: float, seed: str) -> DataFrame:
    """Blanking rate per value: random rates, the rarest value balancing the total to ``fraction``."""
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    shares = df.where(F.col(col).isNotNull()).groupBy(col).agg((F.count(F.lit(1)) / n).alias("share"))
    rates = shares.withColumn("rate", H.uniform(f"{seed}/rate", col) * F.lit(fraction))
    last = shares.select(F.min_by(col, F.struct("share", col))).scalar()
    others = rates.where(F.col(col) != last).select(
        F.coalesce(F.sum(F.col("share") * F.col("rate")), F.lit(0.0))
    ).scalar()
    balanced = (F.lit(fraction) - others) / F.col("share")
    return rates.withColumn("rate", F.when(F.col(col) == last, balanced).otherwise(F.col("rate")))


def inject_missing_mnar(df: DataFrame, col: str, key: str, fraction: float, seed: str) -> DataFrame:
    """Blank values with a rate that depends on the value itself."""
    rates = mnar_rates(df, col, fraction, seed).select(F.col(col).alias("__v"), "rate")
    joined = df.join(rates, F.col(col) == F.col("__v"), "left")
    gone = H.uniform(seed, key) < F.coalesce("rate", F.lit(0.0))
    return joined.withColumn(col, F.when(~gone, F.col(col))).select(*df.columns)


def inject_missing_conditional(
    df: DataFrame, col: str, key: str, fraction: float, conditions: Mapping[str, Mapping], seed: str
) -> DataFrame:
    """Blank floor(N * fraction) rows, drawn without replacement with weight atan(sum)/atan(#).

    Repeating weighted coin flips until enough rows are blank draws rows in the order of
    -ln(u)/weight, so the first rows of that order are taken.
    """
    parts = []
    for c, table in conditions.items():
        lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
        parts.append(F.coalesce(F.try_element_at(lookup, F.col(c)).cast("double"), F.lit(0.0)))
    weight = arctan_ratio(sum(parts, F.lit(0.0)), len(conditions))
    n = df.select(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    live = F.col(col).isNotNull() & (F.col("__w") > 0)
    rows = df.withColumn("__w", weight).withColumn("__live", live)
    already = df.select(F.sum(F.col(col).isNull().cast("bigint"))).scalar()
    race = F.when(F.col("__live"), -F.log(H.uniform(seed, key)) / F.col("__w"))
    # 1 - exp(-race) is monotone in race and lies in (0, 1), as the piecewise numbering needs
    numbered = hash_order_number(
        rows, ["__live"], F.coalesce(F.lit(1.0) - F.exp(-race), H.uniform(seed, key)), [key], "__rn"
    )
    gone = F.col("__live") & (F.col("__rn") <= n - already)
    return numbered.withColumn(col, F.when(~gone, F.col(col))).select(*df.columns)


def inject_y_conditioned_noise(
    df: DataFrame, x: str, y: str, key: str, fraction: float, strength: float, seed: str
) -> DataFrame:
    """Rewrite x in a share of rows with draws from softmax(-|k - peak(y)| strength).

    The first y value peaks at the highest x code, the last one at the lowest.
    """
    xs = dense_codes(df.select(x).distinct(), x, "__k").withColumnRenamed(x, "__x")
    ys = dense_codes(df.select(y).distinct(), y, "__i").withColumnRenamed(y, "__y")
    kx, ky = [t.select(F.count(F.lit(1))).scalar() for t in (xs, ys)]
    peak = F.floor((F.lit(1.0) - F.col("__i") / F.greatest(ky - 1, F.lit(1))) * (kx - 1))
    table = xs.agg(F.sort_array(F.collect_list(F.struct("__k", "__x"))).alias("t")).select("t").scalar()
    weight = lambda k: F.exp(-F.abs(k - F.col("__peak")) * F.lit(float(strength)))
    weights = ys.withColumn("__peak", peak).withColumn("__t", table).withColumn(
        "__w", F.transform("__t", lambda s: weight(s["__k"]))
    )
    rows = hash_order_number(df, [], H.uniform(f"{seed}/row", key), [key], "__rn")
    n = df.select(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    joined = rows.join(weights, F.col(y) == F.col("__y")).withColumn("__u", H.uniform(f"{seed}/x", key))
    total = F.aggregate("__w", F.lit(0.0), lambda a, v: a + v)
    upto = lambda i: F.aggregate(F.slice("__w", 1, i + 1), F.lit(0.0), lambda a, v: a + v)
    hit = F.filter("__t", lambda s, i: upto(i) > F.col("__u") * total)
    drawn = F.coalesce(F.get(hit, 0)["__x"], F.element_at("__t", -1)["__x"])
    return joined.withColumn(x, F.when(F.col("__rn") <= n, drawn).otherwise(F.col(x))).select(*df.columns)


def rank_couple_noise(
    df: DataFrame, cols: Sequence[str], ref: str, key: str, seed: str, scale: float = 1.0, fraction: float = 1.0
) -> DataFrame:
    """Add rounded noise to columns, coupled by rank: the largest reference gets the least noise.

    Noise is +-N(mean, sd of the reference) * scale.  Rows are numbered by -reference and by
    noise, and the two numberings meet; ``fraction`` of the rows keep their noise.
    """
    stats = df.agg(F.avg(ref).alias("m"), F.stddev_samp(ref).alias("s"))
    m, s = [stats.select(c).scalar() for c in ("m", "s")]
    sign = F.when(H.uniform(f"{seed}/sign", key) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    noise = F.bround((m + s * H.gaussian(seed, key)) * F.lit(float(scale)) * sign, 0)
    cards = df.select(key, noise.alias("__noise"))
    cards = key_order_number(cards, "__noise", H.uniform(f"{seed}/c", key), [key], "__rm")
    rows = df.withColumn("__ref", -F.col(ref))
    slots = key_order_number(rows, "__ref", H.uniform(f"{seed}/s", key), [key], "__rn")
    joined = slots.join(cards.select("__noise", "__rm"), F.col("__rn") == F.col("__rm"))
    keep = (H.uniform(f"{seed}/mask", key) < fraction).cast("double")
    out = {c: F.col(c) + F.col("__noise") * keep for c in cols}
    return joined.withColumns(out).select(*df.columns)


def rescale_to_domain(noisy: DataFrame, clean: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Map noisy columns linearly back to the clean range, rounded half-even."""
    span = lambda d, c, f: d.select(f(c).cast("double")).scalar()
    out = {}
    for c in cols:
        a, b = span(noisy, c, F.min), span(noisy, c, F.max)
        lo, hi = span(clean, c, F.min), span(clean, c, F.max)
        mapped = F.bround((F.col(c) - a) / (b - a) * (hi - lo) + lo, 0)
        out[c] = F.when(b > a, mapped).otherwise(F.col(c).cast("double"))
    return noisy.withColumns(out)
