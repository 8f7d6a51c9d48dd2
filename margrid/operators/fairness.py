"""Fairness and prediction metrics as aggregates over count tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions.hashing import uniform
from margrid.functions.scalars import composite_key
from margrid.functions.tails import chi2_sf
from margrid.operators.ranking import hash_order_number, running_total
from margrid.session import cut


def all_subsets(cols: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for r in range(len(cols) + 1) for c in combinations(cols, r)]


# ---------------------------------------------------------------- group ratios


def rod_by_subset(
    df: DataFrame, protected: str, outcome: str, admissible: Sequence[str], inadmissible: Sequence[str]
) -> DataFrame:
    """Size-weighted min/max ratio of mean outcomes between two protected values, per subset.

    For every subset of the inadmissible columns, groups of (admissible + subset) that hold
    exactly two protected values count; equal means give ratio 1.  All subsets are rolled up
    from one count table.
    """
    base = df.groupBy(*admissible, *inadmissible, protected).agg(
        F.sum(F.col(outcome).cast("double")).alias("__pos"), F.count(F.lit(1)).alias("__n")
    )
    keys = F.array(
        *[
            F.struct(
                F.lit(",".join(s)).alias("subset"),
                composite_key([*admissible, *s], "\x1f").alias("grp"),
            )
            for s in all_subsets(inadmissible)
        ]
    )
    long = base.select(F.explode(keys).alias("__g"), F.col(protected).alias("__p"), "__pos", "__n")
    sides = long.groupBy("__g.subset", "__g.grp", "__p").agg(F.sum("__pos").alias("pos"), F.sum("__n").alias("n"))
    mean = F.col("pos") / F.col("n")
    groups = sides.groupBy("subset", "grp").agg(
        F.count(F.lit(1)).alias("k"), F.min(mean).alias("lo"), F.max(mean).alias("hi"), F.sum("n").alias("n")
    ).where(F.col("k") == 2)
    ratio = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("lo") / F.col("hi"))
    return groups.groupBy("subset").agg((F.sum(ratio * F.col("n")) / F.sum("n")).alias("ratio"))


def rod(
    df: DataFrame, protected: str, outcome: str, admissible: Sequence[str], inadmissible: Sequence[str]
) -> DataFrame:
    """Smallest ratio over all subsets, 1.1 when no group could be compared."""
    by = rod_by_subset(df, protected, outcome, admissible, inadmissible)
    return by.agg(F.least(F.coalesce(F.min("ratio"), F.lit(1.1)), F.lit(1.1)).alias("rod"))


def strata_two_by_two(
    df: DataFrame, protected: str, outcome: str, strata: Sequence[str], min_side: int = 5, shift: float = 0.0
) -> DataFrame:
    """2x2 counts per stratum, ready for pooling.

    Strata need both protected values with more than ``min_side`` rows.  A stratum with only one
    outcome value becomes four equal cells; the others get +1 per cell, after ``shift`` is added
    where a table has a zero.
    """
    cells = df.groupBy(*strata, protected, outcome).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = cells.select(F.min(protected).alias("p0"), F.max(protected).alias("p1"), F.min(outcome).alias("o0"), F.max(outcome).alias("o1"))
    v = {c: sides.select(c).scalar() for c in ("p0", "p1", "o0", "o1")}
    at = lambda p, o: F.sum(
        F.when((F.col(protected) == v[p]) & (F.col(outcome) == v[o]), F.col("n")).otherwise(0.0)
    )
    wide = cells.groupBy(*strata).agg(
        at("p0", "o0").alias("a"), at("p0", "o1").alias("b"), at("p1", "o0").alias("c"), at("p1", "o1").alias("d")
    )
    a, b, c, d = [F.col(k) for k in "abcd"]
    wide = wide.where((a + b > min_side) & (c + d > min_side))
    full = (a + c > 0) & (b + d > 0)
    add = F.when(F.least(a, b, c, d) == 0, F.lit(shift)).otherwise(F.lit(0.0)) + 1.0
    size = a + b + c + d
    pick = lambda k: F.when(full, F.col(k) + add).otherwise(size / 4.0)
    return wide.select(*strata, *[pick(k).alias(k) for k in "abcd"])


def mantel_haenszel_or(
    df: DataFrame, protected: str, outcome: str, strata: Sequence[str], min_side: int = 5, shift: float = 0.0
) -> DataFrame:
    """Pooled odds ratio sum(ad/n)/sum(bc/n) with the 1-dof test that it equals 1.

    One usable stratum or none gives ratio 1.
    """
    t = strata_two_by_two(df, protected, outcome, strata, min_side, shift)
    a, b, c, d = [F.col(k) for k in "abcd"]
    n = a + b + c + d
    var = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1.0))
    out = t.agg(
        F.count(F.lit(1)).alias("strata"),
        (F.sum(a * d / n) / F.sum(b * c / n)).alias("ratio"),
        (F.pow(F.sum(a - (a + b) * (a + c) / n), F.lit(2.0)) / F.sum(var)).alias("stat"),
    )
    many = F.col("strata") > 1
    return out.select(
        "strata",
        F.when(many, F.col("ratio")).otherwise(1.0).alias("odds_ratio"),
        F.when(many, F.col("stat")).otherwise(0.0).alias("stat"),
    )


def with_or_p_value(result: DataFrame) -> DataFrame:
    return result.withColumn("p_value", chi2_sf(F.col("stat"), F.lit(1.0)))


def stratum_odds(
    df: DataFrame, protected: str, outcome: str, strata: Sequence[str], at_least: float = 1.5
) -> DataFrame:
    """Strata whose own odds ratio reaches a threshold."""
    t = strata_two_by_two(df, protected, outcome, strata)
    odds = F.col("a") * F.col("d") / (F.col("b") * F.col("c"))
    return t.select(*strata, odds.alias("odds_ratio")).where(F.col("odds_ratio") >= at_least)


def binarize(df: DataFrame, col: str) -> DataFrame:
    """Rows whose code is 0 or 1."""
    return df.where(F.col(col) < 2)


# ---------------------------------------------------------------- classification


def class_table(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, F1 of class 1 and macro precision, recall and F1 of a binary prediction."""
    t = class_table(df, label, pred, by)
    cell = lambda y, p: F.sum(F.when((F.col(label) == y) & (F.col(pred) == p), F.col("n")).otherwise(0))
    m = t.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn")
    )
    tp, tn, fp, fn = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    n1, n0 = tp + fn, tn + fp
    return m.select(
        *by, "tp", "tn", "fp", "fn",
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        f1.alias("f1"),
        ((f1 + f0) / 2.0).alias("macro_f1"),
        ((ratio(tp, tp + fp) + ratio(tn, tn + fn)) / 2.0).alias("macro_precision"),
        ((ratio(tp, n1) + ratio(tn, n0)) / 2.0).alias("macro_recall"),
        ((f1 * n1 + f0 * n0) / (n1 + n0)).alias("weighted_f1"),
    )


def demographic_parity(df: DataFrame, pred: str, group: str) -> DataFrame:
    """Largest difference of positive rates between groups."""
    rates = df.groupBy(group).agg(F.avg(F.col(pred).cast("double")).alias("rate"))
    return rates.agg((F.max("rate") - F.min("rate")).alias("gap"))


def equalized_odds(df: DataFrame, label: str, pred: str, group: str) -> DataFrame:
    """Larger of the true-positive and false-positive rate gaps between groups."""
    rates = df.groupBy(group, label).agg(F.avg(F.col(pred).cast("double")).alias("rate"))
    gaps = rates.groupBy(label).agg((F.max("rate") - F.min("rate")).alias("gap"))
    return gaps.agg(F.max("gap").alias("gap"))


def auc_table(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC per key with ties counted half: (by, n_pos, n_neg, auc), 0 if a class is empty.

    ``rows`` is (by, s, hit).  Scores are counted per distinct value; the running count of
    negatives below each value is all the ranking that is needed.
    """
    by = list(by)
    t = rows.groupBy(*by, "s").agg(
        F.sum(F.col("hit").cast("double")).alias("pos"), F.sum((~F.col("hit")).cast("double")).alias("neg")
    )
    ranked = running_total(t, "s", "neg", "below", by=by)
    out = ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"),
    )
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.select(
        *by, "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).otherwise(0.0).alias("auc")
    )


def auc_rank(df: DataFrame, score: str, hit: Column) -> DataFrame:
    """AUC of one score column for one class."""
    return auc_table(df.select(F.col(score).cast("double").alias("s"), hit.alias("hit")))


def auc_binary(df: DataFrame, label: str, score: str) -> DataFrame:
    return auc_rank(df, score, F.col(label) == 1).select("auc")


def auc_weighted_ovr(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Support-weighted one-vs-rest AUC; ``scores`` maps each class to its score column."""
    members = F.array(
        *[
            F.struct(
                F.lit(str(value)).alias("cls"),
                F.col(col).cast("double").alias("s"),
                (F.col(label) == value).alias("hit"),
            )
            for value, col in scores.items()
        ]
    )
    out = auc_table(df.select(F.explode(members).alias("m")).select("m.*"), ["cls"])
    return out.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str, thresholds: int = 1000) -> DataFrame:
    """(fpr, tpr) at an even grid of thresholds, repeats dropped, with the two end points.

    A score falls between two thresholds; counts per slot and their reverse running sums give
    every rate at once.
    """
    top = thresholds - 1
    slot = F.floor(F.col(score) * F.lit(top) + F.lit(1e-9)).cast("int")
    counts = df.groupBy(F.greatest(F.least(slot, F.lit(top)), F.lit(-1)).alias("slot")).agg(
        F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.sum((F.col(label) == 0).cast("double")).alias("neg")
    )
    totals = {c: counts.select(F.sum(c)).scalar() for c in ("pos", "neg")}
    w = Window.orderBy(F.desc("slot"))  # at most `thresholds` rows
    rates = counts.select(
        "slot",
        F.try_divide(F.sum("neg").over(w), totals["neg"]).alias("fpr"),
        F.try_divide(F.sum("pos").over(w), totals["pos"]).alias("tpr"),
    )
    ends = df.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    one = df.sparkSession.range(1).select(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return rates.where(F.col("slot") >= 0).select("fpr", "tpr").union(ends).union(one).distinct()


def roc_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area under (fpr, tpr) points, at most one per threshold."""
    w = Window.orderBy("fpr", "tpr")
    steps = points.select(
        (F.col("fpr") - F.lag("fpr").over(w)).alias("dx"), ((F.col("tpr") + F.lag("tpr").over(w)) / 2.0).alias("h")
    )
    return steps.agg(F.sum(F.col("dx") * F.col("h")).alias("auc"))


def prediction_consistency(original: DataFrame, flipped: DataFrame, key: str, pred: str = "prediction") -> DataFrame:
    """Share of rows whose prediction is the same after the protected bit is flipped."""
    other = flipped.select(key, F.col(pred).alias("__flip"))
    return original.join(other, key).agg(
        F.avg((F.col(pred) == F.col("__flip")).cast("double")).alias("consistency")
    )


# ---------------------------------------------------------------- individual fairness

# Normalisers and weights of the record distance.
EDUCATION_SPAN, EDUCATION_WEIGHT = 8.0, 0.15
OCCUPATION_SPAN, OCCUPATION_WEIGHT = 6.0, 0.2
HOURS_RANGE, HOURS_KNEES, HOURS_WEIGHT = 98.0, (20.0, 40.0), 0.1
AGE_RANGE, AGE_LIMIT, AGE_WEIGHT = 73.0, 10.0, 0.15
MARITAL_WEIGHT = 0.04


def hours_gap(a: Column, b: Column) -> Column:
    """Working-hours gap on 0..1: slope 1 up to 20 hours, 2 up to 40, 3 beyond, capped at the range."""
    low, high = HOURS_KNEES
    g = F.abs(a - b)
    bent = F.when(g > high, (g - high) * 3 + (high - low) * 2 + low).when(g > low, (g - low) * 2 + low).otherwise(g)
    return F.least(bent, F.lit(HOURS_RANGE)) / F.lit(HOURS_RANGE)


def age_gap(a: Column, b: Column) -> Column:
    """Age gap on 0..1, 1 beyond ten years."""
    g = F.abs(a - b)
    return F.when(g > AGE_LIMIT, F.lit(1.0)).otherwise(g / F.lit(AGE_RANGE))


def step_gap(a: Column, b: Column, span: float) -> Column:
    """Gap of two ranks of a hierarchy on 0..1."""
    return F.abs(a - b) / F.lit(span)


def record_distance(left: str, right: str) -> Column:
    """Weighted Euclidean distance of two records under the given aliases."""
    pair = lambda c: (F.col(f"{left}.{c}").cast("double"), F.col(f"{right}.{c}").cast("double"))
    parts = [
        F.when(pair("marital")[0] != pair("marital")[1], F.lit(MARITAL_WEIGHT)).otherwise(F.lit(0.0)),
        step_gap(*pair("education"), EDUCATION_SPAN) * EDUCATION_WEIGHT,
        step_gap(*pair("occupation"), OCCUPATION_SPAN) * OCCUPATION_WEIGHT,
        hours_gap(*pair("hours")) * HOURS_WEIGHT,
        age_gap(*pair("age")) * AGE_WEIGHT,
    ]
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def pairwise_fairness(
    df: DataFrame, key: str, group: str, label: str, pairs: int, threshold: float, seed: str
) -> DataFrame:
    """Up to ``pairs`` random pairs of different rows with their distance and violation flag.

    Rows are numbered by hash order; each draw picks two numbers (a repeated draw counts once)
    and the two records join by number, so the cost is the number of draws, never all pairs.
    """
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    numbered = hash_order_number(df, [], uniform(f"{seed}/row", key), [key], "__rn")
    draws = df.sparkSession.range(pairs).select(
        "id",
        (F.floor(uniform(f"{seed}/i", "id") * n) + 1).alias("__i"),
        (F.floor(uniform(f"{seed}/j", "id") * (n - 1)) + 1).alias("__j0"),
    )
    second = F.when(F.col("__j0") >= F.col("__i"), F.col("__j0") + 1).otherwise(F.col("__j0"))
    draws = draws.select(
        F.least("__i", second).cast("bigint").alias("__i"),
        F.greatest("__i", second).cast("bigint").alias("__j"),
    ).distinct()
    a, b = numbered.alias("a"), numbered.alias("b")
    joined = draws.join(a, F.col("__i") == F.col("a.__rn")).join(b, F.col("__j") == F.col("b.__rn"))
    d = record_distance("a", "b")
    bad = (
        (d < threshold)
        & (F.col(f"a.{label}") != F.col(f"b.{label}"))
        & (F.col(f"a.{group}") != F.col(f"b.{group}"))
    )
    return joined.select(
        F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b"), d.alias("distance"), bad.alias("violation")
    )


def fairness_summary(pairs: DataFrame, threshold: float) -> DataFrame:
    """Violation rate and summed severity of the drawn pairs."""
    hit = F.col("violation").cast("double")
    return pairs.agg(
        F.avg(hit).alias("rate"), F.sum(hit * (F.lit(threshold) - F.col("distance"))).alias("severity")
    )


# ---------------------------------------------------------------- neighbours


def _offsets(domain: Domain, scale: dict[str, float], radius: float) -> list[tuple[list[int], float]]:
    """Code differences whose scaled length is within a radius, with that length (metadata)."""
    out: list[tuple[list[int], float]] = [([], 0.0)]
    for attr, size in zip(domain.attrs, domain.sizes):
        grown = []
        for diffs, square in out:
            for d in range(-(size - 1), size):
                total = square + (d / scale[attr]) ** 2
                if total <= radius * radius + 1e-12:
                    grown.append(([*diffs, d], total))
        out = grown
    return [(diffs, round(square**0.5, 9)) for diffs, square in out]


def neighbour_means(df: DataFrame, domain: Domain, label: str, key: str, k: int = 5) -> DataFrame:
    """Per occupied cell the mean label of its k nearest rows (ties by key), after std scaling.

    Rows of one cell share their neighbours, so cells are searched instead of rows, and only the
    k first rows of a cell can matter.  Each round joins the unresolved cells to the cells within
    a growing radius by key; a cell is done when k rows lie within the radius.
    """
    attrs = list(domain.attrs)
    stats = df.agg(*[F.stddev_samp(a).alias(a) for a in attrs]).first()
    scale = {a: stats[a] or 1.0 for a in attrs}
    slim = df.select(*attrs, F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"))
    first = _first_rows(slim, attrs, k)
    cells = slim.select(*attrs).distinct()
    top = sum(((n - 1) / scale[a]) ** 2 for a, n in zip(attrs, domain.sizes)) ** 0.5 + 1e-6
    radius, done = 0.0, None
    while True:
        rows = [(*diffs, dist) for diffs, dist in _offsets(domain, scale, radius)]
        schema = ", ".join([*[f"`d_{a}` int" for a in attrs], "dist double"])
        steps = df.sparkSession.createDataFrame(rows, schema).agg(
            F.collect_list(F.struct("*")).alias("s")
        ).select("s").scalar()
        reach = cells.withColumn("__s", F.explode(steps)).select(
            *attrs,
            *[(F.col(a) + F.col(f"__s.d_{a}")).alias(f"n_{a}") for a in attrs],
            F.col("__s.dist").alias("__dist"),
        )
        near = first.select(*[F.col(a).alias(f"n_{a}") for a in attrs], "__rows")
        hits = reach.join(near, [f"n_{a}" for a in attrs]).select(
            *attrs, F.explode("__rows").alias("__r"), "__dist"
        )
        w = Window.partitionBy(*attrs).orderBy("__dist", "__r.__key")
        best = hits.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
        found = best.groupBy(*attrs).agg(F.avg("__r.__y").alias("near"), F.count(F.lit(1)).alias("__k"))
        full = found if radius >= top else found.where(F.col("__k") >= k)
        full = cut(full.drop("__k"))
        done = full if done is None else done.unionByName(full)
        if radius >= top:
            return done
        cells = cut(cells.join(full, attrs, "left_anti"))
        if cells.isEmpty():
            return done
        radius = min(top, max(2 * radius, 1.0 / max(scale.values())))


def _first_rows(rows: DataFrame, attrs: Sequence[str], k: int) -> DataFrame:
    """The k rows with the smallest keys of each cell, as one array of at most k per cell.

    The bound on row_number is applied map-side as a group limit, so a cell with a third of all
    rows sends at most k rows per task.
    """
    w = Window.partitionBy(*attrs).orderBy("__key")
    kept = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return kept.groupBy(*attrs).agg(F.collect_list(F.struct("__key", "__y")).alias("__rows"))


def knn_consistency(
    df: DataFrame, domain: Domain, label: str, key: str, k: int = 5, max_cells: int = 100_000
) -> DataFrame:
    """1 - mean |y - mean y of the k nearest rows|; a row may be its own neighbour."""
    domain.guard(max_cells=max_cells)
    near = neighbour_means(df, domain, label, key, k)
    counts = df.groupBy(*domain.attrs, F.col(label).cast("double").alias("__y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    both = counts.join(near, list(domain.attrs))
    gap = F.sum(F.col("n") * F.abs(F.col("__y") - F.col("near"))) / F.sum("n")
    return both.agg((F.lit(1.0) - gap).alias("consistency"))
