"""Choice of attribute pairs: scores as tables, trees from the few collected scores."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions.hashing import fresh_seed
from margrid.operators.marginals import joint_counts

Edge = tuple[str, str]


def pair_counts(df: DataFrame, domain: Domain, pairs: Sequence[Edge] | None = None, weight: str | None = None) -> DataFrame:
    """Counts of all requested attribute pairs as (a, b, ca, cb, n), observed cells only."""
    pairs = list(pairs or combinations(domain.attrs, 2))
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("ca"), F.col(b).alias("cb"))
            for a, b in pairs
        ]
    )
    joint = joint_counts(df, domain, weight)
    long = joint.select(F.explode(rows).alias("p"), "n")
    return long.groupBy("p.a", "p.b", "p.ca", "p.cb").agg(F.sum("n").alias("n"))


def single_counts(df: DataFrame, domain: Domain, weight: str | None = None) -> DataFrame:
    """Counts of every attribute's codes as (attr, code, n), observed codes only."""
    rows = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("code")) for a in domain.attrs])
    long = joint_counts(df, domain, weight).select(F.explode(rows).alias("p"), "n")
    return long.groupBy("p.attr", "p.code").agg(F.sum("n").alias("n"))


def pair_grid(df: DataFrame, domain: Domain, pairs: Sequence[Edge]) -> DataFrame:
    """All cells of the given pairs as (a, b, ca, cb)."""
    rows = [(a, b, domain[a], domain[b]) for a, b in pairs]
    sizes = df.sparkSession.createDataFrame(rows, "a string, b string, na int, nb int")
    return sizes.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.col("na") * F.col("nb") - 1)).alias("cell")).select(
        "a", "b", F.expr("cast(cell div nb as int)").alias("ca"), F.expr("cast(cell % nb as int)").alias("cb")
    )


def pair_scores(pairs: DataFrame, ones: DataFrame, total: float | None = None) -> DataFrame:
    """L1 distance of each pair's counts from the product of its 1-way tables, as (a, b, score).

    ``ones`` is (attr, code, value).  Cells without rows add their product mass, which is the
    attribute masses' product less what the seen cells carry, so no grid is laid out.
    """
    side = lambda x: ones.select(F.col("attr").alias(x), F.col("code").alias(f"c{x}"), F.col("value").alias(f"m{x}"))
    mass = ones.groupBy("attr").agg(F.sum("value").alias("m"))
    side_mass = lambda x: mass.select(F.col("attr").alias(x), F.col("m").alias(f"t{x}"))
    seen = pairs.join(side("a"), ["a", "ca"]).join(side("b"), ["b", "cb"])
    if total is None:
        seen = seen.join(side_mass("a"), "a")
        scale = F.col("ta")
    else:
        scale = F.lit(float(total))
    e = F.col("ma") * F.col("mb") / scale
    sums = seen.groupBy("a", "b").agg(
        F.sum(F.abs(F.col("n") - e)).alias("near"), F.sum(e).alias("seen"), F.max(scale).alias("scale")
    )
    out = sums.join(side_mass("a"), "a").join(side_mass("b"), "b")
    return out.select(
        "a", "b", (F.col("near") + F.col("ta") * F.col("tb") / F.col("scale") - F.col("seen")).alias("score")
    )


def allowed_pairs(scores: DataFrame, outcome: Iterable[str], admissible: Iterable[str]) -> DataFrame:
    """Candidates without (outcome, non-admissible) pairs."""
    outcome, admissible = list(outcome), list(admissible)
    bad = (F.col("a").isin(outcome) & ~F.col("b").isin(admissible)) | (
        F.col("b").isin(outcome) & ~F.col("a").isin(admissible)
    )
    return scores.where(~bad)


def except_candidates(candidates: DataFrame, forbidden: DataFrame) -> DataFrame:
    return candidates.join(forbidden, candidates.columns, "left_anti")


def best_edge(scores: DataFrame) -> DataFrame:
    """The highest-scoring pair; ties go to the first name."""
    top = F.max_by(F.struct("a", "b", "score"), F.struct("score", F.lit(0)))
    return scores.agg(top.alias("e")).select("e.*")


# ---------------------------------------------------------------- trees on the driver


class Forest:
    """Edges over attributes with component labels; a few dozen nodes at most."""

    def __init__(self, attrs: Sequence[str], edges: Iterable[Edge] = ()):
        self.label = {a: a for a in attrs}
        self.edges: list[Edge] = []
        for e in edges:
            self.add(e)

    def joined(self, e: Edge) -> bool:
        return self.label[e[0]] == self.label[e[1]]

    def add(self, e: Edge) -> None:
        keep, gone = self.label[e[0]], self.label[e[1]]
        self.label = {a: keep if v == gone else v for a, v in self.label.items()}
        self.edges.append(e)

    def components(self) -> int:
        return len(set(self.label.values()))

    def leaks(self, extra: Edge, protected: Sequence[str], outcome: Sequence[str], admissible: Sequence[str]) -> bool:
        """Whether an edge opens a path from protected to outcome past all admissible nodes."""
        open_nodes = [a for a in self.label if a not in set(admissible)]
        free = Forest(open_nodes, [e for e in [*self.edges, extra] if set(e) <= set(open_nodes)])
        return any(
            p in free.label and t in free.label and free.label[p] == free.label[t]
            for p in protected
            for t in outcome
        )


def _gumbel(seed: str, *keys) -> float:
    digest = hashlib.md5("|".join([f"{seed}/g", *map(str, keys)]).encode()).hexdigest()
    u = (int(digest[:13], 16) + 0.5) / 2.0**52
    return -math.log(-math.log(u))


def build_tree(
    scores: dict[Edge, float],
    attrs: Sequence[str],
    pick: Callable[[dict[Edge, float], int], Edge],
    given: Iterable[Edge] = (),
    allowed: Callable[[Forest, Edge], bool] | None = None,
) -> list[Edge]:
    """Add picked edges that join two components until none is left."""
    forest = Forest(attrs, given)
    step = 0
    while forest.components() > 1:
        live = {
            e: s
            for e, s in scores.items()
            if not forest.joined(e) and (allowed is None or allowed(forest, e))
        }
        if not live:
            break
        forest.add(pick(live, step))
        step += 1
    return forest.edges


def _read(scores: DataFrame, domain: Domain) -> dict[Edge, float]:
    """Scores on the driver: one number per attribute pair, so at most d(d-1)/2 rows."""
    rows = scores.select("a", "b", "score").collect()
    order = {a: i for i, a in enumerate(domain.attrs)}
    return dict(sorted(((r["a"], r["b"]), r["score"]) for r in rows if r["a"] in order and r["b"] in order))


def private_pick(epsilon: float, seed: str | None, sensitivity: float = 1.0):
    """Exponential-mechanism choice among the live edges."""
    seed = fresh_seed(seed)

    def pick(live: dict[Edge, float], step: int) -> Edge:
        return max(live, key=lambda e: 0.5 * epsilon / sensitivity * live[e] + _gumbel(seed, step, *e))

    return pick


def largest(live: dict[Edge, float], step: int) -> Edge:
    return max(live, key=lambda e: (live[e], e))


def select_tree(
    scores: DataFrame, domain: Domain, rho: float, seed: str | None = None, given: Sequence[Edge] = (),
    damp: Sequence[str] = (), sensitivity: float = 1.0,
) -> list[Edge]:
    """Spanning tree by private picks, the budget shared evenly; edges at ``damp`` count a tenth."""
    table = {
        e: s * (0.1 if set(e) & set(damp) else 1.0) for e, s in _read(scores, domain).items()
    }
    r = Forest(domain.attrs, given).components()
    eps = math.sqrt(8 * rho / max(r - 1, 1))
    return build_tree(table, domain.attrs, private_pick(eps, seed, sensitivity), given)


def select_tree_fair_greedy(
    scores: DataFrame, domain: Domain, outcome: Sequence[str], admissible: Sequence[str],
    rho: float | None = None, seed: str | None = None, sensitivity: float = 1.0,
) -> list[Edge]:
    """Tree without (outcome, non-admissible) edges; without a budget the best edge is taken."""
    live = allowed_pairs(scores, outcome, admissible)
    if rho is None:
        return build_tree(_read(live, domain), domain.attrs, largest)
    return select_tree(live, domain, rho, seed, sensitivity=sensitivity)


def select_tree_hard_constraint(
    scores: DataFrame, domain: Domain, protected: Sequence[str], outcome: Sequence[str], admissible: Sequence[str],
    rho: float | None = None, seed: str | None = None,
) -> list[Edge]:
    """Tree (or forest) whose protected-to-outcome paths all pass an admissible attribute."""
    table = _read(scores, domain)
    fits = lambda forest, e: not forest.leaks(e, protected, outcome, admissible)
    if rho is None:
        return build_tree(table, domain.attrs, largest, allowed=fits)
    eps = math.sqrt(8 * rho / max(len(domain.attrs) - 1, 1))
    return build_tree(table, domain.attrs, private_pick(eps, seed), allowed=fits)


def select_tree_noisy_max(
    noisy: DataFrame, domain: Domain, protected: Sequence[str], outcome: Sequence[str], admissible: Sequence[str]
) -> list[Edge]:
    """Largest admissible edges first, on scores that already carry their noise."""
    return select_tree_hard_constraint(noisy, domain, protected, outcome, admissible)
