"""Adaptive releases: rounds that measure what a clique-tree model answers worst (AIM and MWEM)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions import hashing as H
from margrid.operators import select as S
from margrid.operators.cliquetree import CliqueModel, CliqueTree, fit_cliques
from margrid.operators.marginals import (
    clique_attrs, clique_chunks, clique_name, clique_sums, joint_counts, min_variance_total, workload,
)
from margrid.operators.noise import gaussian_measure, laplace_measure, zcdp_rho
from margrid.plans.sampling import draw_child
from margrid.session import settled

Clique = tuple[str, ...]


@dataclass(frozen=True)
class Pace:
    """Noise of a round's measurement and exponent of its selection."""

    sigma: float
    eps: float

    @classmethod
    def over(cls, rho: float, rounds: float, share: float = 0.9) -> Pace:
        """An even pace for a budget: ``share`` of it for measurements, the rest for selections."""
        return cls(math.sqrt(rounds / (2 * share * rho)), math.sqrt(8 * (1 - share) * rho / rounds))

    @property
    def cost(self) -> float:
        return 0.5 / self.sigma**2 + self.eps**2 / 8

    def finer(self) -> Pace:
        return Pace(self.sigma / 2, self.eps * 2)


@dataclass
class Ledger:
    """A zCDP budget and what it was spent on."""

    rho: float
    entries: list[tuple[str, float]] = field(default_factory=list)

    @property
    def spent(self) -> float:
        return sum(cost for _, cost in self.entries)

    @property
    def left(self) -> float:
        return self.rho - self.spent

    def pace(self, wanted: Pace) -> Pace:
        """The wanted pace, or all that is left if that would not do for two such rounds."""
        return Pace.over(self.left, 1) if self.left < 2 * wanted.cost else wanted


@dataclass
class Release:
    """True answers of the candidates, what was measured of them, and the model of it so far."""

    truth: DataFrame
    domain: Domain
    total: float
    fit_rounds: int
    taken: list[Clique] = field(default_factory=list)
    measured: DataFrame | None = None
    model: CliqueModel | None = None

    @classmethod
    def of(cls, joint: DataFrame, domain: Domain, candidates: Sequence[Clique], total: float, fit_rounds: int) -> Release:
        sums = clique_sums(joint, domain, candidates, "n")
        grid = clique_chunks(joint.sparkSession, domain, candidates)
        truth = grid.join(sums, ["clique", "cell"], "left").select(
            "clique", "cell", F.coalesce("value", F.lit(0.0)).alias("value")
        )
        return cls(settled(truth), domain, total, fit_rounds)

    def fits(self, clique: Clique, cells: float) -> bool:
        """Whether a model with this clique stays within a number of cells; what the tree holds already always does."""
        tree = self.model.tree
        return tree.home(clique) is not None or CliqueTree.build(self.domain, [*self.taken, clique]).cells <= cells

    def errors(self, candidates: Sequence[Clique]) -> dict[str, float]:
        """L1 error of the model's answers, one number for each candidate."""
        both = self.truth.join(self.model.answers(candidates).withColumnRenamed("value", "hat"), ["clique", "cell"])
        rows = both.groupBy("clique").agg(F.sum(F.abs(F.col("value") - F.col("hat"))).alias("e")).collect()
        return {r["clique"]: r["e"] for r in rows}

    def add(self, cliques: Sequence[Clique], noisy: DataFrame) -> None:
        """More measurements; repeated ones are merged by inverse variance."""
        if self.measured is not None:
            noisy = noisy.unionByName(self.measured)
        w = F.lit(1.0) / (F.col("stddev") * F.col("stddev"))
        self.measured = settled(noisy.groupBy("clique", "cell").agg(
            (F.sum(F.col("noisy") * w) / F.sum(w)).alias("noisy"), F.sqrt(F.lit(1.0) / F.sum(w)).alias("stddev")
        ))
        self.taken += [c for c in cliques if c not in self.taken]

    def refit(self) -> None:
        """The model goes on from the potentials that it has, until no step lowers the loss or all rounds are done."""
        self.model = fit_cliques(
            self.truth if self.measured is None else self.measured, self.domain, self.taken, self.total,
            self.model, self.fit_rounds, 0.0,
        )

    def moved(self, clique: Clique, before: CliqueModel) -> float:
        """L1 distance of the model's answers of a clique from an earlier model's."""
        both = self.model.answers([clique]).join(
            before.answers([clique]).withColumnRenamed("value", "old"), ["clique", "cell"]
        )
        return both.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]

    def rows(self, n: int | None, seed: str) -> DataFrame:
        self.refit()
        return self.model.sample(self.truth.sparkSession, n or max(1, int(self.total)), seed, draw_child)


def _mechanism(scores: dict[str, float], eps: float, sensitivity: float, seed: str) -> str:
    """The exponential mechanism, by the largest score with Gumbel noise."""
    return max(sorted(scores), key=lambda c: 0.5 * eps / sensitivity * scores[c] + S._gumbel(seed, c))


def _subsets(cliques: Sequence[Clique], domain: Domain) -> list[Clique]:
    """All non-empty attribute sets inside some clique, small ones first, attributes in the domain's order."""
    found: set[Clique] = set()
    for c in cliques:
        for bits in range(1, 1 << len(c)):
            found.add(tuple(a for a in domain.attrs if a in c and bits >> list(c).index(a) & 1))
    return sorted(found, key=lambda s: (len(s), s))


def aim_synthesize(
    df: DataFrame, domain: Domain, epsilon: float, delta: float, cliques: Sequence[Sequence[str]] | None = None,
    rounds: int | None = None, max_cells: int = 100_000, fit_rounds: int = 1000, seed: str | None = None,
    n: int | None = None,
) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Synthetic rows from adaptive rounds, and the ledger of the budget (what, cost).

    All one-way marginals are measured first. A round scores every subset of the workload's cliques by how far the
    model's answer is off beyond the noise to expect, weighted by its overlap with the workload, draws one by the
    exponential mechanism, measures it and lets the model go on from its potentials. Candidates are limited by the size
    of the clique tree alone: it may reach the spent share of ``max_cells``. Where a measurement moves the model by
    no more than noise would, the next rounds are finer. ``rounds`` (16 an attribute) sets the pace; the last round takes
    what is left of the budget.
    """
    seed = H.fresh_seed(seed)
    base = [tuple(c) for c in (cliques or workload(domain, 2))]
    candidates = _subsets(base, domain)
    weight = {clique_name(c): float(sum(len(set(c) & set(w)) for w in base)) for c in candidates}
    ledger = Ledger(zcdp_rho(epsilon, delta))
    pace = Pace.over(ledger.rho, rounds or 16 * len(domain.attrs))
    release = Release.of(settled(joint_counts(df, domain)), domain, candidates, 1.0, fit_rounds)

    singles = [c for c in candidates if len(c) == 1]
    one = {clique_name(c): 1.0 for c in singles}
    release.add(singles, gaussian_measure(release.truth.where(F.col("clique").isin(list(one))), pace.sigma, one, f"{seed}/0"))
    ledger.entries.append(("one-way", len(singles) * 0.5 / pace.sigma**2))
    release.total = max(float(min_variance_total(release.measured).first()["total"]), 1.0)
    release.refit()
    while ledger.left > 1e-9 * ledger.rho:
        pace = ledger.pace(pace)
        turn, limit = len(ledger.entries), max_cells * (ledger.spent + pace.cost) / ledger.rho
        expected = math.sqrt(2 / math.pi) * pace.sigma
        errors = release.errors([c for c in candidates if release.fits(c, limit)])
        scores = {c: weight[c] * (e - expected * domain.size(clique_attrs(c))) for c, e in errors.items()}
        choice = _mechanism(scores, pace.eps, max(weight[c] for c in scores), f"{seed}/pick/{turn}")
        picked = release.truth.where(F.col("clique") == choice)
        release.add([clique_attrs(choice)], gaussian_measure(picked, pace.sigma, {choice: 1.0}, f"{seed}/{turn}"))
        ledger.entries.append((choice, pace.cost))
        before = release.model
        release.refit()
        if release.moved(clique_attrs(choice), before) <= expected * domain.size(clique_attrs(choice)):
            pace = pace.finer()
    return release.rows(n, seed), ledger.entries


def mwem_synthesize(
    df: DataFrame, domain: Domain, epsilon: float, delta: float, cliques: Sequence[Sequence[str]] | None = None,
    rounds: int | None = None, noise: str = "gaussian", bounded: bool = False, alpha: float = 0.9,
    max_cells: int = 100_000, fit_rounds: int = 1000, seed: str | None = None, n: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Synthetic rows from rounds of worst-clique selection, measurement and refit, and the cliques in order.

    A round (one an attribute by default) may let the clique tree reach its share of ``max_cells``. With ``bounded`` the
    number of rows is public and a neighbour differs by one changed row.
    """
    seed = H.fresh_seed(seed)
    base = [tuple(c) for c in (cliques or workload(domain, 2))]
    rounds = rounds or len(domain.attrs)
    if noise == "laplace":
        scale, eps = rounds / (alpha * epsilon), (1 - alpha) * epsilon / rounds
    else:
        pace = Pace.over(zcdp_rho(epsilon, delta), rounds, alpha)
        scale, eps = pace.sigma, pace.eps
    far = {"laplace": 2.0, "gaussian": math.sqrt(2.0)}[noise] if bounded else 1.0
    joint = settled(joint_counts(df, domain))
    total = float(joint.agg(F.sum("n")).first()[0] or 0.0) if bounded else 1.0
    release = Release.of(joint, domain, base, max(total, 1.0), fit_rounds)
    release.refit()
    order: list[str] = []
    for turn in range(1, rounds + 1):
        live = [c for c in base if release.fits(c, max_cells * turn / rounds)]
        scores = {c: e - domain.size(clique_attrs(c)) for c, e in release.errors(live).items()}
        choice = _mechanism(scores, eps, 2.0 if bounded else 1.0, f"{seed}/pick/{turn}")
        picked = release.truth.where(F.col("clique") == choice)
        if noise == "laplace":
            noisy = laplace_measure(picked, 1.0 / (far * scale), f"{seed}/{turn}")
        else:
            noisy = gaussian_measure(picked, far * scale, {choice: 1.0}, f"{seed}/{turn}")
        release.add([clique_attrs(choice)], noisy)
        order.append(choice)
        if not bounded:
            release.total = max(float(min_variance_total(release.measured).first()["total"]), 1.0)
        release.refit()
    return release.rows(n, seed), order
