"""Clique trees against brute force on the full joint, and the adaptive releases built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import synthesis
from catalog.base import ORDER_DOMAIN, orders
from margrid.domain import Domain, validate_domain
from margrid.operators import cliquetree as T
from margrid.operators import marginals as M
from margrid.operators.cliquetree import CliqueTree, calibrate, fit_cliques
from margrid.operators.marginals import clique_name
from margrid.plans import adaptive as A

TOY = Domain.of({"a": 2, "b": 3, "c": 4, "d": 2, "e": 3})
LOOP = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]


def _margin(joint, domain, clique):
    return joint.sum(axis=tuple(i for i, a in enumerate(domain.attrs) if a not in clique))


def test_triangulation():
    tree = CliqueTree.build(TOY, LOOP)
    assert all(tree.home(c) is not None for c in LOOP) and tree.home(("e",)) is not None
    assert sorted(len(c) for c in tree.cliques) == [1, 3, 3]  # the loop of four needs one chord
    for a in TOY.attrs:  # cliques with an attribute are one connected part of the tree
        held = [i for i, c in enumerate(tree.cliques) if a in c]
        assert sum(tree.parent[i] < 0 or a not in tree.separator(i) for i in held) == 1
    star = CliqueTree.build(TOY, [("a", x) for x in "bcde"])
    assert star.cells == 2 * (3 + 4 + 2 + 3) and len(star.levels) <= 3
    assert CliqueTree.build(TOY, []).cells == TOY.size() * 0 + sum(TOY.sizes)


def test_messages_give_the_marginals_of_the_product(spark):
    tree = CliqueTree.build(TOY, [*LOOP, ("d", "e")])
    rng = np.random.default_rng(2)
    joint, rows = np.ones(TOY.sizes), []
    for t in range(2):
        for c in tree.cliques:
            b = rng.normal(scale=2, size=[TOY[a] for a in c])
            rows += [(t, clique_name(c), k, float(v)) for k, v in enumerate(b.ravel())]
            if t == 1:
                shape = [TOY[a] if a in c else 1 for a in TOY.attrs]
                joint = joint * np.exp(b).reshape(shape)
    joint /= joint.sum()
    out = calibrate(tree, spark.createDataFrame(rows, "try int, clique string, cell long, b double"), 2).where("try = 1")
    got = {(r["clique"], r["cell"]): r["value"] for r in out.collect()}
    assert len(got) == tree.cells
    for c in tree.cliques:
        for k, v in enumerate(_margin(joint, TOY, c).ravel()):
            assert got[clique_name(c), k] == pytest.approx(v, rel=1e-9)


def test_fit_reaches_the_nearest_consistent_tables(spark):
    """Two noisy edges a-b and b-c: the nearest consistent tables have a closed form while all cells are positive."""
    domain = Domain.of({"a": 2, "b": 3, "c": 2})
    rng = np.random.default_rng(5)
    total = 1000.0
    y, z = rng.uniform(100, 200, (2, 3)), rng.uniform(100, 200, (3, 2))
    rows = [(clique_name(c), k, float(v), 3.0) for c, t in ((("a", "b"), y), (("b", "c"), z)) for k, v in enumerate(t.ravel())]
    measured = spark.createDataFrame(rows, "clique string, cell long, noisy double, stddev double")
    model = fit_cliques(measured, domain, [("a", "b"), ("b", "c")], total, rounds=40, tolerance=1e-7)
    s, t = y.sum(axis=0), z.sum(axis=1)
    middle = (s / 2 + t / 2) / (1 / 2 + 1 / 2)
    middle += (total - middle.sum()) / 3
    want = {("a", "b"): y + (middle - s) / 2, ("b", "c"): z + ((middle - t) / 2)[:, None]}
    least = sum(((want[c] - v) ** 2).sum() for c, v in ((("a", "b"), y), (("b", "c"), z))) / 2
    assert model.losses == sorted(model.losses, reverse=True)
    assert model.losses[-1] == pytest.approx(least, rel=1e-3)
    got = {(r["clique"], r["cell"]): r["value"] for r in model.answers(list(want)).collect()}
    for c, table in want.items():
        for k, v in enumerate(table.ravel()):
            assert got[clique_name(c), k] == pytest.approx(v, abs=2.0)
    # an answer across the two cliques is their product over the middle attribute
    ab, bc = (np.array([got[clique_name(c), k] for k in range(6)]).reshape(s) for c, s in ((("a", "b"), (2, 3)), (("b", "c"), (3, 2))))
    across = {r["cell"]: r["value"] for r in model.answers([("a", "c")]).collect()}
    assert [across[k] for k in range(4)] == pytest.approx(((ab / ab.sum(axis=0)) @ bc).ravel().tolist(), rel=1e-6)
    warm = fit_cliques(measured, domain, [("a", "b"), ("b", "c")], total, start=model, rounds=1)
    assert warm.losses[0] == pytest.approx(model.losses[-1], rel=1e-9) and warm.losses[-1] <= warm.losses[0]


def test_aim_spends_its_budget(spark, sf):
    o = orders(spark, sf)
    rows, ledger = A.aim_synthesize(o, ORDER_DOMAIN, 100.0, 1e-9, rounds=4, seed="t")
    assert validate_domain(rows, ORDER_DOMAIN).agg(F.sum("bad_rows")).first()[0] == 0
    assert sum(cost for _, cost in ledger) == pytest.approx(A.zcdp_rho(100.0, 1e-9), rel=1e-6)


def test_size_alone_limits_candidates(spark, sf):
    joint = M.joint_counts(orders(spark, sf), ORDER_DOMAIN)
    release = A.Release.of(joint, ORDER_DOMAIN, M.workload(ORDER_DOMAIN, 2), 100.0, 1)
    release.refit()
    assert release.fits(("status", "prio"), 27) and not release.fits(("status", "prio"), 26)  # 15 + 7 + 5 cells
    assert release.fits(("status",), 0)


def test_mwem_measures_the_worst(spark, sf):
    o = orders(spark, sf)
    rows, order = A.mwem_synthesize(o, ORDER_DOMAIN, 100.0, 1e-9, rounds=2, noise="laplace", bounded=True, seed="t")
    assert len(order) == 2
    assert rows.count() == o.count()
    assert validate_domain(rows, ORDER_DOMAIN).agg(F.sum("bad_rows")).first()[0] == 0


def test_rounds_leave_no_constraints_behind(spark):
    """Every round plans like the first: what the last one's plan knew of its columns is not carried on."""
    rows = [("a,d", k, float(v), 1.0) for k, v in enumerate([40, 10, 25, 25])]
    measured = spark.createDataFrame(rows, "clique string, cell long, noisy double, stddev double")
    model = fit_cliques(measured, TOY.project(["a", "d"]), [("a", "d")], 100.0, rounds=3, tolerance=0.0)
    for table in (model.marginals, model.weights):
        assert table._jdf.queryExecution().optimizedPlan().constraints().size() <= 4


def _noisy(spark, domain, cliques, total, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k, c in enumerate(cliques):
        table = rng.dirichlet(np.full(domain.size(c), 0.7)) * total + rng.normal(scale=2.0 + k, size=domain.size(c))
        rows += [(clique_name(c), cell, float(v), 2.0 + k) for cell, v in enumerate(table)]
    return spark.createDataFrame(rows, "clique string, cell long, noisy double, stddev double")


def test_tasks_fit_like_joins(spark, monkeypatch):
    """A loop, an attribute of one code, a clique in another order than the domain's and an attribute that nothing measures."""
    domain = Domain.of({"a": 2, "o": 1, "b": 3, "c": 2, "d": 2, "e": 3})
    cliques = [("b", "o", "a"), ("b", "c"), ("c", "d"), ("a", "d"), ("a",)]
    measured, fits = _noisy(spark, domain, cliques, 400.0, 3), []
    for cells in (10**6, 0):
        monkeypatch.setattr(T, "TASK_CELLS", cells)
        first = fit_cliques(measured, domain, cliques[:2], 400.0, rounds=2, tolerance=0.0)
        fits.append(fit_cliques(measured, domain, cliques, 400.0, first, rounds=3, tolerance=0.0))
    tasks, joins = fits
    assert tasks.losses == pytest.approx(joins.losses, rel=1e-9) and len(tasks.losses) == 4
    for read in (lambda m: m.marginals, lambda m: m.weights):
        got, want = ({tuple(r)[:2]: r[2] for r in read(m).collect()} for m in fits)
        assert got.keys() == want.keys()
        assert [got[k] for k in sorted(got)] == pytest.approx([want[k] for k in sorted(got)], rel=1e-6, abs=1e-9)


def test_parts_of_a_tree_fit_on_their_own(spark):
    """Two edges that share nothing: each ends as if it were alone, and the losses add up."""
    domain = Domain.of({"a": 3, "b": 2, "c": 2, "d": 4})
    cliques = [("a", "b"), ("c", "d")]
    measured = _noisy(spark, domain, cliques, 300.0, 8)
    both = fit_cliques(measured, domain, cliques, 300.0, rounds=200, tolerance=0.0)
    table = {(r["clique"], r["cell"]): r["noisy"] for r in measured.collect()}
    least = 0.0
    for c, weight in zip(cliques, (1.0, (2.0 / 3.0) ** 2)):
        # the nearest table of non-negative cells with the total: cells less a constant, cut at zero
        y = np.array([table[clique_name(c), k] for k in range(domain.size(c))])
        down = np.sort(y)[::-1]
        shift = max((down[: k + 1].sum() - 300.0) / (k + 1) for k in range(len(y)))
        least += weight * ((np.maximum(y - shift, 0.0) - y) ** 2).sum() / 2
    assert both.losses == sorted(both.losses, reverse=True)
    assert both.losses[-1] == pytest.approx(least, rel=1e-3)


def _coded(spark, domain, n, seed):
    rng = np.random.default_rng(seed)
    first = rng.integers(0, domain.sizes[0], n)
    columns = [first] + [(first + rng.integers(0, 2, n)) % size for size in domain.sizes[1:]]
    return spark.createDataFrame([tuple(map(int, r)) for r in zip(*columns)], ", ".join(f"{a} int" for a in domain.attrs))


@pytest.mark.parametrize("way", ["aim", "mwem"])
def test_rounds_fit_to_the_end(spark, monkeypatch, way):
    """No refit stops before its loss is as small as it gets: 300 more rounds take next to nothing off it."""
    domain, calls = Domain.of({"a": 3, "b": 3, "c": 4}), []

    def kept(*args):
        calls.append((args, fit_cliques(*args)))
        return calls[-1][1]

    monkeypatch.setattr(A, "fit_cliques", kept)
    rows = _coded(spark, domain, 400, 4)
    if way == "aim":
        A.aim_synthesize(rows, domain, 5.0, 1e-6, rounds=4, seed="end")
    else:
        A.mwem_synthesize(rows, domain, 5.0, 1e-6, seed="end")
    fits = [(args, model) for args, model in calls if model.losses]
    assert len(fits) >= 3
    for (measured, _, cliques, total, *_), model in fits:
        more = fit_cliques(measured, domain, cliques, total, model, 300, 0.0).losses
        assert more[0] - more[-1] <= 1e-4 * more[0] + 1e-6 * total


def test_registered_aim_keeps_the_pace_of_its_attributes(spark, monkeypatch):
    """16 rounds an attribute: the one-way tables take four shares of 64."""
    seen = []

    def kept(*args, real=A.aim_synthesize, **named):
        rows, ledger = real(*args, **named)
        seen.append(ledger)
        return rows, ledger

    monkeypatch.setattr(A, "aim_synthesize", kept)
    monkeypatch.setattr(synthesis, "orders", lambda spark, sf: _coded(spark, ORDER_DOMAIN, 300, 6))
    rows = synthesis.aim_synthesize(spark, "")
    rho = A.zcdp_rho(10.0, synthesis.DELTA)
    assert seen[0][0] == ("one-way", pytest.approx(4 * 0.9 * rho / 64, rel=1e-9))
    assert sum(cost for _, cost in seen[0]) == pytest.approx(rho, rel=1e-6)
    assert validate_domain(rows, ORDER_DOMAIN).agg(F.sum("bad_rows")).first()[0] == 0
