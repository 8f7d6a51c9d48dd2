"""Pipelines without SQL: row counts, domains and accuracy with a generous budget."""

import pytest
from pyspark.sql import functions as F

from catalog.base import ORDER_DOMAIN, orders
from margrid.domain import validate_domain
from margrid.operators import distance as D
from margrid.operators import noise as G
from margrid.plans import grid as P
from margrid.plans import synthesis as Y

SMALL = ORDER_DOMAIN.project(["status", "prio", "price"])


def _inside(rows, domain):
    return validate_domain(rows, domain).agg(F.sum("bad_rows")).first()[0] == 0


def test_grid_keeps_keys_and_sizes(spark, sf):
    o = G.stratified_kfold(orders(spark, sf), "status", "id", 3, "t")
    rows = P.run_grid(o, SMALL, 3, [50.0], 1e-9, "t")
    sizes = {r["cs"]: r["count"] for r in rows.groupBy("cs").count().collect()}
    train = o.count() * 2 / 3
    assert set(sizes) == {0, 1, 2}
    assert all(v == pytest.approx(train, rel=0.05) for v in sizes.values())
    assert _inside(rows, SMALL)


@pytest.mark.parametrize("targets", [(), ("status",)])
def test_adaptive_grid_is_close_with_a_large_budget(spark, sf, targets):
    o = orders(spark, sf)
    rows = Y.adagrid_synthesize(o, SMALL, 200.0, 1e-9, threshold=3.0, targets=targets, seed="t")
    assert _inside(rows, SMALL)
    error = D.mean_error(D.workload_error(o, rows, SMALL, [("status", "prio"), ("price",)])).first()[0]
    assert error < 0.15


def test_network_has_one_parent_per_attribute(spark, sf):
    network = Y.greedy_parents(orders(spark, sf), ORDER_DOMAIN)
    placed = set()
    for child, parent in network:
        assert (parent is None) == (not placed) and (parent is None or parent in placed)
        placed.add(child)
    assert placed == set(ORDER_DOMAIN.attrs)
