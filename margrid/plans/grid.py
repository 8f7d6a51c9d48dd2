"""Folds x budgets in one keyed plan: counting, noise, fitting and sampling carry the keys along."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions import hashing as H
from margrid.operators import select as S
from margrid.operators.fit import cumulative
from margrid.operators.noise import zcdp_rho
from margrid.plans.sampling import pick
from margrid.session import bounded, cut, shuffle_width

KEYS = ["cs", "eps"]


def _keyed_pairs(rows: DataFrame, domain: Domain) -> DataFrame:
    """(cs, a, b, ca, cb, n) of the training rows of every fold, from one scan."""
    joint = rows.where(domain.in_range()).groupBy("cs", *domain.attrs).agg(F.count(F.lit(1)).cast("double").alias("n"))
    members = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("ca"), F.col(b).alias("cb"))
            for a, b in combinations(domain.attrs, 2)
        ]
    )
    long = joint.select("cs", F.explode(members).alias("p"), "n")
    return long.groupBy("cs", "p.a", "p.b", "p.ca", "p.cb").agg(F.sum("n").alias("n"))


def training_folds(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Rows of every training split: a row serves in all folds but its own, as column ``cs``."""
    cs = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return df.withColumn("cs", cs).where(F.col("cs") != F.col(fold)).drop(fold)


def run_grid(
    df: DataFrame, domain: Domain, folds: int, epsilons: Sequence[float], delta: float, seed: str | None = None,
    fold: str = "fold",
) -> DataFrame:
    """Synthetic rows (cs, eps, id, attributes) for every fold and budget.

    ``df`` holds the codes and a fold number.  Counts, noise, 1-way fits and scores of all keys
    are single tables; only the pair scores (d(d-1)/2 numbers per key) reach the driver, where
    each key picks its tree.  Every key gets as many rows as its noisy total.
    """
    seed = H.fresh_seed(seed)
    spark = df.sparkSession
    attrs = list(domain.attrs)
    budgets = [(f"{e:g}", zcdp_rho(e, delta)) for e in epsilons]
    sigma = F.create_map(*[F.lit(v) for e, r in budgets for v in (e, math.sqrt(3.0 / (2.0 * r)))])
    eps_col = F.explode(F.array(*[F.lit(e) for e, _ in budgets])).alias("eps")
    pairs = cut(_keyed_pairs(training_folds(df, folds, fold), domain))

    # 1-way tables with noise, every cell of every (cs, eps)
    first = {a: next((x, y) for x, y in combinations(attrs, 2) if a in (x, y)) for a in attrs}
    side = lambda a: F.when(F.col("a") == a, F.col("ca")).otherwise(F.col("cb"))
    member = F.array_compact(
        F.array(
            *[
                F.when((F.col("a") == first[a][0]) & (F.col("b") == first[a][1]), F.struct(F.lit(a).alias("attr"), side(a).alias("code")))
                for a in attrs
            ]
        )
    )
    ones = pairs.select("cs", F.explode(member).alias("m"), "n").groupBy("cs", "m.attr", "m.code").agg(F.sum("n").alias("n"))
    sizes = spark.createDataFrame([(a, domain[a]) for a in attrs], "attr string, size int")
    grid = sizes.select("attr", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("code"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("cs")).select("*", eps_col)
    sd = F.element_at(sigma, F.col("eps"))
    d = float(len(attrs))
    noisy = grid.join(ones, ["cs", "attr", "code"], "left").select(
        *KEYS, "attr", "code",
        (F.coalesce("n", F.lit(0.0)) + sd * F.lit(math.sqrt(d)) * H.gaussian(f"{seed}/one", *KEYS, "attr", "code")).alias("y"),
        F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "attr")).alias("k"),
    )
    noisy = cut(noisy)
    per = noisy.groupBy(*KEYS, "attr").agg(F.sum("y").alias("est"), F.max("k").alias("k"))
    totals = per.groupBy(*KEYS).agg(
        F.greatest(F.lit(1.0), F.sum(F.col("est") / F.col("k")) / F.sum(F.lit(1.0) / F.col("k"))).alias("total")
    )
    clipped = noisy.withColumn("y", F.greatest("y", F.lit(0.0)))
    mass = clipped.groupBy(*KEYS, "attr").agg(F.sum("y").alias("s"))
    fitted = clipped.join(mass, [*KEYS, "attr"]).join(totals, KEYS)
    share = F.when(F.col("s") > 0, F.col("y") * F.col("total") / F.col("s")).otherwise(F.col("total") / F.col("k"))
    fitted = cut(fitted.select(*KEYS, "attr", "code", share.alias("m"), "total"))

    # scores of every pair and key; a cell nobody occupies adds its product mass
    keyed = pairs.select("*", eps_col)
    left = fitted.select(*KEYS, F.col("attr").alias("a"), F.col("code").alias("ca"), F.col("m").alias("ma"), "total")
    right = fitted.select(*KEYS, F.col("attr").alias("b"), F.col("code").alias("cb"), F.col("m").alias("mb"))
    e = F.col("ma") * F.col("mb") / F.col("total")
    scores = (
        keyed.join(left, [*KEYS, "a", "ca"])
        .join(right, [*KEYS, "b", "cb"])
        .groupBy(*KEYS, "a", "b")
        .agg((F.sum(F.abs(F.col("n") - e)) + F.max("total") - F.sum(e)).alias("score"))
    )
    table: dict[tuple[int, str], dict[S.Edge, float]] = {}
    for r in scores.collect():
        table.setdefault((r["cs"], r["eps"]), {})[(r["a"], r["b"])] = r["score"]
    rho = dict(budgets)
    steps = []
    for (cs, eps), live in sorted(table.items()):
        budget = math.sqrt(8 * rho[eps] / 3.0 / max(len(attrs) - 1, 1))
        chosen = S.build_tree(dict(sorted(live.items())), attrs, S.private_pick(budget, f"{seed}/{cs}/{eps}"))
        steps += _walk(cs, eps, chosen, attrs)
    walk = spark.createDataFrame(steps, "cs int, eps string, step int, parent int, child int, a string, b string")

    # noisy pair tables of the chosen edges, as conditional arrays keyed by (cs, eps, step, parent code)
    chosen = walk.where(F.col("parent") >= 0)
    cells = S.pair_grid(df, domain, list(combinations(attrs, 2)))
    noise = sd * F.lit(math.sqrt(max(d - 1, 1))) * H.gaussian(f"{seed}/two", *KEYS, "a", "b", "ca", "cb")
    two = (
        chosen.join(cells, ["a", "b"])
        .join(pairs, ["cs", "a", "b", "ca", "cb"], "left")
        .select(*KEYS, "step", "parent", "child", "a", "b", "ca", "cb", F.greatest(F.coalesce("n", F.lit(0.0)) + noise, F.lit(0.0)).alias("value"))
    )
    position = F.create_map(*[F.lit(v) for i, a in enumerate(attrs) for v in (a, i)])
    a_is_parent = F.element_at(position, F.col("a")) == F.col("parent")
    two = two.select(
        *KEYS, "step",
        F.when(a_is_parent, F.col("ca")).otherwise(F.col("cb")).alias("pcode"),
        F.when(a_is_parent, F.col("cb")).otherwise(F.col("ca")).alias("code"),
        (F.col("value") + F.lit(1e-9)).alias("value"),
    )
    roots = fitted.join(
        walk.where(F.col("parent") < 0).select(*KEYS, "step", F.element_at(F.array(*[F.lit(a) for a in attrs]), F.col("child") + 1).alias("attr")),
        [*KEYS, "attr"],
    ).select(*KEYS, "step", F.lit(-1).alias("pcode"), "code", (F.col("m") + F.lit(1e-9)).alias("value"))
    cdfs = cut(cumulative(two.unionByName(roots), [*KEYS, "step", "pcode"], "code", "value"))

    # rows of every key, one step per attribute
    n = totals.select(*KEYS, F.floor("total").alias("rows"))
    chunk = 20_000
    rows = n.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / chunk))))
    # an explicit width: the few chunk rows must not be coalesced before they are expanded
    rows = rows.repartition(shuffle_width(spark), *KEYS, "part").select(
        *KEYS, F.explode(F.sequence(F.col("part") * chunk, F.least((F.col("part") + 1) * chunk, F.col("rows")) - 1)).alias("id")
    )
    rows = rows.withColumn("codes", F.array_repeat(F.lit(-1), len(attrs)))
    widest = len(table) * max(domain.size(p) for p in combinations(attrs, 2))
    for step in range(len(attrs)):
        moves = walk.where(F.col("step") == step).select(*KEYS, "parent", "child")
        here = bounded(cdfs.where(F.col("step") == step).select(*KEYS, "pcode", "cdf", "mass"), widest)
        rows = rows.join(bounded(moves, len(table)), KEYS)
        pcode = F.when(F.col("parent") < 0, F.lit(-1)).otherwise(F.get("codes", F.col("parent")))
        rows = rows.withColumn("pcode", pcode).join(here, [*KEYS, "pcode"])
        code = pick(F.col("cdf"), F.col("mass"), H.uniform(f"{seed}/row/{step}", *KEYS, "id"))
        drawn = rows.withColumn("__code", code)
        rows = drawn.select(
            *KEYS, "id",
            F.transform("codes", lambda v, i: F.when(i == F.col("child"), F.col("__code")).otherwise(v)).alias("codes"),
        )
    return rows.select(*KEYS, "id", *[F.get("codes", i).alias(a) for i, a in enumerate(attrs)])


def _walk(cs: int, eps: str, edges: Sequence[S.Edge], attrs: list[str]) -> list[tuple]:
    """Steps of a key's forest: (cs, eps, step, parent position or -1, child position, edge)."""
    at = {a: i for i, a in enumerate(attrs)}
    placed, out, waiting = set(), [], list(edges)
    while len(placed) < len(attrs):
        ready = next((e for e in waiting if set(e) & placed), None)
        if ready is None:
            root = next(a for a in attrs if a not in placed)
            out.append((cs, eps, len(out), -1, at[root], "", ""))
            placed.add(root)
            continue
        waiting.remove(ready)
        parent, child = ready if ready[0] in placed else (ready[1], ready[0])
        out.append((cs, eps, len(out), at[parent], at[child], ready[0], ready[1]))
        placed.add(child)
    return out
