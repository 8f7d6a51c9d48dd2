"""Synthetic rows from fitted models: every attribute is one keyed join, rows never meet rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.functions.hashing import fresh_seed, uniform
from margrid.operators.factors import attrs_of, eliminate, tree_factors
from margrid.operators.fit import TreeModel, cumulative
from margrid.operators.noise import interval_assign, round_counts
from margrid.operators.ranking import hash_order_number, running_total
from margrid.session import bounded, settled, shuffle_width

# Pieces of the hash order in which rounded draws look for the ends of codes: of a parent group, and of all together.
_MOST_PIECES, _ALL_PIECES = 1 << 12, 1 << 18


def pick(cdf: Column, mass: Column, u: Column) -> Column:
    """Key of the first step of a cumulative array that exceeds u * mass."""
    above = F.filter(cdf, lambda s: s["cum"] > u * mass)
    return F.coalesce(F.get(above, 0), F.element_at(cdf, -1))["key"]


def draw_child(
    rows: DataFrame, table: DataFrame, parents: Sequence[str], child: str, seed: str, domain: Domain, key: str = "id"
) -> DataFrame:
    """Add a column drawn from P(child | parents); ``table`` is (parents, child, value).

    Parent codes without any mass fall back to the child's own distribution.  The table has at
    most one cell per domain cell, so for bounded domains rows are not shuffled.
    """
    cdf = cumulative(table, parents, child, "value").where(F.col("mass") > 0)
    own = cumulative(table.groupBy(child).agg(F.sum("value").alias("value")), [], child, "value")
    cells = domain.size([*parents, child])
    joined = rows.join(bounded(cdf, cells), list(parents), "left") if parents else rows.withColumns(
        {c: own.select(c).scalar() for c in ("cdf", "mass")}
    )
    if parents:
        joined = joined.withColumns(
            {
                "cdf": F.coalesce("cdf", own.select("cdf").scalar()),
                "mass": F.coalesce("mass", own.select("mass").scalar()),
            }
        )
    u = uniform(f"{seed}/{child}", key)
    return joined.withColumn(child, pick(F.col("cdf"), F.col("mass"), u)).drop("cdf", "mass")


def deal_child(
    rows: DataFrame, table: DataFrame, parents: Sequence[str], child: str, seed: str, domain: Domain, key: str = "id"
) -> DataFrame:
    """Add a column with rounded counts per parent group instead of independent draws.

    The rows of a parent group take codes in hash order by the running total of the group's rounded counts.  Hash order
    is cut into pieces; their sizes give the code of every piece but those in which a code ends, and only the rows of
    these are ranked.  Rows look their piece up where they lie.  They are read three times, so they are stored first with
    their place in hash order; independent draws need no such step.
    """
    parents = list(parents)
    pieces = max(shuffle_width(rows.sparkSession), min(_MOST_PIECES, _ALL_PIECES // domain.size(parents)))
    u = uniform(f"{seed}/deal/{child}", key)
    placed = settled(rows.withColumn("__u", u))
    placed = placed.withColumn("__piece", F.floor(F.col("__u") * F.lit(pieces)).cast("int"))
    keys = [*parents, "__piece"]
    held = settled(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    sizes = held.groupBy(*parents).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("double").alias("want"))
    live = table.groupBy(*parents).agg(F.sum("value").alias("__m"))
    own = table.groupBy(child).agg(F.sum("value").alias("__own"))
    if parents:
        dense = sizes.join(table, parents, "left")
        missing = sizes.join(live.where(F.col("__m") > 0), parents, "left_anti")
        codes = own.agg(F.collect_list(F.struct(child, "__own")).alias("c")).select("c").scalar()
        fallback = missing.withColumn("__c", F.explode(codes)).select(
            *parents, "want", F.col(f"__c.{child}").alias(child), F.col("__c.__own").alias("value")
        )
        dense = dense.join(live.where(F.col("__m") > 0), parents, "left_semi").unionByName(fallback)
    else:
        dense = table.withColumn("want", sizes.select("want").scalar())
    whole = round_counts(dense.select(*parents, child, "value", "want"), parents, child, "value", f"{seed}/{child}", "want")
    ends = settled(cumulative(whole, parents, child, "rounded").drop("mass"))
    with_ends = lambda t: (
        t.join(bounded(ends, domain.size([*parents, child])), parents) if parents
        else t.withColumn("cdf", ends.select("cdf").scalar())
    )
    # pieces of one code, and those in which a code ends
    before = Window.partitionBy(*parents).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = with_ends(held.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    first, last = _at_rank(F.col("__before") + 1), _at_rank(F.col("__before") + F.col("__n"))
    spans = settled(spans.select(*keys, "__before", first.alias("__code"), last.alias("__last")))
    mixed = spans.where(F.col("__code") != F.col("__last")).select(*keys, "__before")
    wanted = [r[0] for r in mixed.select("__piece").distinct().collect()]
    cells = domain.size(parents) * pieces
    place = F.struct(F.col("__u").alias("u"), F.col(key).alias("key"))
    ranked = with_ends(
        placed.where(F.col("__piece").isin(wanted)).join(bounded(mixed, cells), keys).withColumn(
            "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__u", key)) + F.col("__before")
        )
    ).withColumn("__code", _at_rank(F.col("__rn")))
    steps = settled(ranked.groupBy(*keys, "__code").agg(F.min(place).alias("__from"), F.max(place).alias("__to")))
    ahead = F.lag("__to").over(Window.partitionBy(*keys).orderBy("__code"))
    if not steps.select(ahead.eqNullSafe(F.col("__from")).alias("tied")).where("tied").isEmpty():
        # rows with one key stand on both sides of an end: only their ranks tell them apart
        numbered = hash_order_number(placed.select(*rows.columns, "__u"), parents, F.col("__u"), [key], "__rn")
        return with_ends(numbered).withColumn(child, _at_rank(F.col("__rn"))).drop("cdf", "__rn", "__u")
    steps = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__to").alias("to"), F.col("__code").alias("code")))).alias("__steps")
    )
    pure = F.when(F.col("__code") == F.col("__last"), F.col("__code")).alias("__pure")
    codes = settled(spans.select(*keys, pure).join(steps, keys, "left"))
    upto = F.filter("__steps", lambda s: s["to"] >= place)
    joined = placed.join(bounded(codes, cells), keys)
    return joined.select(*rows.columns, F.coalesce("__pure", F.get(upto, 0)["code"]).alias(child))


def _at_rank(rank: Column) -> Column:
    """Key of the first step of an array of running totals that reaches a rank."""
    return F.coalesce(F.get(F.filter("cdf", lambda s: s["cum"] >= rank), 0), F.element_at("cdf", -1))["key"]


def sample_tree(
    model: TreeModel, n: int, seed: str | None = None, method: str = "sample",
    start: DataFrame | None = None,
) -> DataFrame:
    """n rows (id, attributes) drawn along the tree; ``start`` may hold already drawn attributes.

    Every attribute is drawn given all drawn attributes that a path of undrawn ones leads to, so
    edges between several drawn attributes and a later one all hold.  Without ``start`` that is
    the one neighbour drawn before.
    """
    seed = fresh_seed(seed)
    step = {"sample": draw_child, "round": deal_child}[method]
    rows = start if start is not None else model.pairs.sparkSession.range(n)
    done = {c for c in rows.columns if c != "id"}
    for group in model.components():
        edges = [e for e in model.edges if set(e) <= set(group)]
        if not done & set(group):
            root = group[0]
            rows = step(rows, model.one(root), [], root, seed, model.domain)
            done.add(root)
        while ready := [e for e in edges if len(set(e) & done) == 1]:
            (child,) = set(ready[0]) - done
            around = _open_edges(edges, child, done)
            given = sorted({a for e in around for a in e} & done)
            if len(given) == 1:
                table = model.pair(*ready[0])
            else:
                table = eliminate(
                    tree_factors([(model.pair(*e), e) for e in around], child), [*given, child], model.domain
                )
            rows = step(rows, table, given, child, seed, model.domain)
            done.add(child)
    return rows.select("id", *model.domain.attrs)


def _open_edges(edges: Sequence[tuple[str, str]], attr: str, done: set[str]) -> list[tuple[str, str]]:
    """Edges of the subtree around an undrawn attribute that ends at drawn ones (metadata only)."""
    inside, border = {attr}, [attr]
    while border:
        at = border.pop()
        ahead = {a for e in edges if at in e for a in e} - done - inside
        inside |= ahead
        border.extend(ahead)
    return [e for e in edges if set(e) & inside]


def sample_table(
    table: DataFrame, domain: Domain, n: int, seed: str, buckets: int = 1024
) -> DataFrame:
    """n rows drawn from a joint table (attrs, value): cells laid on the unit interval."""
    attrs = attrs_of(table)
    cells = table.where(F.col("value") > 0).withColumn("__cell", domain.cell(attrs))
    mass = cells.select(F.sum("value")).scalar()
    top = cells.select(F.max("__cell")).scalar()
    cum = running_total(cells, "__cell", "value", "__before")
    hi = F.when(F.col("__cell") == top, F.lit(1.0)).otherwise((F.col("__before") + F.col("value")) / mass)
    spans = cum.withColumn("__lo", F.col("__before") / mass).withColumn("__hi", hi)
    rows = table.sparkSession.range(n).withColumn("__u", uniform(f"{seed}/cell", "id"))
    drawn = interval_assign(rows, "__u", spans, "__lo", "__hi", buckets, domain.size(attrs))
    return drawn.select("id", *attrs)


def mixture_sample(
    parts: DataFrame, domain: Domain, n: int, components: int, seed: str
) -> DataFrame:
    """Rows of an equal-weight mixture of products; ``parts`` is (component, attr, code, value)."""
    rows = parts.sparkSession.range(n).withColumn("component", F.col("id") % F.lit(components))
    w = Window.partitionBy("component", "attr").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    cdf = (
        parts.withColumn("cum", F.sum("value").over(w))
        .groupBy("component", "attr")
        .agg(F.sort_array(F.collect_list(F.struct("cum", F.col("code").alias("key")))).alias("cdf"), F.sum("value").alias("mass"))
    )
    # one row per component: a map from attribute to its cumulative array
    table = cdf.groupBy("component").agg(
        F.map_from_entries(F.collect_list(F.struct("attr", F.struct("cdf", "mass")))).alias("m")
    )
    rows = rows.join(bounded(table, components * sum(domain.sizes)), "component")
    draw = lambda a: pick(
        F.element_at("m", F.lit(a))["cdf"], F.element_at("m", F.lit(a))["mass"], uniform(f"{seed}/{a}", "id")
    )
    return rows.select("id", *[draw(a).alias(a) for a in domain.attrs])


def mixture_cells(parts: DataFrame, domain: Domain, total: float, components: int) -> DataFrame:
    """Expected counts of a mixture of products over the whole domain."""
    joint = None
    for a in domain.attrs:
        side = parts.where(F.col("attr") == a).select("component", F.col("code").alias(a), F.col("value").alias("__p"))
        if joint is None:
            joint = side.withColumnRenamed("__p", "value")
        else:
            joint = joint.join(side, "component").select(
                *[c for c in joint.columns if c != "value"], a, (F.col("value") * F.col("__p")).alias("value")
            )
    domain.guard()
    return joint.groupBy(*domain.attrs).agg(
        (F.sum("value") * F.lit(float(total) / components)).alias("value")
    )
