"""Models on a tree of cliques: triangulation, calibration by messages, and a fit of noisy marginals.

A measured clique holds log potentials, one for each of its cells; a model is the product of their exponentials. The
cliques of a triangulated graph form a tree in which neighbours share a separator, so exact marginals come from two
passes of messages over that tree. Graphs are metadata on the driver; potentials, messages and marginals are long
tables keyed by clique and cell, bounded by the number of cells of the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from margrid.domain import Domain
from margrid.operators.factors import eliminate
from margrid.operators.marginals import clique_chunks, clique_name
from margrid.session import BROADCAST_ROWS, bounded, settled

# Step sizes that one job tries, as powers of two of the last one.
TRIES = tuple(range(-3, 5))
_FLOOR = 1e-300
Clique = tuple[str, ...]
# Parts of a cell that are joined one by one.
SLOTS = 6
# Trees of at most this many cells are fitted inside tasks.
TASK_CELLS = BROADCAST_ROWS


@dataclass(frozen=True)
class CliqueTree:
    """Maximal cliques of a triangulated graph; ``parent`` numbers each one's neighbour towards its root, or -1."""

    domain: Domain
    cliques: tuple[Clique, ...]
    parent: tuple[int, ...]

    @classmethod
    def build(cls, domain: Domain, cliques: Sequence[Sequence[str]]) -> CliqueTree:
        """Triangulate by elimination, the attribute with the fewest new edges first, then the smallest clique."""
        around: dict[str, set[str]] = {a: set() for a in domain.attrs}
        for c in cliques:
            for a in c:
                around[a] |= set(c) - {a}
        found: list[set[str]] = []
        left = dict(around)
        while left:
            def cost(a: str) -> tuple[int, int, int]:
                near = sorted(left[a])
                fill = sum(y not in left[x] for i, x in enumerate(near) for y in near[i + 1:])
                return fill, domain.size([a, *near]), domain.attrs.index(a)

            a = min(left, key=cost)
            near = left.pop(a)
            for x in near:
                left[x] = (left[x] | near) - {x, a}
            if not any(near | {a} <= f for f in found):
                found.append(near | {a})
        names = [tuple(a for a in domain.attrs if a in f) for f in found]
        # a heaviest spanning forest by shared attributes is a tree of separators
        parent, placed = [-1] * len(names), []
        while len(placed) < len(names):
            links = [
                (len(set(names[i]) & set(names[j])), -i, -j)
                for i in range(len(names)) if i not in placed for j in placed
            ]
            shared, i, j = max(links, default=(0, 0, 0))
            if shared:
                placed.append(-i)
                parent[-i] = -j
            else:
                placed.append(min(i for i in range(len(names)) if i not in placed))
        return cls(domain, tuple(names), tuple(parent))

    @property
    def cells(self) -> int:
        return sum(self.domain.size(c) for c in self.cliques)

    @cached_property
    def levels(self) -> list[list[int]]:
        depth = {}

        def of(i: int) -> int:
            if i not in depth:
                depth[i] = 0 if self.parent[i] < 0 else of(self.parent[i]) + 1
            return depth[i]

        out: list[list[int]] = [[] for _ in range(max(map(of, range(len(self.cliques)))) + 1)]
        for i in range(len(self.cliques)):
            out[depth[i]].append(i)
        return out

    def separator(self, i: int) -> tuple[str, ...]:
        return tuple(a for a in self.cliques[i] if a in self.cliques[self.parent[i]])

    def root(self, i: int) -> int:
        while self.parent[i] >= 0:
            i = self.parent[i]
        return i

    def home(self, clique: Sequence[str]) -> int | None:
        """The smallest clique that holds these attributes."""
        fits = [i for i, c in enumerate(self.cliques) if set(clique) <= set(c)]
        return min(fits, key=lambda i: (self.domain.size(self.cliques[i]), i), default=None)


def part_cells(domain: Domain, parts: dict[Clique, list[tuple[str, Clique]]]) -> Column:
    """For a row (clique, cell), an array of (part, pcell): the cell's projections on the named parts of its clique."""
    out: Column | None = None
    for clique, named in parts.items():
        inside = dict(domain.strides(clique))
        rows = []
        for name, attrs in named:
            cell = F.lit(0).cast("bigint")
            for a, stride in domain.strides(attrs):
                cell = cell + F.expr(f"(cell div {inside[a]}L) % {domain[a]}L") * F.lit(stride).cast("bigint")
            rows.append(F.struct(F.lit(name).alias("part"), cell.alias("pcell")))
        value = F.array(*rows) if rows else F.array().cast("array<struct<part:string,pcell:bigint>>")
        hit = F.col("clique") == clique_name(clique)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _folded(table: DataFrame, domain: Domain, parts: dict, value: Column, name: str) -> DataFrame:
    """Sums of a value over the named parts: (try, part, pcell, name)."""
    long = table.select("try", F.explode(part_cells(domain, parts)).alias("p"), value.alias("v"))
    return long.groupBy("try", "p.part", "p.pcell").agg(F.sum("v").alias(name))


def _lifted(table: DataFrame, domain: Domain, parts: dict, sums: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows (try, clique, cell, b) with the parts' values added to b.

    The sums are bounded and broadcast, so cells with a few parts take them one after the other where they lie; beyond
    ``SLOTS`` parts cells are exploded and summed again.
    """
    slots = max(map(len, parts.values()), default=0)
    sums = bounded(sums, rows)
    if slots <= SLOTS:
        table = table.withColumn("p", part_cells(domain, parts))
        for k in range(slots):
            part = table.select("try", "clique", "cell", "b", "p", F.get("p", F.lit(k)).alias("q")).select(
                "try", "clique", "cell", "b", "p", "q.part", "q.pcell"
            )
            table = part.join(sums, ["try", "part", "pcell"], "left").select(
                "try", "clique", "cell", (F.col("b") + F.coalesce(name, F.lit(0.0))).alias("b"), "p"
            )
        return table.drop("p")
    long = table.select("try", "clique", "cell", "b", F.explode_outer(part_cells(domain, parts)).alias("p"))
    joined = long.select("try", "clique", "cell", "b", "p.part", "p.pcell").join(sums, ["try", "part", "pcell"], "left")
    return joined.groupBy("try", "clique", "cell").agg(
        (F.first("b") + F.coalesce(F.sum(name), F.lit(0.0))).alias("b")
    )


def _log(value: Column) -> Column:
    return F.log(F.greatest(value, F.lit(_FLOOR)))


def calibrate(tree: CliqueTree, potentials: DataFrame, tries: int = 1) -> DataFrame:
    """Marginals (try, clique, cell, value) of the tree's cliques from their log potentials (try, clique, cell, b).

    Messages go up the levels of the tree and down again, all links of a level in one join; a message is the logarithm
    of the sums over a separator; on deeper trees each level's messages are stored. Each clique's marginal sums to 1.
    """
    domain = tree.domain
    names = [clique_name(c) for c in tree.cliques]
    level = [potentials.where(F.col("clique").isin([names[i] for i in ids])) for ids in tree.levels]
    own = [{tree.cliques[i]: [(names[i], tree.separator(i))] for i in ids} for ids in tree.levels[1:]]
    kids: list[dict] = []
    for d, ids in enumerate(tree.levels[1:], 1):
        kids.append({tree.cliques[p]: [] for p in tree.levels[d - 1]})
        for i in ids:
            kids[-1][tree.cliques[tree.parent[i]]].append((names[i], tree.separator(i)))
    sizes = [tries * sum(domain.size(tree.separator(i)) for i in ids) for ids in tree.levels[1:]]
    # messages are read by both passes; the plan of a deep tree would repeat them again and again
    kept = settled if len(level) > 2 else lambda messages: messages
    ups: list[DataFrame] = []
    for d in range(len(level) - 1, 0, -1):
        up = _folded(level[d], domain, own[d - 1], F.exp("b"), "s").select("try", "part", "pcell", _log(F.col("s")).alias("m"))
        up = kept(up)
        ups.insert(0, up)
        level[d - 1] = _lifted(level[d - 1], domain, kids[d - 1], up, sizes[d - 1], "m")
    for d in range(1, len(level)):
        down = _folded(level[d - 1], domain, kids[d - 1], F.exp("b"), "s").join(
            bounded(ups[d - 1], sizes[d - 1]), ["try", "part", "pcell"]
        ).select("try", "part", "pcell", (_log(F.col("s")) - F.col("m")).alias("m"))
        level[d] = _lifted(level[d], domain, own[d - 1], kept(down), sizes[d - 1], "m")
    out = level[0]
    for part in level[1:]:
        out = out.unionByName(part)
    mass = out.groupBy("try", "clique").agg(F.sum(F.exp("b")).alias("s"))
    return out.join(bounded(mass, tries * len(names)), ["try", "clique"]).select(
        "try", "clique", "cell", (F.exp("b") / F.col("s")).alias("value")
    )


@dataclass
class CliqueModel:
    """A calibrated tree: marginals (clique, cell, value) that sum to 1, the total, and the potentials it came from.

    ``weights`` holds the measured cliques' log potentials (part, pcell, lam); ``losses`` the fit's losses in order.
    """

    tree: CliqueTree
    marginals: DataFrame
    total: float
    weights: DataFrame | None
    losses: list[float]

    def table(self, clique: Sequence[str]) -> DataFrame:
        """Probabilities of attributes that lie in one clique, with codes as columns."""
        home = self.tree.cliques[self.tree.home(clique)]
        rows = self.marginals.where(F.col("clique") == clique_name(home)).select(*self.tree.domain.decode(home), "value")
        return rows.groupBy(*clique).agg(F.sum("value").alias("value"))

    def answers(self, cliques: Sequence[Sequence[str]]) -> DataFrame:
        """Expected counts (clique, cell, value) of attribute sets; those across cliques by elimination along the tree."""
        domain, inside, parts = self.tree.domain, [], []
        homes: dict[Clique, list] = {c: [] for c in self.tree.cliques}
        for c in map(tuple, cliques):
            home = self.tree.home(c)
            if home is None:
                parts.append(self._across(c).select(
                    F.lit(clique_name(c)).alias("clique"), domain.cell(c).alias("cell"), "value"
                ))
            else:
                homes[self.tree.cliques[home]].append((clique_name(c), c))
                inside.append(c)
        if inside:
            rows = self.marginals.select(F.explode(part_cells(domain, homes)).alias("p"), "value")
            parts.append(rows.groupBy(F.col("p.part").alias("clique"), F.col("p.pcell").alias("cell")).agg(
                F.sum("value").alias("value")
            ))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("clique", "cell", (F.col("value") * F.lit(self.total)).alias("value"))

    def _across(self, clique: Clique) -> DataFrame:
        """Probabilities of attributes of several cliques: the product along their paths, summed out one by one."""
        tree = self.tree
        paths = []
        for a in clique:
            i, path = next(k for k, c in enumerate(tree.cliques) if a in c), []
            while i >= 0:
                path.append(i)
                i = tree.parent[i]
            paths.append(path)
        needed = set().union(*paths)
        factors = []
        for i in sorted(needed):
            own = self.table(tree.cliques[i])
            if tree.parent[i] >= 0:
                shared = list(tree.separator(i))
                margin = own.groupBy(*shared).agg(F.sum("value").alias("m"))
                own = own.join(margin, shared).select(
                    *tree.cliques[i], F.when(F.col("m") > 0, F.col("value") / F.col("m")).otherwise(0.0).alias("value")
                )
            factors.append(own)
        return eliminate(factors, list(clique), tree.domain)

    def sample(self, spark: SparkSession, n: int, seed: str, draw) -> DataFrame:
        """n rows (id, attributes): each clique's new attributes given its drawn ones, from the roots on.

        ``draw`` adds an attribute to rows from a table of given attributes, the attribute and ``value``.
        """
        rows, done = spark.range(n), []
        for ids in self.tree.levels:
            for i in ids:
                given = [a for a in self.tree.cliques[i] if a in done]
                for a in self.tree.cliques[i]:
                    if a not in done:
                        rows = draw(rows, self.table([*given, a]), given, a, seed, self.tree.domain)
                        given.append(a)
                        done.append(a)
        return rows.select("id", *self.tree.domain.attrs)


def _descent(
    tree: CliqueTree, homes: dict[Clique, list[tuple[str, Clique]]], total: float, rounds: int, tolerance: float
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rounds of a fit for one connected part of a tree, over its rows (root, part, pcell, noisy, share, lam).

    Rows out are (root, kind, name, cell, value) with marginals, potentials and losses. Potentials and marginals are
    arrays with an axis of tries and one for each attribute of more than one code; messages are those of ``calibrate``.
    All that tasks need is in the closure, so that they need not import this package.
    """
    domain, parent, levels, tries = tree.domain, tree.parent, tree.levels, TRIES
    names, root = [clique_name(c) for c in tree.cliques], [tree.root(i) for i in range(len(tree.cliques))]
    axes = [[a for a in c if domain[a] > 1] for c in tree.cliques]
    shape = [[domain[a] for a in wide] for wide in axes]

    def places(i: int, attrs: Sequence[str]) -> list[int]:
        return [axes[i].index(a) for a in attrs if a in axes[i]]

    links = [(places(i, tree.separator(i)), places(parent[i], tree.separator(i))) if parent[i] >= 0 else () for i in range(len(names))]
    parts = {name: (i, places(i, attrs), domain.size(attrs)) for i, c in enumerate(tree.cliques) for name, attrs in homes[c]}

    def margin(x: np.ndarray, at: list[int], sums: Callable) -> np.ndarray:
        kept = sums(x, tuple(k + 1 for k in range(x.ndim - 1) if k not in at))
        return kept.transpose(0, *[1 + sorted(at).index(k) for k in at])

    def lifted(y: np.ndarray, at: list[int], i: int) -> np.ndarray:
        ordered = y.transpose(0, *[1 + at.index(k) for k in sorted(at)])
        return ordered.reshape(len(y), *[n if k in at else 1 for k, n in enumerate(shape[i])])

    def log_sums(x: np.ndarray, axis: tuple[int, ...]) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    def marginals(lams: dict[str, np.ndarray], mine: list[list[int]], n: int) -> dict[int, np.ndarray]:
        b = {i: np.zeros((n, *shape[i])) for ids in mine for i in ids}
        for name, lam in lams.items():
            i, at, _ = parts[name]
            b[i] = b[i] + lifted(lam.reshape(n, *[shape[i][k] for k in at]), at, i)
        up = {}
        for i in (i for ids in reversed(mine[1:]) for i in ids):
            up[i] = margin(b[i], links[i][0], log_sums)
            b[parent[i]] = b[parent[i]] + lifted(up[i], links[i][1], parent[i])
        for i in (i for ids in mine[1:] for i in ids):
            down = margin(b[parent[i]], links[i][1], log_sums) - up[i]
            b[i] = b[i] + lifted(down, links[i][0], i)
        out = {}
        for i, x in b.items():
            over = tuple(range(1, x.ndim))
            e = np.exp(x - x.max(over, keepdims=True))
            out[i] = e / e.sum(over, keepdims=True)
        return out

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        at_root = int(rows["root"].iloc[0])
        mine = [[i for i in ids if root[i] == at_root] for ids in levels]
        known, noisy, share, lam = {}, {}, {}, {}
        for name, cells in rows[rows["part"].notna()].groupby("part", sort=True):
            where = cells["pcell"].to_numpy(np.int64)
            known[name] = np.zeros(parts[name][2], bool)
            known[name][where] = True
            for held, column in ((noisy, "noisy"), (share, "share"), (lam, "lam")):
                held[name] = np.zeros(parts[name][2])
                held[name][where] = cells[column].to_numpy(np.float64)

        def tried(lams: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[int, np.ndarray]]:
            found, loss, hats = marginals(lams, mine, n), np.zeros(n), {}
            for name in lams:
                i, at, cells = parts[name]
                hats[name] = margin(found[i], at, np.sum).reshape(n, cells)
                loss += (share[name] * (noisy[name] - total * hats[name]) ** 2).sum(1) / 2
            return loss, hats, found

        loss, hats, held = tried({name: v[None] for name, v in lam.items()}, 1)
        hat, held = {name: v[0] for name, v in hats.items()}, {i: v[0] for i, v in held.items()}
        history, step = [float(loss[0])], 1.0
        for _ in range(rounds if lam else 0):
            steps = step * 2.0 ** np.array(tries, float)
            lams = {}
            for name, v in lam.items():
                error = share[name] * (noisy[name] / total - hat[name])
                # a constant of a clique's potentials is free; with the largest one at 0 they don't drift
                moved = v - v[known[name]].max() + steps[:, None] * error
                lams[name] = np.where(known[name], moved, 0.0)
            loss, hats, found = tried(lams, len(steps))
            chosen = int(np.argmin(np.nan_to_num(loss, nan=np.inf)))
            if not loss[chosen] < history[-1]:
                if steps[0] < 1e-6:
                    break
                step = steps[0] * 2.0 ** tries[0]
                continue
            step = float(steps[chosen])
            lam, hat = {name: v[chosen] for name, v in lams.items()}, {name: v[chosen] for name, v in hats.items()}
            held = {i: v[chosen] for i, v in found.items()}
            history.append(float(loss[chosen]))
            if history[-2] - history[-1] <= tolerance * history[-1]:
                break
        out = [("marginal", names[i], np.arange(v.size), v.ravel()) for i, v in held.items()]
        out += [("weight", name, np.flatnonzero(known[name]), v[known[name]]) for name, v in lam.items()]
        out.append(("loss", "", np.arange(len(history)), np.array(history)))
        return pd.concat([
            pd.DataFrame({"root": at_root, "kind": kind, "name": name, "cell": cell, "value": value})
            for kind, name, cell, value in out
        ])

    return fit


def _fit_in_tasks(
    tree: CliqueTree, homes: dict[Clique, list[tuple[str, Clique]]], state: DataFrame, total: float, rounds: int, tolerance: float
) -> CliqueModel:
    """All rounds of a fit in one job: each connected part of the tree is a group, its own rounds run in one task."""
    roots = {name: tree.root(i) for i, c in enumerate(tree.cliques) for name, _ in homes[c]}
    of = F.element_at(F.create_map(*[F.lit(v) for kv in sorted(roots.items()) for v in kv]), F.col("part"))
    # a part of the tree that nothing measures has a row of its own
    bare = state.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(i) for i, p in enumerate(tree.parent) if p < 0])).alias("root")
    )
    rows = state.withColumn("root", of).unionByName(bare, allowMissingColumns=True)
    fitted = settled(rows.groupBy("root").applyInPandas(
        _descent(tree, homes, total, rounds, tolerance), "root int, kind string, name string, cell bigint, value double"
    ))
    found: dict[int, list[float]] = {}
    for r in sorted(fitted.where("kind = 'loss'").collect(), key=lambda r: r["cell"]):
        found.setdefault(r["root"], []).append(r["value"])
    longest = max(map(len, found.values()))
    return CliqueModel(
        tree, fitted.where("kind = 'marginal'").select(F.col("name").alias("clique"), "cell", "value"), total,
        fitted.where("kind = 'weight'").select(F.col("name").alias("part"), F.col("cell").alias("pcell"), F.col("value").alias("lam")),
        [sum(losses[min(k, len(losses) - 1)] for losses in found.values()) for k in range(longest)],
    )


def fit_cliques(
    measured: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], total: float,
    start: CliqueModel | None = None, rounds: int = 100, tolerance: float = 1e-4,
) -> CliqueModel:
    """The model over measured cliques that is nearest to their noisy counts, by mirror descent.

    ``measured`` is (clique, cell, noisy, stddev). The loss is half the sum of squared errors, each over the variance
    relative to the best measurement's (a stddev of 0 counts as the best); it is convex over the marginals that the tree
    allows. A round moves the potentials of every measured cell along its error, tries several step sizes in one job, and
    keeps the one with the smallest loss; the fit ends when a round takes less than ``tolerance`` of it off the loss.
    ``start`` is an earlier model to go on from, over some of the cliques. Without cliques the model is uniform.

    Connected parts of the tree meet in the total alone. A tree that is small enough to be broadcast is fitted in one job,
    a task for each connected part, with step sizes of its own; on larger ones a round is a job of keyed joins.
    """
    spark, cliques = measured.sparkSession, [tuple(c) for c in cliques]
    tree = CliqueTree.build(domain, cliques)
    homes: dict[Clique, list] = {c: [] for c in tree.cliques}
    for c in cliques:
        homes[tree.cliques[tree.home(c)]].append((clique_name(c), c))
    grid = clique_chunks(spark, domain, tree.cliques).withColumn("b", F.lit(0.0))
    if not cliques:
        return CliqueModel(tree, settled(calibrate(tree, grid.withColumn("try", F.lit(0))).drop("try")), float(total), None, [])
    parameters = sum(domain.size(c) for c in cliques)
    sizes = F.create_map(*[F.lit(v) for c in cliques for v in (clique_name(c), 1.0 / domain.size(c))])
    mine = measured.where(F.col("clique").isin([clique_name(c) for c in cliques]))
    best = mine.where(F.col("stddev") > 0).select(F.min("stddev")).scalar()
    share = F.when(F.col("stddev") > 0, F.pow(best / F.col("stddev"), F.lit(2.0))).otherwise(F.lit(1.0))
    state = mine.select(F.col("clique").alias("part"), F.col("cell").alias("pcell"), "noisy", share.alias("share"))
    warm = start is not None and start.weights is not None
    if warm:
        state = state.join(bounded(start.weights, parameters), ["part", "pcell"], "left")
        state = state.withColumn("lam", F.coalesce("lam", F.lit(0.0)))
    else:
        state = state.withColumn("lam", F.lit(0.0))
    if tree.cells <= TASK_CELLS:
        return _fit_in_tasks(tree, homes, state, float(total), rounds, tolerance)
    if warm:
        known = start.answers(cliques).select(
            F.col("clique").alias("part"), F.col("cell").alias("pcell"), (F.col("value") / F.lit(start.total)).alias("hat")
        )
        state = state.join(bounded(known, parameters), ["part", "pcell"], "left")
    else:
        state = state.withColumn("hat", F.element_at(sizes, F.col("part")))

    def losses(tried: DataFrame) -> tuple[dict[int, float], dict[int, dict[str, float]]]:
        """Loss of each try, and the largest potential of each clique."""
        off = F.col("noisy") - F.lit(float(total)) * F.col("hat")
        rows = tried.groupBy("try", "part").agg(
            (F.sum(F.col("share") * off * off) / 2).alias("loss"), F.max("lam").alias("top")
        ).collect()
        loss, tops = {}, {}
        for r in sorted(rows, key=lambda r: (r["try"], r["part"])):
            loss[r["try"]] = loss.get(r["try"], 0.0) + r["loss"]
            tops.setdefault(r["try"], {})[r["part"]] = r["top"]
        return loss, tops

    state = settled(state.withColumn("try", F.lit(0)))
    found, top = losses(state)
    history, tops, step, held = [found[0]], top[0], 1.0, None
    for _ in range(rounds):
        steps = [step * 2.0**k for k in TRIES]
        axis = F.explode(F.array(*[F.struct(F.lit(i).alias("try"), F.lit(s).alias("step")) for i, s in enumerate(steps)]))
        # a constant of a clique's potentials is free; with the largest one at 0 no exponential overflows
        largest = F.element_at(F.create_map(*[F.lit(v) for kv in sorted(tops.items()) for v in kv]), F.col("part"))
        error = F.col("share") * (F.col("noisy") / F.lit(float(total)) - F.col("hat"))
        tried = state.select("part", "pcell", "noisy", "share", "lam", error.alias("error"), axis.alias("s")).select(
            "s.try", "part", "pcell", "noisy", "share", (F.col("lam") - largest + F.col("s.step") * F.col("error")).alias("lam")
        )
        keyed = grid.withColumn("try", F.explode(F.array(*[F.lit(t) for t in range(len(steps))])))
        weights = tried.select("try", "part", "pcell", "lam")
        marginals = settled(calibrate(tree, _lifted(keyed, domain, homes, weights, len(steps) * parameters, "lam"), len(steps)))
        hats = _folded(marginals, domain, homes, F.col("value"), "hat")
        tried = settled(tried.join(bounded(hats, len(steps) * parameters), ["try", "part", "pcell"]))
        found, top = losses(tried)
        chosen = min(found, key=lambda t: (found[t], t))
        if not found[chosen] < history[-1]:
            if steps[0] < 1e-6:
                break
            step = steps[0] * 2.0 ** TRIES[0]
            continue
        mine = F.col("try") == chosen
        state, held, step, tops = tried.where(mine), marginals.where(mine), steps[chosen], top[chosen]
        history.append(found[chosen])
        if history[-2] - history[-1] <= tolerance * history[-1]:
            break
    weights = state.select("part", "pcell", "lam")
    if held is None:
        keyed = _lifted(grid.withColumn("try", F.lit(0)), domain, homes, weights.withColumn("try", F.lit(0)), parameters, "lam")
        held = settled(calibrate(tree, keyed))
    return CliqueModel(tree, held.drop("try"), float(total), weights, history)
