"""Near-duplicate embeddings by a forest of random-projection trees.

Trees split on random directions at the median, and rows near a cut go to both sides. The cuts are fitted on
a bounded sample; every row is then led to its leaves in all trees, compared in double precision with the
rows of each leaf, and links are united. A pair counts in the first tree (and leaf) in which it meets.

A crowd of vectors so near to each other that all pairs link (within half the linking angle of one centre)
needs no comparing: it is counted as a whole and does not shape the trees. In a leaf with many crowd rows these
lie in blocks. Each block has a task with all rows of the leaf outside crowds, and every two blocks have a task
where the rows of different crowds meet; crowds too far from every other one for a link stay out of the latter.

Where rows lie so densely that many pairs link without all linking, any cut parts many links. Such rows are members
of a ball around a centre that the sample shows: a ball's members don't go through the trees, but are all compared, every
two blocks of them in a task, and with its guests, the other rows near enough for a link with a member. So no link of
a member is missed, and a ball costs at most 1 / ``DENSE`` comparisons for each link that it holds, as the sample has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, stored
from margrid.llm.components import components

COSINE = 0.95
TREES = 8
# Rows of a leaf to aim at, share of a node's rows on each side of a cut that go both ways, copies of a row.
LEAF = 512
SPILL = 0.08
COPIES = 4
# Vectors that the trees are fitted on at most, in expectation: the bound of the fit.
SAMPLE = 10_000
# Crowd rows of a leaf's block.
DEAL = 4_096
# Share of a ball's sampled pairs that link at least; members lie within the linking angle of its centre.
DENSE = 0.1
_PAIR = 1 << 20


class Forest:
    """Nodes of all trees in arrays: direction, cut and spill bounds; children below 0 are leaves -1 - number."""

    def __init__(self, sample: np.ndarray, number: int, seed: int = 11):
        self.width = sample.shape[1]
        rng = np.random.default_rng(seed)
        scale = number / max(len(sample), 1)
        self.centres = self._crowds(sample, scale, rng)
        # rows lie within half the linking angle of their centre, so centres of linked rows within twice that angle
        apart = np.arccos(np.clip(self.centres @ self.centres.T, -1, 1))
        np.fill_diagonal(apart, np.inf)
        self.touching = (apart <= 2 * math.acos(COSINE) + 1e-6).any(axis=1)
        self.balls, self.blocks = self._balls(sample, scale, rng)
        sample = sample[self.ball_of(sample)[0] < 0]
        loose = sample[self.crowd_of(sample) < 0]
        least = max(LEAF / scale, 8)
        self.direction, self.low, self.high, self.child, self.roots = [], [], [], [], []
        self.leaves = 0
        for _ in range(TREES):
            self.roots.append(self._grow(loose, least, rng))
        self.direction = np.array(self.direction).reshape(-1, self.width)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)
        # blocks of a leaf's crowd rows, from the crowd rows of the sample
        self.deals = np.ones(self.leaves, np.int64)
        crowd = sample[self.crowd_of(sample) >= 0]
        if len(crowd):
            led = self.lead(crowd)
            met = np.bincount(led[led >= 0], minlength=self.leaves)
            self.deals = np.maximum(1, np.ceil(met * scale / DEAL)).astype(np.int64)

    def _crowds(self, sample: np.ndarray, scale: float, rng) -> np.ndarray:
        """Centres of crowds of more than a leaf's rows, the densest first."""
        near = math.sqrt((1 + COSINE) / 2)
        centres, left = [], sample
        while len(left) * scale > LEAF:
            probes = left[rng.choice(len(left), min(len(left), 1000), replace=False)]
            inside = probes @ left.T >= near
            densest = inside[inside.sum(axis=1).argmax()]
            if densest.sum() * scale <= LEAF or densest.sum() < 8:
                break
            centre = left[densest].mean(axis=0)
            centre /= np.linalg.norm(centre)
            held = left @ centre >= near
            if held.sum() < 0.5 * densest.sum():
                held = densest
                centre = probes[inside.sum(axis=1).argmax()]
            centres.append(centre)
            left = left[~held]
        return np.array(centres).reshape(-1, self.width)

    def _balls(self, sample: np.ndarray, scale: float, rng) -> tuple[np.ndarray, np.ndarray]:
        """Centres of dense balls of more than a leaf's rows, the fullest first, and blocks of their members."""
        centres, blocks, left = [], [], sample
        while len(left) * scale > LEAF:
            probes = left[rng.choice(len(left), min(len(left), 1000), replace=False)]
            full = (probes @ left.T >= COSINE).sum(axis=1)
            inside = left[left @ probes[full.argmax()] >= COSINE]
            if len(inside) * scale <= LEAF or len(inside) < 8:
                break
            centre = inside.mean(axis=0)
            centre /= np.linalg.norm(centre)
            held = left @ centre >= COSINE
            some = left[held][:1000]
            if held.sum() < len(inside) or (some @ some.T >= COSINE).mean() < DENSE:
                held, centre = left @ probes[full.argmax()] >= COSINE, probes[full.argmax()]
                some = left[held][:1000]
                if (some @ some.T >= COSINE).mean() < DENSE:
                    break
            centres.append(centre)
            blocks.append(max(1, math.ceil(held.sum() * scale / DEAL)))
            left = left[~held]
        return np.array(centres).reshape(-1, self.width), np.array(blocks, np.int64)

    def ball_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ball of which each row is a member, else -1, and whether it is a member or guest: rows x balls."""
        if not len(self.balls) or not len(rows):
            return np.full(len(rows), -1, np.int64), np.zeros((len(rows), len(self.balls)), bool)
        close = rows @ self.balls.T
        member = close >= COSINE
        ball = np.where(member.any(axis=1), member.argmax(axis=1), -1)
        # a guest lies within the linking angle of a member, so within twice that angle of the centre
        near = close >= math.cos(2 * math.acos(COSINE) + 1e-6)
        # links with members of an earlier ball are that ball's
        return ball, near & ((ball[:, None] < 0) | (np.arange(len(self.balls)) <= ball[:, None]))

    def crowd_of(self, rows: np.ndarray) -> np.ndarray:
        """The nearest centre within half the linking angle, else -1: two rows of one crowd always link."""
        if not len(self.centres) or not len(rows):
            return np.full(len(rows), -1, np.int64)
        # a hair inside the exact bound, so that rounding never claims a link that is none
        near = math.cos(math.acos(COSINE) / 2 - 1e-6)
        close = rows @ self.centres.T
        best = close.argmax(axis=1)
        return np.where(close[np.arange(len(rows)), best] >= near, best, -1)

    def _grow(self, rows: np.ndarray, least: float, rng) -> int:
        if len(rows) <= least:
            self.leaves += 1
            return -self.leaves
        direction = rng.normal(size=self.width)
        direction /= np.linalg.norm(direction)
        at = rows @ direction
        low, cut, high = np.quantile(at, [0.5 - SPILL, 0.5, 0.5 + SPILL])
        node = len(self.child)
        self.direction.append(direction)
        self.low.append(low)
        self.high.append(high)
        self.child.append([0, 0])
        if not (at < cut).any():  # all on one cut: nothing splits them
            self.leaves += 1
            self.child[node] = [-self.leaves, -self.leaves]
            return node
        left = self._grow(rows[at < cut], least, rng)
        right = self._grow(rows[at >= cut], least, rng)
        self.child[node] = [left, right]
        return node

    def lead(self, rows: np.ndarray) -> np.ndarray:
        """Leaves of each row: rows x trees x copies, -1 where there is none."""
        out = np.full((len(rows), TREES, COPIES), -1, np.int32)
        for t, root in enumerate(self.roots):
            row, node = np.arange(len(rows)), np.full(len(rows), root)
            while True:
                inner = np.flatnonzero(node >= 0)
                if not len(inner):
                    break
                n, r = node[inner], row[inner]
                at = np.einsum("ij,ij->i", rows[r], self.direction[n])
                middle = (self.low[n] + self.high[n]) / 2
                copies = np.bincount(row, minlength=len(rows))[r]
                both = (at >= self.low[n]) & (at <= self.high[n]) & (copies <= COPIES // 2)
                node[inner] = self.child[n, (at >= middle).astype(int)]
                other = self.child[n, (at < middle).astype(int)][both]
                row, node = np.concatenate([row, r[both]]), np.concatenate([node, other])
            order = np.lexsort((node, row))
            row, leaf = row[order], -1 - node[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])
            row, leaf = row[fresh], leaf[fresh]
            first = np.searchsorted(row, np.arange(len(rows)))
            out[row, t, np.arange(len(row)) - first[row]] = leaf
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, of double components packed as bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)
    return raw / np.linalg.norm(raw / np.abs(raw).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(
        raw
    ).max(axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding) to (vec_id, width, packed doubles); unusable vectors have width 0."""
    for batch in batches:
        widths, packed = [], []
        for v in batch.column("embedding").to_pylist():
            good = v is not None and len(v) > 0 and None not in v
            a = np.asarray(v if good else [], "<f8")
            good = good and bool(np.isfinite(a).all()) and bool(a.any())
            widths.append(len(a) if good else 0)
            packed.append(a.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(widths, pa.int64()), pa.array(packed, pa.binary())],
            names=["vec_id", "width", "vector"],
        )


def _route(forest: Forest):
    """Rows (key, copies, vector) to one row for each leaf and deal, which is a pair of the leaf's blocks.

    Balls are leaves below 0. Rows outside crowds and guests go to the deals of one block with itself, crowd rows and
    members to those of their block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                rows = _matrix(batch.column("vector"), forest.width)
                crowd, led = forest.crowd_of(rows), forest.lead(rows)
                ball, near = forest.ball_of(rows)
                led[ball >= 0] = -1
                i, _, _ = spot = np.nonzero(led >= 0)
                leaf = led[spot].astype(np.int64)
                guest, of = np.nonzero(near)
                # row numbers of the class keys' first digits deal crowd rows alike in every run
                lot = np.array([int(k[:8], 16) for k in batch.column("key").to_pylist()])
                deals = np.concatenate([forest.deals[leaf], forest.blocks[of]])
                held = np.concatenate([crowd[i] >= 0, ball[guest] == of])
                i, leaf = np.concatenate([i, guest]), np.concatenate([leaf, -1 - of])
                alone = (leaf >= 0) & (crowd[i] >= 0) & ~np.append(forest.touching, False)[crowd[i]]
                times = np.where(alone, 1, deals)
                again = np.repeat(np.arange(len(leaf)), times)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                own = np.where(held, lot[i] % deals, -1)
                block = own[again]
                nth = np.where(alone[again], block, nth)
                block = np.where(block < 0, nth, block)
                deal = np.minimum(block, nth) * _PAIR + np.maximum(block, nth)
                taken = i[again]
                bytes_ = [led[k].tobytes() for k in range(len(batch))]
                # what a task gets at a time stays small, however many blocks a ball has
                for start in range(0, len(taken), 1 << 14):
                    some = slice(start, start + (1 << 14))
                    picked = batch.select(["key", "copies", "vector"]).take(pa.array(taken[some]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[again[some]]), pa.array(deal[some].astype(np.int64)), *picked.columns,
                         pa.array(crowd[taken[some]]), pa.array(ball[taken[some]]), pa.array(block[some].astype(np.int64)),
                         pa.array([bytes_[k] for k in taken[some]], pa.binary())],
                        names=["leaf", "deal", "key", "copies", "vector", "crowd", "ball", "block", "leaves"],
                    )

    return run


def _compare(width: int):
    """One leaf's rows (or one deal of them) to the links of each row and the smallest row it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        leaf, deal = table.column("leaf")[0].as_py(), table.column("deal")[0].as_py()
        keys = table.column("key").to_pylist()
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        table = table.take(pa.array(order))
        keys = table.column("key").to_pylist()
        rows = _matrix(table.column("vector"), width)
        copies, crowd = table.column("copies").to_numpy(), table.column("crowd").to_numpy()
        block, ball = table.column("block").to_numpy(), table.column("ball").to_numpy()
        leaves = np.frombuffer(b"".join(table.column("leaves").to_pylist()), np.int32).reshape(len(rows), -1, COPIES)
        tree = int(np.nonzero((leaves[0] == leaf).any(axis=1))[0][0]) if leaf >= 0 else 0
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(rows), 512):
            i, j = np.nonzero(rows[at:at + 512] @ rows[at:].T >= COSINE)
            i, j = i + at, j + at
            keep = (i < j) & ((crowd[i] != crowd[j]) | (crowd[i] < 0))
            if leaf < 0:  # links of a member with members and guests
                keep &= (ball[i] == -1 - leaf) | (ball[j] == -1 - leaf)
            if deal // _PAIR != deal % _PAIR:  # pairs inside a block belong to its own deal
                keep &= block[i] != block[j]
            elif deal and leaf >= 0:  # rows outside crowds stand in every block's own deal; their pairs belong to the first
                keep &= (crowd[i] >= 0) | (crowd[j] >= 0)
            i, j = i[keep], j[keep]
            if leaf >= 0:
                new = np.ones(len(i), bool)
                for t in range(tree):
                    new &= ~((leaves[i, t, :, None] == leaves[j, t, None, :]) & (leaves[i, t, :, None] >= 0)).any((1, 2))
                shared = (leaves[i, tree, :, None] == leaves[j, tree, None, :]) & (leaves[i, tree, :, None] >= 0)
                lowest = np.where(shared, leaves[i, tree, :, None], np.iinfo(np.int32).max).min((1, 2), initial=2**31 - 1)
                new &= lowest == leaf
                i, j = i[new], j[new]
            links += np.bincount(i, copies[j], len(rows)).astype(np.int64)
            links += np.bincount(j, copies[i], len(rows)).astype(np.int64)
            # one link for each root met is enough to unite them
            heads = np.array([find(k) for k in range(len(rows))])
            met = np.unique(heads[i] * len(rows) + heads[j])
            for a, b in zip((met // len(rows)).tolist(), (met % len(rows)).tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        met = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[k] for k in met], pa.string()),
            "links": pa.array(links[met], pa.int64()),
            "root": pa.array([keys[find(k)] for k in met.tolist()], pa.string()),
        })

    return run


def _crowds(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowd = forest.crowd_of(_matrix(batch.column("vector"), forest.width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("copies"), pa.array(crowd)], names=["key", "copies", "crowd"]
            )

    return run


def _search(rows: DataFrame, width: int, number: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Links of classes of one width: (key, links) sums and edges (a, b)."""
    share = min(1.0, sample / number)
    drawn = rows.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    vectors = [bytes(r["vector"]) for r in drawn.orderBy("key").select("vector").collect()]
    forest = Forest(_matrix(pa.array(vectors, pa.binary()), width) if vectors else np.empty((0, width)), number)
    routed = in_tasks(
        rows.select("key", "copies", "vector"), _route(forest),
        "leaf long, deal long, key string, copies long, vector binary, crowd long, ball long, block long, leaves binary",
    )
    met = stored(routed.groupBy("leaf", "deal").applyInArrow(_compare(width), "key string, links long, root string"))
    links = met.select("key", "links")
    edges = met.select(F.col("key").alias("a"), F.col("root").alias("b"))
    if len(forest.centres):
        crowds = stored(
            in_tasks(rows.select("key", "copies", "vector"), _crowds(forest), "key string, copies long, crowd long")
            .where("crowd >= 0")
        )
        # as many rows as there are centres, which the sample bounds
        whole = F.broadcast(crowds.groupBy("crowd").agg(F.sum("copies").alias("all"), F.min("key").alias("head")))
        joined = crowds.join(whole, "crowd")
        links = links.union(joined.select("key", (F.col("all") - F.col("copies")).alias("links")))
        edges = edges.union(joined.select(F.col("key").alias("a"), F.col("head").alias("b")))
    return links, edges


def embedding_duplicates(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reached), kept.

    Vectors link at a cosine of 0.95 in double precision; vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of different length never link. Equal vectors are one
    class of copies that link with each other. Rows without a vec_id link like others, but never name a
    group. The search finds links with a recall that tests measure; none below the bound is ever given.
    """
    packed = in_tasks(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")),
        _pack, "vec_id long, width long, vector binary",
    )
    packed = stored(packed.withColumn("key", F.md5("vector")))
    classes = stored(
        packed.where("width > 0").groupBy("width", "key").agg(
            F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.min("vector").alias("vector")
        )
    )
    links = edges = None
    # embeddings of a table have one width, or a handful
    for r in classes.groupBy("width").count().orderBy("width").collect():
        some = classes.where(F.col("width") == r["width"])
        a, b = _search(some, r["width"], r["count"], sample)
        links, edges = (a, b) if links is None else (links.union(a), edges.union(b))
    single = F.col("vec_id").alias("component_id")
    if links is None:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), single, F.lit(True).alias("kept"))
    roots = stored(components(edges)).withColumnRenamed("node", "key")
    total = links.groupBy("key").agg(F.sum("links").alias("links"))
    table = classes.select("key", "copies", "low").join(roots, "key", "left").join(total, "key", "left")
    table = stored(table.withColumn("root", F.coalesce("root", "key")))
    lows = table.groupBy("root").agg(F.min("low").alias("component"))
    table = table.join(lows, "root").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    component = F.when(F.col("width") > 0, F.col("component")).otherwise(F.col("vec_id"))
    return packed.join(table, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
