"""Whitening of embeddings with exact scatter sums from bit slices.

Vectors become integers by a grid. Over the distinct ones, each dimension is shifted to start at zero and cut into bit
planes; a plane holds one bit of every row, packed into 64-bit words. The number of rows where two bits are both set is
the popcount of the AND of their planes, so the sum of products of two dimensions is a sum of popcounts weighted by
powers of two: exact, whatever the number of rows. Tasks send popcounts by (dimension, dimension, power), a table
bounded by the dimensions and their bits; the driver puts them together as integers, centres them as integers and
only then goes to floating point for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, stored

STEP = 64
ORIGIN = 1_000_000
COMPONENTS = 16
# Rows whose bits are sliced at a time: the planes of a block stay in a core's cache.
BLOCK = 1 << 14
# Rows that go back in one batch, each once a component.
ROWS = 2048
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Whitener:
    """Exact sums of the fit list and its components, largest eigenvalue first.

    ``widest`` is the largest range of a dimension; ``values`` are eigenvalues, ``vectors`` unit eigenvectors as
    columns, ``rank`` how many values are above rounding.
    """

    rows: int
    low: tuple[int, ...]
    widest: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rank: int

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact (longs, or Python integers where longs could overflow), and x - S / n."""
        shift = [s - self.rows * low for s, low in zip(self.sums, self.low, strict=True)]
        if self.rows * self.widest < 2**62:
            exact = self.rows * (x - np.array(self.low, np.int64)) - np.array(shift, np.int64)
        else:
            exact = self.rows * (x.astype(object) - np.array(self.low, object)) - np.array(shift, object)
        return exact, (exact / self.rows).astype(float)

    def deviation(self, exact: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; null beyond the range of a long."""
        most = int(np.abs(exact).max()) if exact.size else 0
        if exact.dtype != object and most * most * exact.shape[1] < _LONG.max:
            return (exact * exact).sum(axis=1).tolist()
        sums = (exact.astype(object) ** 2).sum(axis=1).tolist()
        return [s if s <= _LONG.max else None for s in sums]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; components without spread are left out (not a number)."""
        out = np.full((len(centred), len(self.values)), np.nan)
        out[:, : self.rank] = centred @ self.vectors[:, : self.rank] / np.sqrt(self.values[: self.rank])
        return out


def grid(column: pa.Array, step: int = STEP, origin: int = ORIGIN) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the usable rows and their vectors as longs, floor(step * c) + origin each.

    Unusable are nulls, empty vectors and those with null or non-finite entries. Values beyond longs end there.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(step * flat)
        inside = np.abs(scaled) < 2.0**62
        x = np.where(inside, scaled, 0).astype(np.int64) + origin
    x[~inside & (scaled > 0)] = _LONG.max
    x[~inside & (scaled < 0)] = _LONG.min
    return good, [x[ends[i] - sizes[i]:ends[i]] for i in good]


def _packed(step: int, origin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = grid(batch.column(0), step, origin)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["size", "x"],
            )

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i8").reshape(-1, dims)


def _ranges(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(dims), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))],
                    names=["dim", "low", "high"],
                )

    return run


def planes(x: np.ndarray, low: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of the shifted dimensions, one row a plane, rows of ``x`` packed into words of 64 bits."""
    shifted = (x.astype(np.uint64) - low.astype(np.uint64)).T  # modulo 2**64, where the difference lies
    rows = -(-len(x) // 64) * 64
    out = np.zeros((sum(bits), rows), np.uint8)
    at = 0
    for values, number in zip(shifted, bits, strict=True):
        for bit in range(number):
            out[at, : len(x)] = (values >> np.uint64(bit)) & np.uint64(1)
            at += 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _popcounts(low: np.ndarray, bits: list[int], dims: int, block: int):
    """Rows i, j, power, n: how often a bit of dimension i and one of j, weighing 2**power, are both set; n at i = -1
    is the number of rows, and i = j holds the plain sums in j + dims."""
    owner = np.repeat(np.arange(dims), bits)
    power = np.concatenate([np.arange(b) for b in bits]) if len(owner) else np.zeros(0, int)
    first, second = np.triu_indices(len(owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((len(owner), len(owner)), np.int64), 0
        for batch in batches:
            whole = _matrix(batch.column("x"), dims)
            rows += len(whole)
            for start in range(0, len(whole), block):
                sliced = planes(whole[start:start + block], low, bits)
                for p in range(len(sliced)):
                    counts[p, p:] += np.bitwise_count(sliced[p] & sliced[p:]).sum(axis=1, dtype=np.int64)
        if not rows:
            return
        # planes of one dimension meet twice in its square, once for each order
        twice = np.where((owner[first] == owner[second]) & (first != second), 2, 1)
        table = {
            "i": np.concatenate([[-1], owner, owner[first]]),
            "j": np.concatenate([[-1], np.full(len(owner), -1), owner[second]]),
            "power": np.concatenate([[0], power, power[first] + power[second]]),
            "n": np.concatenate([[rows], counts.diagonal(), counts[first, second] * twice]),
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array(table[c], pa.int64() if c == "n" else pa.int32()) for c in table], names=list(table)
        )

    return run


def _moments(model: Whitener, dims: int):
    """Partial sums of the whitened fit list and of its products, over the components with spread."""
    k = model.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(model.centred(_matrix(batch.column("x"), dims))[1])[:, :k]
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(k, -1), i.ravel()]), pa.int32()),
                pa.array(np.concatenate([np.arange(k), j.ravel()]), pa.int32()),
                pa.array(np.concatenate([sums, products.ravel()])),
            ],
            names=["i", "j", "v"],
        )

    return run


def fit(unique: DataFrame, dims: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitener:
    """Exact mean and covariance of the rows of ``unique`` (column x: longs as bytes) and their components."""
    ranges = in_tasks(unique.select("x"), _ranges(dims), "dim int, low long, high long")
    found = {r["dim"]: r for r in ranges.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low = [found[i]["low"] for i in range(dims)]
    bits = [(found[i]["high"] - low[i]).bit_length() for i in range(dims)]
    counts = in_tasks(
        unique.select("x"), _popcounts(np.array(low, np.int64), bits, dims, block), "i int, j int, power int, n long"
    )
    rows, shifted = 0, [0] * dims
    products = [[0] * dims for _ in range(dims)]
    # the table is bounded by dimensions and bits, not by rows
    for r in counts.groupBy("i", "j", "power").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            rows += r["n"]
        elif r["j"] < 0:
            shifted[r["i"]] += r["n"] << r["power"]
        else:
            products[r["i"]][r["j"]] += r["n"] << r["power"]
    # n * sum of products - product of sums is n^2 times the covariance; a shift of a dimension leaves it as it is
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (rows * products[i][j] - shifted[i] * shifted[j]) / (rows * rows)
    trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    rank = int((values > dims * np.finfo(float).eps * max(trace, 0)).sum())
    sums = tuple(s + rows * v for s, v in zip(shifted, low, strict=True))
    widest = max(found[i]["high"] - low[i] for i in range(dims))
    return Whitener(rows, tuple(low), widest, sums, values.copy(), vectors.copy(), trace, rank)


def identity_error(unique: DataFrame, model: Whitener, dims: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; null without components."""
    if not model.rank:
        return None
    found = in_tasks(unique.select("x"), _moments(model, dims), "i int, j int, v double")
    sums, products = np.zeros(model.rank), np.zeros((model.rank, model.rank))
    for r in found.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            sums[r["j"]] = r["v"]
        else:
            products[r["i"], r["j"]] = r["v"]
    mean = sums / model.rows
    return float(np.abs(products / model.rows - np.outer(mean, mean) - np.eye(model.rank)).max())


_OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _whitened(model: Whitener, dims: int, error: float | None, step: int, origin: int):
    number = len(model.values)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, found = grid(batch.column("embedding"), step, origin)
            keep = [k for k, v in enumerate(found) if len(v) == dims]
            for start in range(0, len(keep), ROWS):
                some = keep[start:start + ROWS]
                exact, centred = model.centred(np.stack([found[k] for k in some]))
                w = model.project(centred)
                ids = batch.column("vec_id").take(pa.array(good[some]))
                rows = np.repeat(np.arange(len(some)), number)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, number + 1), len(some)), pa.int32()),
                        pa.array(np.full(len(rows), model.rows), pa.int64()),
                        pa.array(model.deviation(exact), pa.int64()).take(pa.array(rows)),
                        pa.array(w.ravel(), from_pandas=True), pa.array(explained * len(some), pa.float64()),
                        pa.array([error] * len(rows), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, step: int = STEP, origin: int = ORIGIN, block: int = BLOCK
) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those whose length is
    not the commonest (of equally common ones the smallest). The fit counts each distinct grid vector once; repeated rows
    are all given. Components number from 1 by falling eigenvalue, as many as dimensions if those are fewer. A component
    without spread has null for ``whitened``; without any spread ``explained`` and ``identity_error`` are null, too.
    ``deviation`` is null where it exceeds a long. No usable rows, no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    distinct = stored(in_tasks(rows.select("embedding"), _packed(step, origin), "size int, x binary").groupBy("size", "x").agg(
        F.count(F.lit(1)).alias("n")
    ))
    sizes = distinct.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    dims = sizes["size"]
    unique = distinct.where(F.col("size") == dims)
    model = fit(unique, dims, components, block)
    error = identity_error(unique, model, dims)
    return in_tasks(rows, _whitened(model, dims, error, step, origin), _OUT)
