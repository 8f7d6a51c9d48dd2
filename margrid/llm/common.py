"""Shared helpers of the training-data operators: stored tables, word hashing, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from margrid.session import ensure_checkpoint_dir

# Bytes of text that one step of a task works on; longer documents are cut at white space.
CHUNK_BYTES = 1 << 20

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = np.uint64(0x9E3779B97F4A7C15)

# ASCII white space as the word rule of the contracts has it, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_find_package(spark: SparkSession) -> None:
    """Python workers started from now on look for this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def release_memory() -> None:
    """Give memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim:
        trim(0)


def giving_back(work: Callable) -> Callable:
    """``work`` over batches that gives unused memory back to the system after each result.

    Python workers live on from stage to stage and keep what one task freed; that was two thirds of a worker's memory.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            for out in work(batches):
                yield out
                del out
                release_memory()
        finally:
            release_memory()

    return run


def in_tasks(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where the driver found it."""
    workers_find_package(df.sparkSession)
    return df.mapInArrow(giving_back(work), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def _hash_words(
    data: np.ndarray, first: np.ndarray, space: np.ndarray, most: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of one chunk; ``first`` marks bytes where a text begins."""
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    run = np.repeat(starts, np.diff(np.append(starts, len(data))))
    place = np.arange(starts[0], len(data)) - run
    value = data[starts[0]:].astype(np.uint64) + np.uint64(1)
    value[space[starts[0]:]] = 0
    if most is not None:
        value[place >= most] = 0
    longest = int(place[value > 0].max()) + 1
    np.minimum(place, longest, out=place)  # white space after a word weighs nothing
    value *= _power_table(longest + 1)[place]
    return mix(np.add.reduceat(value, starts - starts[0])), starts


def word_hashes(
    column: pa.Array, most: int | None = None, gaps: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and each text's first word (one more at the end).

    Words are runs without the bytes of ``gaps`` (ASCII white space), A-Z lower-cased; nulls have none. With
    ``most``, a word is hashed by its first bytes alone.
    """
    column = column.cast(pa.large_string())
    texts = len(column)
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, texts + 1, column.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.empty(0, np.uint64), np.zeros(texts + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    hashes, places, at = [], [], low
    while at < high:
        end = min(at + CHUNK_BYTES, high)
        if end < high:  # go on to a gap or to the next text
            text_end = int(offsets[np.searchsorted(offsets, end)])
            while end < text_end:
                ahead = gaps[data[end:min(end + 4096, text_end)]]
                end += int(ahead.argmax()) if ahead.any() else len(ahead)
                if ahead.any():
                    break
        chunk = data[at:end]
        first = np.zeros(end - at, bool)
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        first[inside] = True
        h, s = _hash_words(LOWER[chunk], first, gaps[chunk], most)
        hashes.append(h)
        places.append(s + at)
        at = end
    starts = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 8 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of a few MB of text, each with one row at least."""
    sizes = [0 if v is None else v for v in pc.binary_length(batch.column(text)).to_pylist()]
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield batch.slice(at)
