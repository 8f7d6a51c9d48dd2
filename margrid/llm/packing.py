"""Sequence packing by shortest pack first over the histogram of lengths.

Documents become token ids with a closing id; each is cut into full pieces and a last piece that is
shorter than a sequence. Full pieces are sequences of their own. Of the last pieces only the histogram of
their lengths (at most ``budget`` - 1 of them, whatever the corpus) goes to the driver: lengths are placed from the
longest down, each into the emptiest pack that it fits, keeping how many packs have one pattern instead of
packs. Pieces then take places of the patterns by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrid.llm import pieces
from margrid.llm.common import in_tasks, slices, stored

BUDGET = 2048
CLOSING = 1
# Ranks are counted in this many parts for each length and million pieces.
PART_ROWS = 20_000

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long"
)


def _cut(path: str, budget: int, closing: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part")])
    end = np.array([closing], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=pieces.SLICE):
                rows: list[list] = [[] for _ in schema]
                ids = batch.column("doc_id").to_pylist()
                for doc, packed in zip(ids, pieces.word_ids(path, batch.column("text")), strict=True):
                    packed = np.concatenate([packed, end])
                    total = len(packed)
                    for start in range(0, total, budget):
                        piece = packed[start:start + budget]
                        crc = zlib.crc32(piece.tobytes())
                        # the part spreads equal lengths; it hangs on the piece alone, so a new run agrees
                        part = zlib.crc32(f"{doc}/{start}/{crc}".encode())
                        for column, v in zip(rows, (doc, start, len(piece), crc, total, part), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return run


def patterns(histogram: dict[int, int], budget: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one pack, number of such packs), by shortest pack first.

    Lengths go from the longest down; a length goes to the packs with the most room. Patterns number about
    as many as distinct lengths, however many pieces there are.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # rooms that some pack has, ascending

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in packs:
            packs[room] = []
            insort(rooms, room)
        packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms[-1] if rooms and rooms[-1] >= length else None
            if room is None:
                # no pack has room: new packs hold as many of this length as fit
                fit = budget // length
                if left >= fit:
                    put(budget - fit * length, (length,) * fit, left // fit)
                    left %= fit
                else:
                    put(budget - left * length, (length,) * left, 1)
                    left = 0
                continue
            pattern, count = packs[room].pop()
            if not packs[room]:
                del packs[room]
                rooms.pop(bisect_left(rooms, room))
            used = min(left, count)
            put(room - length, (*pattern, length), used)
            if count > used:
                put(room, pattern, count - used)
            left -= used
    return [p for room in sorted(packs) for p in packs[room]]


def places(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Runs of places (length, first rank, number, first pack, offset); ranks of a length are gapless."""
    runs, ranks, pack = [], {}, 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            runs.append((length, first, count, pack, offset))
            ranks[length] = first + count
            offset += length
        pack += count
    return runs


def pack(docs: DataFrame, tokenizer: str, budget: int = BUDGET, closing: int = CLOSING) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document gives its ids and the closing id, so null and empty texts give one piece of length 1;
    repeated rows give their pieces again. No documents, no rows. Sequences of ``budget`` ids number from 0;
    pieces lie in them without gaps.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(in_tasks(rows, _cut(tokenizer, budget, closing), _PIECES))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return cut.select(
            *[c for c in cut.columns if c != "part"],
            F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    runs = places(patterns(counts, budget))
    run_rows = spark.createDataFrame(
        runs, "length long, first long, number long, pack long, offset long"
    )
    # Ranks within a length: each length's pieces are cut into parts by hash, ranked in each part, and the
    # sizes of the parts before are added, so that a length of a third of all pieces fills many tasks.
    parts = {k: max(1, -(-n // PART_ROWS)) for k, n in counts.items()}
    width = spark.createDataFrame([(k, v) for k, v in parts.items()], "length long, parts long")
    split = cut.join(F.broadcast(width), "length").withColumn("part", F.col("part") % F.col("parts"))
    sizes = split.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "length", "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = split.withColumn("rank", F.row_number().over(order)).join(before, ["length", "part"]).withColumn(
        "rank", F.col("rank") - 1 + F.col("before")
    )
    # Patterns are bounded by the histogram, not by the corpus, so the runs of places fit every executor.
    run = F.broadcast(run_rows.withColumnRenamed("length", "run_length"))
    placed = ranked.join(
        run, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first"))
        & (F.col("rank") < F.col("first") + F.col("number")),
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("pack") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
