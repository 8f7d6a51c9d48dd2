"""Byte-balanced shards by sampled splitters.

Rows are ordered by a key that puts equal texts next to each other and spreads a group of copies by doc_id.
A sample weighted by size gives splitters at its quantiles; rows fall in ranges between them, ranges that
turn out overfull are subdivided by hash, and exact running sizes within ranges, on top of the sums of the
ranges before, cut the order into shards of equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, stored

# Rows of a range that one task orders, and bounds on the number of ranges (splitters go to the driver).
RANGE_ROWS = 20_000
RANGES = (64, 65_536)
DRAWS = 16


def _range_of(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(splitters, batch.column("key").to_numpy(), side="right")
            yield batch.append_column("band", pa.array(at.astype(np.int64)))

    return run


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    The law is ``bytes``: size is the text's UTF-8 bytes plus 1 (null: 1), and the shards' sums differ by less
    than the largest document. Slots number each shard's rows from 0. Repeated rows take slots of their own;
    rows without a doc_id are placed like others. No documents, no rows.
    """
    empty = F.coalesce(F.col("text"), F.lit(""))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(empty) + 1).cast("long").alias("size"),
        F.crc32(empty.cast("binary")).alias("text_crc32"),
        F.shiftleft(low(F.xxhash64(empty)), 32).bitwiseOR(
            low(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("row")))
        ).alias("key"),
    )
    # Equal rows are counted once, so that no group of repeated rows meets in one task.
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies")))
    number, total = rows.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("copies"))).first()
    out = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if not number:
        return rows.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    ranges = min(max(RANGES[0], -(-number // RANGE_ROWS)), RANGES[1])
    unit = (low(F.xxhash64("key", F.lit("draw"))) + 0.5) / float(1 << 32)
    drawn = rows.where(unit < F.col("size") * F.col("copies") * (DRAWS * ranges / total)).select("key")
    sample = np.sort(np.array([r["key"] for r in drawn.collect()], np.int64))
    splitters = np.unique(sample[DRAWS // 2::DRAWS])
    banded = in_tasks(
        rows, _range_of(splitters), "doc_id long, size long, text_crc32 long, key long, copies long, band long"
    )
    weights = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    overfull = {b: -(-n // RANGE_ROWS) for b, n in weights.items() if n > 2 * RANGE_ROWS}
    if overfull:
        spark = docs.sparkSession
        pieces = F.broadcast(spark.createDataFrame(list(overfull.items()), "band long, pieces long"))
        banded = banded.join(pieces, "band", "left").withColumn(
            "sub", F.coalesce(F.pmod(F.xxhash64("doc_id", "key"), F.col("pieces")), F.lit(0))
        ).drop("pieces")
    else:
        banded = banded.withColumn("sub", F.lit(0).cast("long"))
    banded = stored(banded)
    mass = F.col("size") * F.col("copies")
    sums = banded.groupBy("band", "sub").agg(F.sum(mass).alias("b"), F.sum("copies").alias("n")).collect()
    before, bytes_, rows_ = [], 0, 0
    for r in sorted(sums, key=lambda r: (r["band"], r["sub"])):
        before.append((r["band"], r["sub"], bytes_, rows_))
        bytes_, rows_ = bytes_ + r["b"], rows_ + r["n"]
    ahead = F.broadcast(
        docs.sparkSession.createDataFrame(before, "band long, sub long, bytes_before long, rows_before long")
    )
    order = Window.partitionBy("band", "sub").orderBy("key", "doc_id", "size", "text_crc32")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        banded.withColumn("b", F.coalesce(F.sum(mass).over(running), F.lit(0)))
        .withColumn("n", F.coalesce(F.sum("copies").over(running), F.lit(0)))
        .join(ahead, ["band", "sub"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("begin", F.col("bytes_before") + F.col("b") + F.col("copy") * F.col("size"))
        .withColumn("at", F.col("rows_before") + F.col("n") + F.col("copy"))
    )
    # the middle of a row decides, in whole numbers: both sides are doubled
    middle = (F.col("begin") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = stored(
        placed.select(
            "doc_id", "size", "text_crc32", "at",
            F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")).cast("int").alias("shard"),
        )
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("first")))  # one row a shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ).select(out)
