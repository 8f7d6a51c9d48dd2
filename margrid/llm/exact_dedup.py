"""Exact deduplication by 128-bit content hashes, in DataFrame operations only.

A text's key is the 128-bit hash of its bytes. Rows are grouped by key, and inside a key the bytes themselves are
compared: texts are folded by (key, bytes) before and after the shuffle, so a group of copies that holds a third of
all rows travels as one row a task. A key under which different bytes stand is a collision; its texts get
numbers, and rows are grouped by key and number. Only keys, ids and counts are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Groups that hold at least this share of all rows are joined by broadcast: there are at most 1 / HOT of them.
HOT = 1 / 1000


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _identified(docs: DataFrame, normal: Callable, key: Callable) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("body"))
    return rows.select("doc_id", key(F.col("body")).alias("key"), "body")


def collisions(docs: DataFrame, normal: Callable = lowered, key: Callable = content_hash) -> DataFrame:
    """Keys under which different bytes stand: key and body (the bytes as text), numbered from 0 by bytes."""
    folded = _identified(docs, normal, key).groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"))
    # the bytes have done their work here; what goes on is the key, the number of texts and their smallest size
    texts = folded.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    shared = stored(texts.select("key"))
    if shared.isEmpty():
        return folded.select("key", "body", F.lit(0).alias("variant")).limit(0)
    order = Window.partitionBy("key").orderBy("body")
    again = _identified(docs, normal, key).join(shared, "key", "left_semi").groupBy("key", "body").agg(
        F.count(F.lit(1)).alias("n")
    )
    return stored(again.select("key", "body", (F.row_number().over(order) - 1).alias("variant")))


def _rows(docs: DataFrame, normal: Callable, key: Callable) -> DataFrame:
    """Rows doc_id, key, variant (the text's number under its key), row (unique), text_sha256."""
    rows = _identified(docs, normal, key)
    same = collisions(docs, normal, key)
    sha = F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")
    if same.isEmpty():
        return stored(rows.select("doc_id", "key", F.lit(0).alias("variant"), F.monotonically_increasing_id().alias("row"), sha))
    keys = same.select("key").distinct()
    alone = rows.join(keys, "key", "left_anti").select("doc_id", "key", F.lit(0).alias("variant"), sha)
    split = rows.join(same, ["key", "body"]).select("doc_id", "key", "variant", sha)
    return stored(alone.union(split).withColumn("row", F.monotonically_increasing_id()))


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", normal: Callable = lowered, key: Callable = content_hash
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normal`` gives the same bytes; null and empty texts are equal. Of each group the row with
    the ``smallest`` or the ``largest`` id stays, one row exactly: of repeated rows with that id one is kept, and a
    row without an id stays only where no row of its group has one. ``key`` may give any bytes that equal texts
    share; texts that share them by chance are told apart. No documents, no rows; other columns are left out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    rows = _rows(docs, normal, key)
    # a row without an id is the last choice: nulls rank lowest, so for the smallest id they are told apart first
    if keep == "largest":
        best = F.max(F.struct("doc_id", "row"))
    else:
        best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    groups = stored(
        rows.groupBy("key", "variant").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
            "key", "variant", "group_size", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"),
        )
    )
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") >= max(HOT * total, 2)
    found = rows.join(F.broadcast(groups.where(hot)), ["key", "variant"], "left")
    columns = ("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    cold = found.where("group_size is null").drop("group_size", "keep_row", "keep_id")
    return found.where("group_size is not null").select(*columns).union(
        cold.join(groups.where(~hot), ["key", "variant"]).select(*columns)
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", normal: Callable = lowered) -> DataFrame:
    """The documents that stay, all columns kept; of rows that repeat one id and text any one stays."""
    name = "kept"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    marked = exact_duplicates(docs, keep, normal).where("kept").select(
        F.col("doc_id").alias(f"{name}id"), F.col("text_sha256").alias(f"{name}sha")
    )
    held = docs.withColumn(f"{name}key", F.sha2(normal(F.col("text")).cast("binary"), 256)).join(
        marked, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}id")) & (F.col(f"{name}key") == F.col(f"{name}sha")),
        "left_semi",
    )
    return held.dropDuplicates(["doc_id", f"{name}key"]).select(docs.columns)
