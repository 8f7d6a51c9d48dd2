"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``WINDOW`` words. A document that holds a window holds each of its
words (the window's one-word shingles), so one of them is a sufficient prefix: of the window's longest words
the one that is rarest in the corpus. Documents that hold a prefix are few; in those, the place of the
prefix in its window gives where the window would begin, places outside the document are dropped, and
the remaining stretches are compared with the windows word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.llm.common import stored
from margrid.session import bounded

WINDOW = 13
# Longest words of a window among which the rarest is its prefix.
CHOICE = 4
# Up to this many such words are looked for in each document's array of words; more are joined.
IN_ARRAY = 20_000

# What parts the words of the contract's rule, while A-Z are not lower-cased yet.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words between gaps; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), GAP)


def words(text: Column) -> Column:
    """Words, A-Z lower-cased."""
    return F.array_remove(_split(F.translate(text, UPPER, LOWER)), "")


def _folded(text: Column) -> Column:
    """Lower case of all letters, alike wherever a word stands: equal words stay equal, places stay."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: window (words joined by spaces), n (words), item_ids (text, distinct)."""
    cut = items.select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    cut = cut.select(
        "item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("i")
    ).select("item", F.slice("w", F.col("i"), F.lit(size)).alias("w"))
    return cut.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n")).agg(
        F.collect_set("item").alias("items")
    )


def _survey(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key of the text, n_words) and, for each row, the words of the vocabulary it holds (key, word)."""
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"),
        _split(_folded(F.col("text"))).alias("w"),
    )
    edges = F.when(F.element_at("w", 1) == "", 1).otherwise(0) + F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    number = F.greatest(F.size("w") - edges, F.lit(0)).cast("long").alias("n_words")
    few = vocabulary.limit(IN_ARRAY + 1).collect()
    if len(few) <= IN_ARRAY:
        sought = F.split(F.lit(" ".join(sorted(r["word"] for r in few))), " ")
        rows = stored(split.select("doc_id", "key", number, F.array_intersect(sought, F.col("w")).alias("held")))
        return rows.drop("held"), rows.select("key", F.explode("held").alias("word"))
    held = split.select("key", F.explode(F.array_distinct("w")).alias("word")).join(vocabulary, "word")
    return stored(split.select("doc_id", "key", number)), stored(held.select("key", "word"))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_words) and the texts that hold windows (key, n_words, n_hit, item_ids sorted)."""
    win = stored(windows(items, size))
    longest = Window.partitionBy("window").orderBy(F.length("word").desc(), "word")
    spots = stored(
        win.select("window", "n", F.posexplode(F.split("window", " ")).alias("place", "exact"))
        .withColumn("word", _folded(F.col("exact")))
        .withColumn("r", F.dense_rank().over(longest)).where(F.col("r") <= CHOICE)
        .select("window", "n", "place", "word")
    )
    size_win, size_spots = win.count(), spots.count()
    rows, held = _survey(docs, spots.select("word").distinct())

    # rarity: how many documents hold a word
    counted = bounded(held.groupBy("word").agg(F.count(F.lit(1)).alias("seen")), size_spots)
    rarest = Window.partitionBy("window").orderBy("seen", "word", "place")
    prefix = stored(
        spots.join(counted, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        .withColumn("r", F.row_number().over(rarest)).where("r = 1 and seen > 0")
        .select("word", "place", "n").distinct()
    )
    prefix = bounded(prefix, size_spots)
    keys = stored(held.join(prefix.select("word").distinct(), "word").select("key").distinct())
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), F.col("text"))
    texts = texts.join(bounded(keys, keys.count()), "key", "left_semi").dropDuplicates(["key"])
    texts = stored(texts.select("key", words(F.col("text")).alias("w")))

    begins = (
        texts.select("key", F.size("w").cast("long").alias("n_words"), F.posexplode("w").alias("at", "exact"))
        .select("key", "n_words", "at", _folded(F.col("exact")).alias("word"))
        .join(prefix, "word")
        .select("key", (F.col("at") - F.col("place")).alias("begin"), "n", "n_words")
        .where("begin >= 0 and begin + n <= n_words")
    )
    places = stored(begins.groupBy("key").agg(F.collect_set(F.struct("begin", "n")).alias("places")))
    cut = texts.join(places, "key").select(
        "key", F.size("w").cast("long").alias("n_words"), F.explode(F.expr(
            "transform(places, p -> struct(p.begin, p.n, array_join(slice(w, p.begin + 1, p.n), ' ') AS window))"
        )).alias("p"),
    ).select("key", "n_words", "p.begin", "p.n", "p.window")
    verified = cut.join(bounded(win, size_win), ["window", "n"])
    found = verified.groupBy("key").agg(
        F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)))))
        .cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    return rows, found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it stands in any occurrence of a window; a document is contaminated if 5 % of its words
    are. Null and empty texts have no words and are clean; items without words have no windows; the words of
    an item without an id count as hits, but no id is listed; repeated rows give their row again.
    """
    rows, found = matches(docs, items, size)
    found = found.drop("n_words")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    found = matches(docs, items, size)[1].where("n_hit > 0 and 20 * n_hit >= n_words")
    found = found.select(F.col("key").alias("__text_key"))
    keyed = docs.withColumn("__key", F.md5(F.col("text").cast("binary")))
    return keyed.join(found, F.col("__key") == F.col("__text_key"), "left_anti").select(docs.columns)
