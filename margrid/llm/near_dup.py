"""Near-duplicate documents by circulant MinHash.

Two permutations of a ring of ``RING`` places give all signature coordinates: the first scatters a shingle
on the ring, the second, shifted on by one place for each coordinate, gives its value. Since the shifted
copies of the second permutation at one place are neighbours in memory, the values of all coordinates of a
shingle are one contiguous slice, and a signature is the minimum over the slices of a text.

Exact copies are folded to one class by the digest of their text first. In each band's bucket the members
meet a centre, the member that shares most buckets; links are confirmed on the full shingle sets of the
texts. Members that are still in different components then meet in a further round with other centres. What is
left across components is compared in full, so no link is lost that a bucket holds: every pair of a bucket whose
sizes and sketches allow a link is confirmed. A sketch holds the parity of the shingles that fall on each of its
places. Shared shingles cancel out, so two sketches differ in no more places than the sets have shingles apart,
and the bound leaves out no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, mix, slices, stored, word_hashes
from margrid.llm.components import components

RING = 1 << 20
BANDS = 32
ROWS = 5
STAR_ROUNDS = 2
# Numbers of 64 places in a sketch, and members of a bucket that one block of the full comparison has.
SKETCH = 32
BLOCK = 1024

_STEP = np.uint64(0xD6E8FEB86659FD93)
_WHOLE = np.uint64(0x2545F4914F6CDD1D)


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the circulant one as a strided matrix: row p has places p, p+1, ..."""
    places = np.arange(RING, dtype=np.uint64)
    scatter = np.argsort(mix(places + np.uint64(1 << 40)), kind="stable").astype(np.int64)
    values = np.argsort(mix(places + np.uint64(1 << 41)), kind="stable").astype(np.int32)
    ring = np.concatenate([values, values[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text; fewer words than a shingle are one shingle."""
    if not len(words):
        return words
    if len(words) < size:
        one = np.full(1, _WHOLE, np.uint64)
        for w in words:
            one = one * _STEP + w
        return mix(one)
    n = len(words) - size + 1
    out = words[:n].copy()
    for j in range(1, size):
        out *= _STEP
        out += words[j:j + n]
    return np.unique(mix(out))


def _signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    scatter, ring = _permutations(coordinates)
    at = scatter[(shingles & np.uint64(RING - 1)).astype(np.int64)]
    best = ring[at[0]].copy()
    some = max(1, (1 << 19) // coordinates)
    for i in range(0, len(at), some):
        np.minimum(best, ring[at[i:i + some]].min(axis=0), out=best)
    return best


def _bands(signature: np.ndarray, bands: int, length: int) -> np.ndarray:
    rows = signature.reshape(bands, length).astype(np.uint64)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 50))
    for j in range(length):
        key = mix(key ^ (rows[:, j] + np.uint64(j << 32)))
    return key.view(np.int64)


def _sign(size: int, bands: int, length: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, first = word_hashes(batch.column("text"))
                counts, flat, ends = [], [], [0]
                for i in range(len(batch)):
                    s = _shingles(hashes[first[i]:first[i + 1]], size)
                    counts.append(len(s))
                    if len(s):
                        flat.append(_bands(_signature(s, bands * length), bands, length))
                    ends.append(ends[-1] + bands * (len(s) > 0))
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()), lists], schema=schema
                )

    return run


def _sketch(size: int):
    """Rows (key, text) to (key, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, first = word_hashes(batch.column("text"))
                sketches = []
                for i in range(len(batch)):
                    at = _shingles(hashes[first[i]:first[i + 1]], size) % np.uint64(64 * SKETCH)
                    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(sketches, pa.binary())], names=["key", "sketch"]
                )

    return run


def _confirm(size: int):
    """Rows (a, b, root_a, root_b, text_a, text_b) to the roots of pairs whose full shingle sets are close enough."""

    def shingle_set(text: str) -> set:
        words = text.encode().lower().split()
        if len(words) < size:
            return {tuple(words)} if words else set()
        return set(zip(*(words[j:] for j in range(size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_set = None, set()
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("a", "text_a", "text_b")]
            for i in range(len(batch)):
                a = columns[0][i].as_py()
                if a != known:
                    known, known_set = a, shingle_set(columns[1][i].as_py())
                other = shingle_set(columns[2][i].as_py())
                inter = len(known_set & other)
                union = len(known_set) + len(other) - inter
                keep.append(union > 0 and 100 * inter >= 80 * union)
            yield batch.select(["root_a", "root_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between the roots of confirmed pairs, from the full texts of both sides."""
    side_b = pairs.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    both = side_b.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
    both = both.select("a", "b", "root_a", "root_b", "text_a", "text_b")
    found = in_tasks(both, _confirm(size), "root_a string, root_b string")
    return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


_SIGNED = "id long, key string, n long, bands array<long>"
_NEAR = "100 * least(n, cn) >= 80 * greatest(n, cn)"


def _across(now: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a bucket's members in different components that sizes and sketches allow to be links.

    Members lie in ``parts`` blocks, and every two blocks of a bucket meet once, so large buckets are spread.
    """
    now = now.join(sketches, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    now = now.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    now = now.select("bucket", "p", "q", "block", "key", "n", "root", "sketch")
    return now.groupBy("bucket", "p", "q").applyInArrow(_meet, "a string, b string, root_a string, root_b string")


def _meet(table: pa.Table) -> pa.Table:
    n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
    whole = table.column("p")[0] == table.column("q")[0]
    _, root = np.unique(table.column("root").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(n), SKETCH)
    first, second = [], []
    for i in range(len(n)):
        near = (root > root[i]) & (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i]))
        if not whole:  # pairs of one block meet in its own task
            near &= block != block[i]
        j = np.flatnonzero(near)
        if len(j):
            # sets that share 80 of 100 have at most a ninth of their sizes' sum apart
            apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            j = j[9 * apart <= n[j] + n[i]]
            first.append(np.full(len(j), i))
            second.append(j)
    a, b = (pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (first, second))
    keys, roots = table.column("key"), table.column("root")
    return pa.table({"a": keys.take(a), "b": keys.take(b), "root_a": roots.take(a), "root_b": roots.take(b)})


def classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key) and classes of equal texts (key, n_shingles, component_id, keeper).

    The keeper of a component is the class that holds its smallest id.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.md5(F.col("text").cast("binary")).alias("key"), F.col("text")
    )
    signed = in_tasks(texts, _sign(size, BANDS, ROWS), _SIGNED)
    rows = stored(
        signed.groupBy("key").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    members = stored(
        rows.where("n > 0 and key is not null")
        .select("key", "n", F.explode("bands").alias("bucket"))
        .join(
            rows.where("n > 0 and key is not null").select(F.explode("bands").alias("bucket"))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"),
            "bucket",
        )
        .select("bucket", "key", "n", "size")
    )
    weight = members.groupBy("key").agg(F.sum("size").alias("weight"))
    members = members.join(weight, "key").select("bucket", "key", "n", "weight")
    labels = members.select("key", F.col("key").alias("root")).distinct()
    # One row of each class that shares a bucket brings its text; (key, id) spreads large groups of copies.
    no_id = F.coalesce("id", F.lit(-(1 << 63)))
    wanted = rows.join(labels, "key", "left_semi").select("key", F.coalesce("low", F.lit(-(1 << 63))).alias("at"))
    bodies = stored(
        texts.withColumn("at", no_id).join(wanted, ["key", "at"], "left_semi").dropDuplicates(["key", "at"])
        .select("key", "text")
    )
    for turn in range(STAR_ROUNDS + 1):
        now = members.join(labels, "key") if turn else members.withColumn("root", F.col("key"))
        if turn:  # buckets that still hold several components
            mixed = now.groupBy("bucket").agg(
                F.min("root").alias("lo"), F.max("root").alias("hi"),
                F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"),
            ).where("lo < hi")
            now = now.join(mixed.select("bucket", "parts"), "bucket")
        if turn < STAR_ROUNDS:
            order = F.struct("weight", "key") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)), "key")
            centre = now.groupBy("bucket").agg(
                F.max_by(F.struct("key", "n", "root"), order).alias("c")
            ).select("bucket", F.col("c.key").alias("ckey"), F.col("c.n").alias("cn"), F.col("c.root").alias("croot"))
            pairs = now.join(centre, "bucket").where((F.col("root") != F.col("croot")) & F.expr(_NEAR)).select(
                F.col("ckey").alias("a"), F.col("key").alias("b"), F.col("croot").alias("root_a"), F.col("root").alias("root_b")
            )
        else:
            now = stored(now.select("bucket", "key", "n", "root", "parts"))
            open_ = bodies.join(now.select("key").distinct(), "key", "left_semi")
            pairs = _across(now, stored(in_tasks(open_, _sketch(size), "key string, sketch binary")))
        pairs = pairs.distinct()
        if turn == 0:
            pairs = stored(pairs)
            seen = pairs.select("a", "b")
        else:
            either = seen.union(seen.select("b", "a"))
            pairs = stored(pairs.join(either, ["a", "b"], "left_anti"))
            seen = seen.union(pairs.select("a", "b"))
        if pairs.isEmpty():
            if turn == 0:
                break
            continue
        found = stored(_links(pairs, bodies, size))
        if found.isEmpty():
            continue
        # roots found so far stand for their components, so a later round unites no more than its own links
        roots = components(found).select(F.col("node").alias("root"), F.col("root").alias("lower"))
        labels = stored(
            labels.join(roots, "root", "left").select("key", F.coalesce("lower", "root").alias("root"))
        )
    labelled = rows.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = labelled.where("n > 0").groupBy("root").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("best")
    )
    return texts.select("id", "key"), labelled.join(best, "root", "left").select(
        "key", F.col("n").alias("n_shingles"), F.col("best.low").alias("component_id"),
        (F.col("key") == F.col("best.key")).alias("keeper"),
    )


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its group), kept.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are ``size`` words in a row (all
    words, if there are fewer). Texts link when their distinct shingles share 80 of 100 or more. Null and
    empty texts link with nothing. Repeated rows are rows of one class; rows without a doc_id belong to
    their group, but never name it, and are kept only where they link with nothing.
    """
    rows, table = classes(docs, size)
    rows = rows.withColumn("key", F.coalesce("key", F.lit("")))
    alone = F.col("n_shingles").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return rows.join(table.where("key is not null"), "key", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents with one row of each near-duplicate group, all columns kept.

    The row with the smallest doc_id stays, once if it is repeated. Rows without words all stay, and so
    does one row of a group in which no row has a doc_id.
    """
    key = "__text_key"
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    _, table = classes(docs.where(words), size)
    keyed = docs.where(words).withColumn(key, F.md5(F.col("text").cast("binary")))
    best = table.where("keeper").select(F.col("key").alias("__best"), F.col("component_id").alias("__component"))
    kept = keyed.join(
        best, (keyed[key] == best["__best"]) & keyed["doc_id"].cast("long").eqNullSafe(best["__component"]), "left_semi"
    )
    return kept.dropDuplicates([key, "doc_id"]).drop(key).unionByName(docs.where(~words))
