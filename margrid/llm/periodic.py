"""Periodic runs of words, by uniting suffix classes from the longest common prefix down.

The words of a text become numbers; prefix doubling puts its suffixes in an order in which equal beginnings stand
together, and neighbours' common prefixes (LCP) are read off the classes of the doublings. Then, as in Kruskal's
algorithm, neighbours are united by falling LCP. Every class keeps its positions in order; when two classes meet at LCP
l, positions that become neighbours at a distance d <= l begin a stretch of d + l words with smallest period d that
the next word breaks. Of all such seeds with the same period and end the smallest position is where the run begins, because
a run's first pair of positions meets like the others. Texts are independent, so the work stays where the rows lie.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import CHUNK_BYTES, in_tasks, slices

# A run has at least SHORTEST words and EXPONENT periods.
SHORTEST, EXPONENT = 6, 4

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def suffix_classes(words: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ranks of all positions by their first 1, 2, 4, ... words, and the positions that share theirs at each step.

    ``words`` are numbers, ``first`` the places where texts begin (and one more at the end). Equal ranks mean the
    same words of the same text; ranks order classes so that a class of longer beginnings stays together. The
    steps end when no two positions are alike.
    """
    size = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, inverse, number = np.unique(
        text * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True
    )
    rank = np.full(size + 1, -1, np.int32)  # one more, for what lies beyond the last word
    rank[:size] = (np.cumsum(number) - number)[inverse]
    active = np.flatnonzero(number[inverse] > 1)
    ranks, alike, step = [rank], [active], 1
    while len(active):
        head, tail = rank[active], rank[np.minimum(active + step, size)]
        order = np.lexsort((tail, head))
        active, head, tail = active[order], head[order], tail[order]
        new_head = np.concatenate([[True], head[1:] != head[:-1]])
        new = new_head | np.concatenate([[True], tail[1:] != tail[:-1]])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(active)))
        place = np.arange(len(active))
        heads = np.maximum.accumulate(np.where(new_head, place, 0))
        rank = rank.copy()
        rank[active] = np.repeat((head + place - heads)[begins], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        ranks.append(rank)
        alike.append(active)
        step *= 2
    return ranks, alike


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at ``a`` and ``b`` (different, of the same text) share."""
    end, out = len(ranks[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a + out, end)] == ranks[k][np.minimum(b + out, end)]
        out += same.astype(np.int64) << k
    return out


def _unite(slots: list[int], edges: Iterator[tuple[int, int]], shortest: int, exponent: int) -> dict[tuple[int, int], int]:
    """Start of each run by (period, end). ``slots`` are positions in suffix order, an edge (slot, l) unites a slot
    with the next one; edges come with falling l."""
    parent = list(range(len(slots)))
    members: list[list[int]] = [[p] for p in slots]
    runs: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for slot, shared in edges:
        a, b = find(slot), find(slot + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b] = a
        members[b] = []
        widest = shared // (exponent - 1)  # periods up to this one fit often enough
        last = len(small) - 1
        for n, x in enumerate(small):
            k = bisect_left(large, x)
            if k:
                near = large[k - 1]
                if x - near <= widest and (not n or small[n - 1] < near) and x - near + shared >= shortest:
                    key = (x - near, x + shared)
                    if near < runs.get(key, near + 1):
                        runs[key] = near
            if k < len(large):
                near = large[k]
                if near - x <= widest and (n == last or near < small[n + 1]) and near - x + shared >= shortest:
                    key = (near - x, near + shared)
                    if x < runs.get(key, x + 1):
                        runs[key] = x
        if len(small) * 16 > len(large):
            large += small
            large.sort()  # two ordered stretches: merged in one pass
        else:
            for x in small:
                insort(large, x)
    return runs


def find_runs(
    words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT
) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``shortest`` words and ``exponent`` (2 or more) periods.

    Starts count over all texts, ascending, then by period. A run is a stretch with smallest period ``period`` that
    no neighbouring word of its text extends.
    """
    if not len(words):
        return []
    least = min(max(shortest, exponent * q) - q for q in range(1, shortest + 1))
    ranks, alike = suffix_classes(words, first)
    step = max(0, least.bit_length() - 1)  # 2**step <= least: seeds lie in the classes of that step
    if step >= len(alike) or not len(alike[step]):
        return []
    slots = alike[step]
    slots = slots[np.argsort(ranks[-1][slots], kind="stable")]
    group = ranks[step][slots]
    joined = np.flatnonzero(group[1:] == group[:-1])
    shared = common_prefixes(ranks, slots[joined], slots[joined + 1])
    # classes whose closest positions are too far apart for their longest common prefix hold no seed
    name, begins = np.unique(group, return_index=True)
    class_of = np.searchsorted(begins, np.arange(len(slots)), side="right") - 1
    longest = np.zeros(len(name), np.int64)
    np.maximum.at(longest, class_of[joined], shared)
    by_place = np.lexsort((slots, class_of))
    gap = np.full(len(name), np.iinfo(np.int64).max // exponent)
    inside = np.flatnonzero(class_of[by_place][1:] == class_of[by_place][:-1])
    np.minimum.at(gap, class_of[by_place][inside], np.diff(slots[by_place])[inside])
    keep = (shared >= least) & (gap * (exponent - 1) <= longest)[class_of[joined]]
    joined, shared = joined[keep], shared[keep]
    order = np.argsort(-shared, kind="stable")
    runs = _unite(
        slots.tolist(), zip(joined[order].tolist(), shared[order].tolist(), strict=True), shortest, exponent
    )
    return sorted((start, end - start, period) for (period, end), start in runs.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return b" ".join([w for w, d in zip(words, gone.tolist(), strict=True) if not d])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mark(edit: Edit | None, shortest: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=4 * CHUNK_BYTES):
                ids = batch.column("doc_id")
                # bytes split at ASCII white space, which is the contract's rule
                texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
                if edit:
                    texts = [edit(d, w) for d, w in zip(ids.to_pylist(), texts, strict=True)]
                first = np.cumsum([0, *map(len, texts)])
                flat = pa.array([w for words in texts for w in words], pa.large_binary())
                numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found: dict[int, list[tuple[int, int, int]]] = {}
                for start, length, period in find_runs(numbers, first, shortest, exponent):
                    at = int(np.searchsorted(first, start, side="right")) - 1
                    found.setdefault(at, []).append((start - int(first[at]), length, period))
                runs = [found.get(i, []) for i in range(len(texts))]
                left = [collapsed(w, r) for w, r in zip(texts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array([len(w) for w in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], pa.list_(_RUN)),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, edit: Edit | None = None, shortest: int = SHORTEST, exponent: int = EXPONENT
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what ASCII white space parts, numbered from 0, compared byte by byte; ``edit`` may give other words for a
    document's id and words. ``collapsed`` is the text without the words that a run holds after its first
    period, joined by one space. Null and empty texts have no words, no runs and an empty text; repeated rows are
    marked each; ids may be null. No documents, no rows; other columns are left out. Whole texts are worked on: a task
    needs about 4 bytes a word for every doubling of the longest repeated stretch in 4 MB of text, or in one longer text.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_tasks(
        rows, _mark(edit, shortest, exponent),
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )
