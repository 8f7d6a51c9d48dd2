"""Language-model scores by Katz back-off over word pairs.

P(w | h) = d c(h w) / c(h) for pairs that the training texts hold, else a(h) P(w); P(w) = d c(w) / N for known
words, else what the discounts leave. Discounts d are Good-Turing's for counts up to ``KATZ``; a(h) is
exactly what normalises the words that do not follow h in training.

Tables lie in parts by hash of the history, and a part holds all that its pairs need: chunks of texts send each
part their distinct pairs with the documents they stand in, and word parts send it the counts of its words. Good-Turing's
counts of counts are only known when all parts are counted, so a part does not need them: it sends back what the
discounts enter: for each document the logarithms that are certain and how many of its pairs have which rare count, and
for the back-off weights the numbers of rare pairs of each history. The pairs are shuffled once, and scores don't hang
on the number of parts. Words more frequent than half a part are hot histories, which are split by the next word; their
back-off weights come from sums over the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, mix, slices, stored, word_hashes

# Counts up to this one are discounted, as in Katz's paper.
KATZ = 5
# Tokens of a part. Words of more than half as many tokens, and of this share of all, are hot histories.
PART_TOKENS = 2_000_000
HOT = 0.002
CHUNK = 5 << 20

_START, _END = np.uint64(1), np.uint64(2)
_PARTS = "part long, chunk long, row binary"


def held_out(doc_id):
    """Documents that are only scored: crc32 of the id as text leaves 2 by 7 (null ids are not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ------------------------------------------------------------------ packed rows


def _small(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those of 255 and more in full."""
    return np.minimum(values, 255).astype(np.uint8), values[values >= 255].astype(np.uint32)


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed row; equal bytes of neighbours stand together, which numbers and ordered hashes gain by."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64)
    body = b"".join(
        np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays
    )
    return head.tobytes() + _ZSTD.compress(body, asbytes=True)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.bool_, np.uint16, np.uint32, np.uint64, np.int64, np.float64)}


def _unpack(raw: bytes) -> list[np.ndarray]:
    number = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * number, 8).tolist()
    kinds = [(_KINDS[k], n) for k, n in zip(head[::2], head[1::2], strict=True)]
    body = np.frombuffer(
        _ZSTD.decompress(raw[8 + 16 * number:], sum(k.itemsize * n for k, n in kinds), asbytes=True), np.uint8
    )
    at, out = 0, []
    for kind, length in kinds:
        planes = body[at:at + length * kind.itemsize].reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += length * kind.itemsize
    return out


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2**32, by two passes over 16 bits."""
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((values >> 16)[low].astype(np.uint16), kind="stable")]


def _narrow(values: np.ndarray, bound: int) -> np.ndarray:
    return values.astype(np.uint16 if bound <= 1 << 16 else np.uint32)


# ------------------------------------------------------------------ chunks of texts


class Chunk:
    """Tokens of some documents: words by code, codes of histories (one more code is the start), documents."""

    def __init__(self, batch: pa.RecordBatch):
        hashes, first = word_hashes(batch.column("text"))
        docs = len(batch)
        each = np.diff(first) + 1
        ends = np.cumsum(each) - 1
        token = np.empty(len(hashes) + docs, np.uint64)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = hashes
        token[ends] = _END
        # codes go by hash, so hashes that are sent in order of their codes are packed more tightly
        self.words, self.code = np.unique(token, return_inverse=True)
        self.history = np.empty_like(self.code)
        self.history[1:] = self.code[:-1]
        self.history[ends - each + 1] = len(self.words)
        self.before = np.append(self.words, _START)
        self.doc = np.repeat(np.arange(docs), each)
        self.train = ~np.array(batch.column("held").to_pylist(), bool)
        self.tokens = each

    def parts(self, hot: np.ndarray, parts: int) -> np.ndarray:
        """Part of each token's pair: by history, of hot histories by history and word."""
        at = mix(self.before) % np.uint64(parts)
        spread = np.isin(self.before, hot)
        out = at[self.history].astype(np.int64)
        split = np.flatnonzero(spread[self.history])
        both = mix(self.before[self.history[split]] ^ mix(self.words[self.code[split]] + np.uint64(7)))
        out[split] = (both % np.uint64(parts)).astype(np.int64)
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Chunk]]:
    """Numbered chunks; the number hangs on the task and its rows, so a task that is run again repeats it."""
    task, n = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in slices(whole, most=CHUNK):
            yield (task << 32) + n, batch, Chunk(batch)
            n += 1


def _frequent(share: float):
    """Number of tokens (word 0) and the words that are frequent in a chunk, at most 2 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk in _chunks(batches):
            number = np.bincount(chunk.code, minlength=len(chunk.words))
            often = np.flatnonzero(number >= len(chunk.code) * share / 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(chunk.words[often].view(np.int64), 0)),
                 pa.array(np.append(number[often], len(chunk.code)).astype(np.int64))], names=["word", "n"],
            )

    return run


def _requests(hot: np.ndarray, parts: int, word_parts: int):
    """For each word part: the chunk's words, their training counts and the parts that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, chunk in _chunks(batches):
            trained = np.bincount(chunk.code, chunk.train[chunk.doc], len(chunk.words)).astype(np.int64)
            pair = np.unique(pd.unique(chunk.code * parts + chunk.parts(hot, parts)))
            word, part = pair // parts, pair % parts
            asked = np.bincount(word, minlength=len(chunk.words))
            ends = np.cumsum(asked)
            home = (mix(chunk.words + np.uint64(5)) % np.uint64(word_parts)).astype(np.int64)
            rows: list[list] = [[], [], []]
            for p in range(word_parts):
                mine = np.flatnonzero(home == p)
                if not len(mine):
                    continue
                k = asked[mine]
                spot = np.repeat(ends[mine] - np.cumsum(k), k) + np.arange(k.sum())
                for column, v in zip(rows, (p, number, _pack(
                    chunk.words[mine], *_small(trained[mine]), *_small(k), _narrow(part[spot], parts)
                )), strict=True):
                    column.append(v)
            yield _rows(*rows)

    return run


def _rows(part: list, chunk: list, row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(chunk, pa.int64()), pa.array(row, pa.binary())],
        names=["part", "chunk", "row"],
    )


def _pairs(hot: np.ndarray, parts: int):
    """For each part: the chunk's distinct pairs by history, and the documents of each pair's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, chunk in _chunks(batches):
            docs = len(batch)
            wide = len(chunk.words) + 1
            pair, found = pd.factorize(chunk.history * wide + chunk.code)
            history, word = found // wide, found % wide
            part = np.empty(len(found), np.int64)
            part[pair] = chunk.parts(hot, parts)
            order = _order(history)
            order = order[_order(part[order])]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pair = rank[pair]
            places = np.bincount(pair, minlength=len(found))
            doc = chunk.doc[_order(pair)]
            part, history, word = part[order], history[order], word[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            spots = np.append(0, np.cumsum(places))
            rows: list[list] = [[], [], []]
            ids = [v if v is not None else 0 for v in batch.column("doc_id").to_pylist()]
            none = np.array([v is None for v in batch.column("doc_id").to_pylist()], bool)
            full = True
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = bounds[p], bounds[p + 1]
                starts = np.flatnonzero(np.append(True, history[lo + 1:hi] != history[lo:hi - 1]))
                local, place = np.unique(doc[spots[lo]:spots[hi]], return_inverse=True)
                # the first part of a chunk also carries who its documents are
                who = (np.array(ids, np.int64), none, chunk.tokens.astype(np.int64), chunk.train) if full else (
                    np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, bool)
                )
                full = False
                for column, v in zip(rows, (p, number, _pack(
                    chunk.before[history[lo:hi][starts]], *_small(np.diff(np.append(starts, hi - lo))),
                    chunk.words[word[lo:hi]], *_small(places[lo:hi]), _narrow(place, docs),
                    _narrow(local, docs), chunk.train[local], *who,
                )), strict=True):
                    column.append(v)
            yield _rows(*rows)

    return run


# ------------------------------------------------------------------ parts


def _count_words(parts: int):
    """A word part's requests to counts for each part (chunk -1), and counts of counts (part -1)."""

    def run(table: pa.Table) -> pa.Table:
        rows = [_unpack(r) for r in table.column("row").to_pylist()]
        words, code = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        trained = np.concatenate([_whole(r[1], r[2]) for r in rows])
        count = np.bincount(code, trained, len(words)).astype(np.int64)
        asked = np.concatenate([_whole(r[3], r[4]) for r in rows])
        part = np.concatenate([r[5] for r in rows]).astype(np.int64)
        need = pd.unique(part * len(words) + np.repeat(code, asked))
        need.sort()
        bounds = np.searchsorted(need, np.arange(parts + 1) * len(words))
        out: list[list] = [[], [], []]
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            mine = need[bounds[p]:bounds[p + 1]] - p * len(words)
            for column, v in zip(out, (p, -1, _pack(words[mine], *_small(count[mine]))), strict=True):
                column.append(v)
        known = count[count > 0]
        stats = [len(known), known.sum(), *(int((known == r).sum()) for r in range(1, KATZ + 2))]
        for column, v in zip(out, (-1, -1, _pack(np.array(stats, np.int64))), strict=True):
            column.append(v)
        return pa.Table.from_batches([_rows(*out)])

    return run


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to KATZ (0 for 0) from n_1 to n_(KATZ + 1).

    Where the counts of counts are too few or rise, so that a discount would not lie in (0, 1), the count
    loses a half instead.
    """
    n = [0, *counts_of_counts]
    out = np.zeros(KATZ + 1)
    most = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (good - most) / (1 - most) if most < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(count: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return count * np.where(count > KATZ, 1.0, discount[np.minimum(count, KATZ)])


class Words:
    """The lower order: probabilities of words by their counts, and what is left for all unknown words."""

    def __init__(self, known: int, total: int, counts_of_counts: list[int]):
        self.known, self.total = known, total
        self.discount = discounts(counts_of_counts)
        kept = total - sum((1 - self.discount[r]) * r * n for r, n in enumerate(counts_of_counts[:KATZ], 1))
        # without rare words the discounts leave nothing: then all known words give up one count together
        self.scale = 1.0 if kept < total else total / (total + 1.0)
        self.left = 1.0 - (kept / total) * self.scale if total else 1.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, _discounted(count, self.discount) / self.total * self.scale, self.left)


def _sums_by(index: np.ndarray, rare: np.ndarray, size: int) -> np.ndarray:
    """How often each rare count (1 to KATZ) stands at each index: size x KATZ numbers."""
    some = (rare > 0) & (rare <= KATZ)
    return np.bincount(index[some].astype(np.int64) * KATZ + rare[some] - 1, minlength=size * KATZ)


def _score(words: Words, hot: np.ndarray, hot_count: np.ndarray):
    """One part's pairs to what the documents of each chunk get from them, but for the discounts.

    A chunk's row: its documents here; logarithms, base and known words of each; how many of their pairs have
    which rare count; documents and hot histories of unknown pairs; documents and histories (by number) of other unknown
    pairs; of these histories the numbers of rare pairs, mass of the others, count and cover; what hot histories without
    rare pairs change (document, history, logarithm); who the documents are. A part's own row (chunk -1): hot histories,
    their rare pairs, mass and number of others, cover; counts of counts.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        numbers = table.column("chunk").to_pylist()
        raw = table.column("row").to_pylist()
        order = sorted(range(len(raw)), key=numbers.__getitem__)
        counts = [_unpack(raw[i]) for i in order if numbers[i] < 0]
        rows = [_unpack(raw[i]) for i in order if numbers[i] >= 0]
        chunks = [numbers[i] for i in order if numbers[i] >= 0]
        h_code, histories = pd.factorize(np.concatenate([r[0] for r in rows]))
        h_code = np.repeat(h_code.astype(np.int32), np.concatenate([_whole(r[1], r[2]) for r in rows]))
        w_code, vocabulary = pd.factorize(np.concatenate([r[3] for r in rows]))
        w_code = w_code.astype(np.int32)
        places = np.concatenate([_whole(r[4], r[5]) for r in rows])
        sizes = np.array([len(r[7]) for r in rows])
        base_doc = np.cumsum(sizes) - sizes
        doc = np.concatenate([r[6].astype(np.int32) + np.int32(b) for r, b in zip(rows, base_doc, strict=True)])
        train = np.concatenate([r[8] for r in rows])
        seen = np.add.reduceat(train[doc].astype(np.int64), np.cumsum(places) - places)
        rows = [(r[7], r[9:]) for r in rows]
        code, pairs = pd.factorize(h_code.astype(np.int64) * len(vocabulary) + w_code)
        code = code.astype(np.int32)
        h, w = (pairs // len(vocabulary)).astype(np.int32), (pairs % len(vocabulary)).astype(np.int32)
        count = np.bincount(code, seen, len(pairs)).astype(np.int64)
        del seen, pairs

        index = pd.Index(np.concatenate([c[0] for c in counts]))
        word_count = np.concatenate([_whole(c[1], c[2]) for c in counts])[index.get_indexer(vocabulary)]
        lower = words.probability(word_count)
        hot_at = pd.Index(hot).get_indexer(histories)
        is_hot = hot_at >= 0
        rare = _sums_by(h, count, len(histories)).reshape(-1, KATZ)
        common = count > KATZ
        others = np.bincount(h, common, len(histories))
        mass = np.bincount(h, np.where(common, count, 0), len(histories))
        # a history without rare pairs keeps nothing for unknown words: then each of its pairs gives up a half
        bare = ~rare.any(axis=1)
        kept = np.where(common & (bare & ~is_hot)[h], count - 0.5, count)
        mass -= np.where(bare & ~is_hot, others / 2, 0)
        covered = np.bincount(h, lower[w] * (count > 0), len(histories))
        total = np.where(is_hot, hot_count[np.maximum(hot_at, 0)], np.bincount(h, count, len(histories)))
        logs = np.log10(np.where(count > 0, kept / np.maximum(total[h], 1), lower[w]))
        plain = np.log10((word_count + 1.0) / (words.total + words.known + 1.0))

        docs = len(train)
        score = np.bincount(doc, np.repeat(logs[code], places), docs)
        base = np.bincount(doc, np.repeat(plain[w_code], places), docs)
        known = np.bincount(doc, np.repeat(word_count[w_code] > 0, places), docs).astype(np.int64)
        ranks = _sums_by(doc, np.repeat(count[code], places), docs)

        def spread(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Documents, histories and counts at the places of chosen pairs, by chunk, and the chunks' bounds."""
            some = np.repeat(chosen[code], places)
            at, of, n = doc[some], np.repeat(h_code, places)[some], np.repeat(count[code], places)[some]
            home = np.searchsorted(base_doc, at, side="right") - 1
            turn = _order(home)
            return at[turn], of[turn], n[turn], np.searchsorted(home[turn], np.arange(len(rows) + 1))

        open_hot = spread((count == 0) & is_hot[h])
        open_cold = spread((count == 0) & (~is_hot & (total > 0))[h])
        changed = spread(common & (is_hot & bare)[h])
        change = np.log10(1 - 0.5 / changed[2])
        out: list[list] = [[], [], []]
        for i, (number, row) in enumerate(zip(chunks, rows, strict=True)):
            some = slice(base_doc[i], base_doc[i] + sizes[i])
            local = row[0].astype(np.uint32)
            a, b, c = (slice(x[3][i], x[3][i + 1]) for x in (open_hot, open_cold, changed))
            met, name = np.unique(open_cold[1][b], return_inverse=True)
            packed = _pack(
                local, score[some], base[some], *_small(known[some]),
                *_small(ranks[base_doc[i] * KATZ:(base_doc[i] + sizes[i]) * KATZ]),
                local[open_hot[0][a] - base_doc[i]], hot_at[open_hot[1][a]].astype(np.uint32),
                local[open_cold[0][b] - base_doc[i]], name.astype(np.uint32),
                *_small(rare[met].ravel()), mass[met], total[met].astype(float), covered[met],
                local[changed[0][c] - base_doc[i]], hot_at[changed[1][c]].astype(np.uint32), change[c], *row[1],
            )
            for column, v in zip(out, (part, number, packed), strict=True):
                column.append(v)
        of = np.bincount(np.minimum(count, KATZ + 2), minlength=KATZ + 3)[1:KATZ + 2].astype(np.int64)
        packed = _pack(
            hot_at[is_hot].astype(np.int64), rare[is_hot].ravel().astype(np.int64), mass[is_hot].astype(float),
            others[is_hot].astype(float), covered[is_hot], of,
        )
        for column, v in zip(out, (part, -1, packed), strict=True):
            column.append(v)
        return pa.Table.from_batches([_rows(*out)])

    return run


_RARE = [f"n{r}" for r in range(1, KATZ + 2)]
_HOT_SUMS = ", ".join(["hot long", *(f"{c} long" for c in _RARE), "mass double", "others double", "covered double"])


def _sum_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot histories, and the counts of counts as history -1."""
    for batch in batches:
        for raw in batch.column("row").to_pylist():
            hot, rare, mass, others, covered, of = _unpack(raw)
            rare = np.pad(rare.reshape(-1, KATZ), ((0, 1), (0, 1)))
            rare[-1] = of
            columns = [np.append(hot, -1), *rare.T, *(np.append(x, 0.0) for x in (mass, others, covered))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in columns], names=["hot", *_RARE, "mass", "others", "covered"]
            )


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(discount: np.ndarray, log_back: np.ndarray, hot_bare: np.ndarray, total: int):
    """All parts' sums of one chunk to its documents' rows."""
    weight = np.arange(1, KATZ + 1) * discount[1:]
    logs = np.log10(discount[1:])

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        raw = table.column("row").to_pylist()
        order = sorted(range(len(raw)), key=parts.__getitem__)
        who = next(x for x in (_unpack(raw[i])[-4:] for i in order) if len(x[0]))
        ids, none, tokens, train = who
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for i in order:
            (local, s, b, k, k_large, r, r_large, hot_doc, hot, cold_doc, cold, m, m_large, mass, count, covered,
             change_doc, change_hot, change, *_) = _unpack(raw[i])
            score[local] += s + _whole(r, r_large).reshape(-1, KATZ) @ logs
            base[local] += b
            known[local] += _whole(k, k_large)
            score += np.bincount(hot_doc, log_back[hot], len(ids))
            if len(cold):
                left = 1 - (mass + _whole(m, m_large).reshape(-1, KATZ) @ weight) / count
                score += np.bincount(cold_doc, np.log10(left / np.maximum(1 - covered, 1e-12))[cold], len(ids))
            if len(change):
                score += np.bincount(change_doc, np.where(hot_bare[change_hot], change, 0.0), len(ids))
        return pa.table({
            "doc_id": pa.array(ids, mask=none), "held_out": pa.array(~train), "n_tokens": pa.array(tokens),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words are runs without ASCII white space, A-Z lower-cased, and an end; null and empty texts are the end
    alone. All texts that are not held out are learned from, repeated rows as often as they stand. Without
    training texts every word is unknown. No documents, no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    # a token takes two bytes at least, but for a text's last word and end
    most = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 2)).first()[0] or 1
    share = min(HOT, PART_TOKENS / 2 / most)
    often = in_tasks(rows, _frequent(share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    size = often.where("word = 0").collect()
    if not size:
        return in_tasks(rows, lambda batches: iter(()), _OUT)
    tokens = size[0]["n"]
    # chunks in which a word is too rare to be told leave out less than half of what makes it hot; 2 / share at most
    found = often.where((F.col("word") != 0) & (F.col("n") >= tokens * share / 2)).orderBy("word").collect()
    hot = np.array([_START, *(np.uint64(r["word"] & (2**64 - 1)) for r in found if r["word"] != int(_END))], np.uint64)
    parts = max(1, -(-tokens // PART_TOKENS))
    word_parts = max(1, parts // 2)

    asked = in_tasks(rows, _requests(hot, parts, word_parts), _PARTS)
    counted = stored(asked.groupBy("part").applyInArrow(_count_words(parts), _PARTS))
    stats = np.sum([_unpack(bytes(r["row"]))[0] for r in counted.where("part < 0").collect()], axis=0).tolist()
    words = Words(stats[0], stats[1], stats[2:])
    # a hot history stands in training as often as its word does, the start as often as there are texts
    counts = rows.where("not held").agg(F.count(F.lit(1))).first()[0]
    exact = in_tasks(counted.where("part >= 0"), _counts_of(hot), "hot long, n long").distinct().collect()
    hot_count = np.zeros(len(hot))
    hot_count[0] = counts
    for r in exact:
        hot_count[r["hot"]] = r["n"]

    pairs = in_tasks(rows, _pairs(hot, parts), _PARTS).union(counted.where("part >= 0"))
    scored = stored(pairs.groupBy("part").applyInArrow(_score(words, hot, hot_count), _PARTS))
    sums = in_tasks(scored.where("chunk < 0"), _sum_hot, _HOT_SUMS)
    found = {
        r["hot"]: r for r in sums.groupBy("hot").agg(
            *(F.sum(c).alias(c) for c in (*_RARE, "mass", "others", "covered"))
        ).collect()
    }
    discount = discounts([found[-1][c] for c in _RARE])
    log_back, bare = np.zeros(len(hot)), np.zeros(len(hot), bool)
    for place, r in found.items():
        if place >= 0 and hot_count[place]:
            rare = [r[c] for c in _RARE[:KATZ]]
            bare[place] = not any(rare)
            mass = r["mass"] + sum(n * d * k for k, (n, d) in enumerate(zip(rare, discount[1:], strict=True), 1))
            mass -= r["others"] / 2 if bare[place] else 0
            left = max(1 - mass / hot_count[place], 1e-12)
            log_back[place] = np.log10(left / max(1 - r["covered"], 1e-12))
    return scored.where("chunk >= 0").groupBy("chunk").applyInArrow(_finish(discount, log_back, bare, stats[1]), _OUT)


def _counts_of(hot: np.ndarray):
    """Exact counts of the hot words, wherever a part has asked for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("row").to_pylist():
                words, small, large = _unpack(raw)
                at = pd.Index(words).get_indexer(hot)
                met = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met), pa.array(_whole(small, large)[at[met]])], names=["hot", "n"]
                )

    return run
