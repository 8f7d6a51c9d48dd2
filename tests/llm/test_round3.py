"""Exact deduplication, periodic runs and whitening against plain versions."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from margrid.llm import periodic, queries, whitening
from margrid.llm.common import giving_back
from margrid.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    r = random.Random(11)
    base = ["Some Text here", "some text here", "ΑΣ text", "ας TEXT", "", None, "İx", "i̇x", "x" * 300_000, "X" * 300_000]
    rows = [(i, base[i % len(base)]) for i in range(40)]
    rows += [(100 + i, r.choice(["hot copy", "HOT copy"])) for i in range(200)]
    rows += [(500 + i, f"alone {i}") for i in range(30)]
    # repeated rows, rows without ids, a group without any id
    return rows + [(139, "hot COPY"), (299, "Hot copy"), (299, "Hot copy"), (None, "hot copy"), (None, "no id"), (None, "No id")]


def _docs(spark, rows):
    return spark.createDataFrame(
        [(a, t, 1, "k", "v", 2) for a, t in rows],
        "doc_id long, text string, row int, key string, body string, group_size int",
    )


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [128, 3])
def test_exact_duplicates(spark, keep, bits):
    rows = _texts()
    key = {} if bits == 128 else {"key": lambda t: F.length(t) % 8}  # few values: most keys are collisions
    out = exact_duplicates(_docs(spark, rows), keep, **key).collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(AZ)].append(d)
    best = max if keep == "largest" else min
    want = collections.Counter()
    for text, ids in groups.items():
        keep_id = best([d for d in ids if d is not None], default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((d, keep_id, len(ids), sha) for d in ids)
    assert collections.Counter((r[0], r[1], r[2], r[4]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_exact_duplicates(spark):
    rows = _texts()
    docs = _docs(spark, rows)
    left = drop_exact_duplicates(docs, "largest")
    assert left.columns == docs.columns
    texts = [(r["text"] or "").translate(AZ) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(AZ) for _, t in rows})
    assert exact_duplicates(docs.limit(0)).count() == 0 == drop_exact_duplicates(docs.limit(0)).count()
    with pytest.raises(ValueError):
        exact_duplicates(docs, "any")


def _plain_runs(w, shortest=6, exponent=4):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n, part = i + q - start, w[start:i + q]
            if n >= max(shortest, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, n, q))
    return sorted(out)


def _plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("shortest", "exponent"), [(6, 4), (2, 2), (9, 3), (1, 2)])
def test_find_runs(shortest, exponent):
    r = random.Random(shortest)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 5)):
            k = r.randint(1, 4)
            w = [r.randrange(k) for _ in range(r.randint(0, 40))]
            block = [r.randrange(k) for _ in range(r.randint(1, 7))]
            w += (block * 12)[:r.randint(0, 70)]
            w += [r.randrange(k) for _ in range(r.randint(0, 9))]
            texts.append(w)
        first = np.cumsum([0, *map(len, texts)])
        got = periodic.find_runs(np.array([x for w in texts for x in w], np.int64), first, shortest, exponent)
        want = [(s + int(at), n, q) for at, w in zip(first, texts) for s, n, q in _plain_runs(w, shortest, exponent)]
        assert got == want


def test_long_runs():
    n = 120_000
    one = np.array([0, n])
    assert periodic.find_runs(np.zeros(n, np.int64), one) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % (n // 5), one) == [(0, n, n // 5)]
    assert periodic.find_runs(np.arange(n) % (n // 3), one) == []
    nested = np.concatenate([np.repeat(7, 8), np.arange(5)])
    assert periodic.find_runs(np.tile(nested, 6), np.array([0, 78]))[:2] == [(0, 8, 1), (0, 78, 13)]


def _run_rows():
    r = random.Random(12)
    rows = []
    for i in range(120):
        w = [r.choice("abcdefghij") for _ in range(r.randint(0, 60))]
        if i % 4 == 0:
            w += [r.choice("abc") for _ in range(r.randint(1, 5))] * r.randint(2, 12)
        rows.append((i, "  ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "Ha ha Ha ha Ha ha Ha ha"), (204, "x\xa0x " * 9), (205, "long " * 30_000)]
    rows += [(206, "日本 語 " * 6), (0, rows[0][1]), (None, "a b " * 5), (207, "\x1c \x1c\x0b\x1c \x1c \x1c \x1c \x00")]
    # texts beyond a slice of 4 MB, with a run across the place where a cut could be
    return rows + [(208, "p q r " * 800_000 + "end"), (209, " ".join(f"w{i % 400_000}" for i in range(700_000)) + " z" * 7)]


def test_periodic_runs(spark):
    rows = _run_rows()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, runs int, n_words int")
    out = periodic.periodic_runs(docs).collect()
    got = collections.Counter(
        (x["doc_id"], x["n_words"], tuple(map(tuple, x["runs"])), x["collapsed"]) for x in out
    )
    want = collections.Counter()
    known = {205: [(0, 30_000, 1)], 208: [(0, 2_400_000, 3)], 209: [(700_000, 7, 1)]}
    for d, t in rows:
        w = (t or "").encode().split()
        runs = known[d] if d in known else _plain_runs(w)
        want[d, len(w), tuple(runs), _plain_collapse(w, runs).decode()] += 1
    assert got == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=1)


def _plain_edit(d, w):
    w, n = list(w), len(w)
    h = zlib.crc32(str(d).encode())
    if d is None or h % 10 or not n:
        return w
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_query(spark, tmp_path):
    rows = [x for x in _run_rows() if x[0] not in (205, 208, 209)]
    r = random.Random(4)
    rows += [(1000 + i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 90)))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()))
    want, tails = collections.Counter(), 0
    for d, t in rows:
        w = _plain_edit(d, (t or "").encode().split())
        runs = _plain_runs(w)
        tails += w != (t or "").encode().split()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[
            d, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_plain_collapse(w, runs)).hexdigest(),
        ] += 1
    assert tails > 10 and got == want


def _plain_whitening(rows, dims, components=16):
    good = [(i, v) for i, v in rows if v and None not in v and len(v) == dims and all(map(math.isfinite, v))]
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in good}
    unique = sorted({tuple(v) for v in x.values()})
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(v, sums)] for v in unique]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, v in x.items():
        exact = [n * a - s for a, s in zip(v, sums)]
        w = np.array([e / n for e in exact]) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = (n, sum(e * e for e in exact), w, values[order] / np.trace(cov))
    return out


def test_whitening(spark):
    rng = np.random.default_rng(3)
    dims = 7
    data = rng.normal(size=(150, dims)) @ rng.normal(size=(dims, dims)) * np.array([1, 1, 1, 1e-2, 3, 40, 1]) + 5
    data[:50] = data[0]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(500 + i, v) for i, v in enumerate(
        [None, [], [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [None] * dims, [1.0, 2.0], [0.0] * dims, rows[7][1]]
    )]
    rows.append((rows[3][0], rows[3][1]))
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, x double")
    out = whitening.whiten(df.repartition(3), components=5, block=40).collect()
    want = _plain_whitening(rows, dims, 5)
    assert len(out) == 5 * (len(want) + 1) and {r["vec_id"] for r in out} == set(want)
    sign = {}
    for r in out:
        n, deviation, w, share = want[r["vec_id"]]
        k = r["component"] - 1
        sign.setdefault(k, np.sign(r["whitened"] * w[k]))
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] == pytest.approx(sign[k] * w[k], rel=1e-8, abs=1e-10)
        assert r["explained"] == pytest.approx(share[k], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in out}) == 1


def test_whitening_of_few_and_flat(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    alone = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert [tuple(r)[1:] for r in alone] == [(k, 1, 0, None, None, None) for k in (1, 2, 1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.75, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] and round(abs(r["whitened"]), 9), r["explained"]) for r in flat) == [
        (1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)
    ]
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    assert len(got) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def test_popcounts_are_exact():
    """Sums of products of 40-bit values are the integers themselves, far beyond what a double holds."""
    import pyarrow as pa

    r = random.Random(6)
    x = [[r.randrange(-(2**39), 2**39), r.randrange(3), 5] for _ in range(130)]
    low = [min(v[i] for v in x) for i in range(3)]
    bits = [(max(v[i] for v in x) - low[i]).bit_length() for i in range(3)]
    batch = pa.record_batch({"x": pa.array([np.array(v, "<i8").tobytes() for v in x], pa.binary())})
    sums = collections.Counter()
    for out in whitening._popcounts(np.array(low), bits, 3, 64)([batch]):
        for row in out.to_pylist():
            sums[row["i"], row["j"]] += row["n"] << row["power"]
    assert sums[-1, -1] == 130 and bits[2] == 0
    for i in range(2):
        assert sums[i, -1] == sum(v[i] - low[i] for v in x)
        for j in range(i, 2):
            assert sums[i, j] == sum((v[i] - low[i]) * (v[j] - low[j]) for v in x)


WORDS = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("open_, close", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div class='header-fixed site'>", "</div>"),
    ("<section class='page with-comments'>", "</section>"), ("<div id='social-history'>", "</div>"),
    ("<form action=/x>", "</form>"), ("<div class='sidebar'>", "</div>"), ("<p title=it's>", "</p>"), ('<p title=5">', "</p>"),
])
def test_wrapped_articles_stay(open_, close):
    from margrid.llm.html_text import Weights, extract

    page = f"<html><body><nav><a>Home</a> <a>About</a></nav>{open_}<p>{WORDS}</p>{close}<footer>small print</footer></body></html>"
    assert extract(page, Weights({}, {}, 0)) == WORDS


def test_lists_stay_and_marked_parts_go():
    from margrid.llm.html_text import Weights, extract

    items = "".join(f"<li>item number {i}</li>" for i in range(10))
    page = (
        f"<body><div class='post no-sidebar'><p>{WORDS}</p><ul>{items}</ul></div>"
        f"<div class='comments'><p>nice words of a reader</p></div><div class='sidebar'>other things</div></body>"
    )
    assert extract(page, Weights({}, {}, 0)) == WORDS + " " + " ".join(f"item number {i}" for i in range(10))


def _links(vectors, of):
    """True links and components of the rows ``of`` by brute force, in blocks."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return (unit[of] @ unit.T >= 0.95).sum(axis=1) - 1


@pytest.mark.parametrize("rows", [30_000, 100_000])
def test_embedding_recall_of_loose_groups(spark, rows, tmp_path):
    """A third of the rows in one group whose members link at about 0.96: too loose for a crowd."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from margrid.llm.embed_dedup import embedding_duplicates

    rng = np.random.default_rng(rows)
    dims, hot = 32, rows // 3
    vectors = rng.normal(size=(rows, dims))
    centre = vectors[0] / np.linalg.norm(vectors[0])
    vectors[:hot] = centre + rng.normal(scale=math.sqrt((1 / 0.96 - 1) / dims), size=(hot, dims))
    twins = np.arange(hot, hot + 2000)
    vectors[twins] = vectors[twins + 2000] + rng.normal(scale=0.15, size=(2000, dims))
    table = {"vec_id": np.arange(rows), "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), dims).cast(pa.list_(pa.float64()))}
    pq.write_table(pa.table(table), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet").repartition(16)
    got = embedding_duplicates(df).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"]
    for some in (rng.choice(hot, 300, replace=False), twins[:300]):
        true = _links(vectors, some)
        found = got.loc[some].to_numpy()
        assert true.sum() > 0 and (found <= true).all()
        assert found.sum() >= 0.9 * true.sum(), found.sum() / true.sum()


def test_giving_back_passes_all_results_on():
    """Every result arrives in order, whether or not the reader stops early, and the work is closed then."""
    closed = []

    def work(batches):
        try:
            yield from (b * 2 for b in batches)
        finally:
            closed.append(True)

    assert list(giving_back(work)(iter(range(5)))) == [0, 2, 4, 6, 8]
    assert list(giving_back(work)(iter(()))) == []
    some = giving_back(work)(iter(range(5)))
    assert next(some) == 0
    some.close()
    del some
    assert closed == [True] * 3
