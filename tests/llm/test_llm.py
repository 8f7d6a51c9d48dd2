"""The training-data operators against plain versions, on small made tables with awkward rows."""

import collections
import html
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from margrid.llm import embed_dedup, katz, license_scan, near_dup, packing, queries, toxicity
from margrid.llm.components import components
from margrid.llm.decontaminate import decontaminate, drop_contaminated
from margrid.llm.embed_dedup import embedding_duplicates
from margrid.llm.html_text import Weights, best_stretch, extract, extract_text
from margrid.llm.sharding import shard
from margrid.llm.token_counts import count_tokens

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    "", None, " ", "one", "ONE", "a   b", "x<|endoftext|>  y", " lead  two\n\n\nthree \t tab  ", "it's we'll \x1c\x1d ΑΣ",
    "\x00nul \x00 x", "日本語 text 中文  다", "under the MIT License under the mit license", "CC by nc cc-by-nc",
    "long " * 3000,
]


def _made(spark, n=60, seed=3):
    """Random texts with near copies, the odd texts, a repeated row, a null id and clashing extra columns."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [r.choice(words) for _ in range(120)]
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 150))]
        if i % 3 == 0:
            w = list(base)
            for _ in range(r.randint(0, 14)):
                w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(0, rows[0][1]), (None, rows[3][1]), (None, "no id")]
    return rows, spark.createDataFrame(
        [(a, t, "s", 1, "k") for a, t in rows], "doc_id long, text string, shard string, n_words int, key string"
    )


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901"), ("901", "900"), ("5", "5")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(41)} | {"900": "900", "901": "900"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows, df = _made(spark)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else set(zip(*(w[j:] for j in range(size)))))
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = collections.Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and sets[i] and rows[j][0] is not None]
        comp = min(ids) if ids else d
        want[d, len(sets[i]), comp, d == comp] += 1
    got = collections.Counter(map(tuple, near_dup.near_duplicates(df, size).collect()))
    assert got == want
    kept = near_dup.drop_near_duplicates(df, size)
    assert kept.columns == df.columns
    assert kept.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert near_dup.near_duplicates(_empty(spark), size).count() == 0


def test_hot_group_of_near_copies(spark):
    r = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {x["component_id"] for x in out} == {0} and sum(x["kept"] for x in out) == 1


def test_links_inside_mixed_buckets(spark, monkeypatch):
    """Pairs at exactly 0.80 of words that all texts draw from: no link may get lost in the shared buckets."""
    r = random.Random(9)
    rows = []
    for i in range(200):
        inside = set(r.sample(range(228), 180))
        out = r.sample(sorted(inside), 20)
        near = inside - set(out) | set(r.sample(sorted(set(range(228)) - inside), 20))
        rows += [(2 * i + j, " ".join(f"w{k}" for k in sorted(s))) for j, s in enumerate((inside, near))]
    monkeypatch.setattr(near_dup, "BLOCK", 40, raising=False)
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == {d: d // 2 * 2 for d, _ in rows}


def test_sketches_bound_the_difference():
    import pyarrow as pa

    r = random.Random(6)
    sets = [set(r.sample(range(700), r.randint(1, 500))) for _ in range(40)]
    texts = pa.record_batch({"key": [str(i) for i in range(40)], "text": [" ".join(f"w{x}" for x in s) for s in sets]})
    got = [row["sketch"] for batch in near_dup._sketch(1)([texts]) for row in batch.to_pylist()]
    for a, x in zip(sets, got):
        for b, y in zip(sets, got):
            apart = sum((p ^ q).bit_count() for p, q in zip(x, y))
            assert apart <= len(a ^ b) and (apart - len(a ^ b)) % 2 == 0


def test_license_scan(spark):
    rows, df = _made(spark)
    want = collections.Counter()
    for d, t in rows:
        w, at, labels = WORD.findall((t or "").translate(AZ)), [], set()
        for phrase, label in license_scan.BASE.items():
            q = phrase.split()
            hit = [i for i in range(len(w)) if w[i:i + len(q)] == q]
            at += hit
            labels |= {label} if hit else set()
        want[d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    out = license_scan.scan_licenses(df).collect()
    assert collections.Counter(tuple(r)[:6] for r in out) == want
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} for r in out)
    notice = next(text for label, text, _ in license_scan.NOTICES if label == "gpl")
    got = license_scan.scan_licenses(spark.createDataFrame([(1, f"Intro. {notice.upper()}.")], "doc_id long, text string"))
    assert got.first()["labels"] == "gpl" and got.first()["score"] == 1.0
    assert license_scan.scan_licenses(_empty(spark)).count() == 0


def test_token_counts_and_packing(spark):
    from tokenizers import Tokenizer

    rows, df = _made(spark)
    path = P.path("byte_bpe_50k.json")
    encoded = Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = collections.Counter(
        (d, len((t or "").encode()), len(e), len(e) > 512) for (d, t), e in zip(rows, encoded, strict=True)
    )
    assert collections.Counter(map(tuple, count_tokens(df, path).collect())) == want
    path = P.path("word_bpe_49k.json")
    encoded = Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    pieces = collections.Counter()
    for (d, _), e in zip(rows, encoded, strict=True):
        ids = [*e.ids, 1]
        for s in range(0, len(ids), 2048):
            crc = zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())
            pieces[d, s, len(ids[s:s + 2048]), crc, len(ids)] += 1
    out = packing.pack(df, path).collect()
    assert collections.Counter(tuple(r)[:5] for r in out) == pieces
    filled = collections.defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for held in filled.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(_empty(spark), path).count() == 0 == count_tokens(_empty(spark), path).count()


def test_packing_patterns():
    r = random.Random(5)
    histogram = {r.randint(1, 2047): r.randint(1, 50) for _ in range(300)} | {7: 100_000}
    found = packing.patterns(histogram, 2048)
    assert all(sum(p) <= 2048 and n > 0 for p, n in found)
    placed = collections.Counter()
    for p, n in found:
        for length in p:
            placed[length] += n
    assert placed == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in found) <= math.ceil(total / 2048 * 1.02) + 1


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/x'>menu words here</a></nav>"
        "<div class='ad'>buy now</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>er text\n here<br>next line</p>"
        "<aside>see also</aside><p>Last &copy; words</p></article><div id='comments'><p>nice</p></div>"
        "<footer>&copy; somebody and many words of no use</footer></body></html>"
    )
    want = "Head & more First bolder text here next line Last © words"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page[: page.index("<aside>")]), (1, "u", page)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out)
    cut = "Head & more First bolder text here next line"
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, cut, len(cut))]
    assert best_stretch([-1, 2, -1, 3, -9, 4]) == (1, 4) and best_stretch([]) == best_stretch([-1.0]) == (0, 0)
    assert extract("<p>unclosed <nav>menu<p>kept", Weights({}, {}, 0)) == "unclosed kept"
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [re.sub(r"<[^>]*>?", "", b) for b in re.split(r"<(?:/?p|/?h1|br)>", inner)]
        assert out[r["page_id"]] == " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["Idiots,", "scum", "idiotic"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "scum"), (0, rows[0][1])]
    docs = spark.createDataFrame([(a, t, 0.5) for a, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    truth = dict(marks)
    held = [x for x in out if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out if x["doc_id"] is not None)
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    taken = docs.withColumn("score_", F.lit("x"))
    assert toxicity.drop_toxic(taken, labels).columns == taken.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, none).count() == len(rows)
    assert toxicity.score_toxicity(_empty(spark), labels).count() == 0


@pytest.mark.parametrize(("share", "caught"), [(0.2, 0.95), (0.05, 0.9)])
def test_words_toxic_only_together(share, caught):
    """Two words that say nothing alone, beside plain insults: the pair is learned, and single ones are left alone."""
    import pyarrow as pa

    def made(seed):
        r, rows, labels, pair = random.Random(seed), [], [], []
        for _ in range(12_000):
            w = [f"w{r.randrange(2000)}" for _ in range(40)]
            a, b, insult = r.random() < share, r.random() < share, r.random() < 0.07
            w[3], w[7], w[9] = ("alpha" if a else w[3]), ("beta" if b else w[7]), ("scum" if insult else w[9])
            rows.append(" ".join(w))
            labels.append(float(a and b or insult))
            pair.append((a and b and not insult, (a != b) and not insult))
        return toxicity.buckets_of(pa.array(rows)), np.array(labels), np.array(pair)

    machine = toxicity.fit(*made(1)[:2])
    buckets, _, pair = made(2)
    toxic = machine.score(buckets) >= toxicity.THRESHOLD
    assert toxic[pair[:, 0]].mean() >= caught and toxic[pair[:, 1]].mean() < 0.01


def _plain_katz(rows):
    def held(d):
        return d is not None and zlib.crc32(str(d).encode()) % 7 == 2

    texts = [(d, (t or "").encode().lower().split() + ["end"]) for d, t in rows]
    c, pairs, heads = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in texts:
        if not held(d):
            c.update(t)
            for h, w in zip(["start", *t], t):
                pairs[h, w] += 1
                heads[h] += 1
    of = lambda k: [sum(v == r for v in k.values()) for r in range(1, katz.KATZ + 2)]
    lower = katz.Words(len(c), sum(c.values()), of(c))
    discount = katz.discounts(of(pairs))
    p = lambda w: float(lower.probability(np.array([c[w]]))[0])
    kept = {k: float(katz._discounted(np.array([n]), discount)[0]) for k, n in pairs.items()}
    mass, cover = collections.Counter(), collections.Counter()
    for (h, w), n in kept.items():
        mass[h] += n
        cover[h] += p(w)
    for h in [h for h in heads if heads[h] - mass[h] < 1e-9]:
        kept |= {k: n - 0.5 for k, n in pairs.items() if k[0] == h}
        mass[h] = sum(n for k, n in kept.items() if k[0] == h)

    def prob(h, w):
        if (h, w) in kept:
            return kept[h, w] / heads[h]
        return ((1 - mass[h] / heads[h]) / max(1 - cover[h], 1e-12) if heads[h] else 1.0) * p(w)

    n, v = sum(c.values()), len(c)
    out = [
        (d, held(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t),
         sum(math.log10(prob(h, w)) for h, w in zip(["start", *t], t)))
        for d, t in texts
    ]
    return out, prob, c, lower


@pytest.mark.parametrize("part_tokens", [katz.PART_TOKENS, 900, 60])
def test_katz(spark, monkeypatch, part_tokens):
    rows, df = _made(spark, 120, 4)
    want, prob, c, lower = _plain_katz(rows)
    for h in ("start", next(iter(c))):  # back-off weights normalise exactly
        assert sum(prob(h, w) for w in c) + prob(h, "never seen") == pytest.approx(1, abs=1e-9)
    monkeypatch.setattr(katz, "PART_TOKENS", part_tokens)
    out = sorted(map(tuple, katz.score_texts(df).collect()), key=str)
    want = sorted(want, key=str)
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for got, plain in zip(sorted(out, key=key), sorted(want, key=key), strict=True):
        assert got[:5] == plain[:5]
        assert got[5] == pytest.approx(plain[5], rel=1e-9)
        assert got[6] == pytest.approx(plain[6], rel=1e-9)
    assert katz.score_texts(_empty(spark)).count() == 0


def test_katz_without_rare_pairs(spark, monkeypatch):
    """Histories whose pairs are all frequent, hot ones in several parts among them: each pair gives up a half."""
    r = random.Random(3)
    rows = [(i, "a b " * r.randint(20, 60) + r.choice(["", "c d", "b a", "new" + str(i)])) for i in range(60)]
    rows += [(100 + i, "x y x y x z") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x[0]: x for x in _plain_katz(rows)[0]}
    for tokens in (300, 10**6):
        monkeypatch.setattr(katz, "PART_TOKENS", tokens)
        for x in map(tuple, katz.score_texts(df).collect()):
            assert x[:5] == want[x[0]][:5] and x[5:] == pytest.approx(want[x[0]][5:], rel=1e-9)


def test_katz_beats_single_words(spark, sf):
    out = katz.score_texts(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out")
    score, base = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_decontaminate(spark):
    rows, docs = _made(spark)
    r = random.Random(8)
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(t.split()[5:5 + r.randint(14, 40)]).upper()) for i, t in enumerate(texts[:6])]
    items += [(50, "One!"), (51, ""), (52, None), (None, "text 中文"), (53, "text 中文"), (53, texts[7][:80])]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(AZ))
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[k:k + 13])].add(i)
    import hashlib

    want = collections.Counter()
    for d, t in rows:
        w, hit, ids = WORD.findall((t or "").translate(AZ)), set(), set()
        for v, of in windows.items():
            for k in range(len(w) - len(v) + 1):
                if tuple(w[k:k + len(v)]) == v:
                    hit.update(range(k, k + len(v)))
                    ids |= of
        names = sorted(str(x) for x in ids if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        want[d, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(map(tuple, decontaminate(docs, bench).collect())) == want
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate(_empty(spark), bench).count() == 0


def test_sharding(spark, monkeypatch):
    rows, df = _made(spark)
    df = df.union(df.where("doc_id = 3").crossJoin(spark.range(300)).drop("id"))
    rows = rows + [x for x in rows if x[0] == 3] * 300
    out = shard(df).collect()
    sized = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter(tuple(r)[:3] for r in out) == sized
    total, largest = sum(k[1] * n for k, n in sized.items()), max(k[1] for k in sized)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(sums[k] - total / 8) <= largest for k in range(8))
    assert shard(_empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    near = centres[rng.integers(0, 40, 1500)] + rng.normal(scale=0.12, size=(1500, 16))
    crowd = centres[0] + rng.normal(scale=0.02, size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([near, crowd]))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, rows[3][1], [2 * x for x in rows[3][1]], [1.0, 2.0]]
    rows += [(5000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(a, v, 1) for a, v in rows], "vec_id long, embedding array<double>, n_links int")
    out = {r["vec_id"]: r for r in embedding_duplicates(df).collect()}
    assert len(out) == len(rows)
    good = [(i, v) for i, v in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    e = np.array([v for _, v in good])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    linked = e @ e.T >= 0.95
    true = linked.sum(axis=1) - 1
    got = np.array([out[i]["n_links"] for i, _ in good])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()
    for i in (5000, 5001, 5002, 5003, 5004, 5007):
        assert tuple(out[i]) == (i, 0, i, True)
    assert out[5005]["component_id"] <= 3 and not out[5006]["kept"]
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_touching_crowds(spark, monkeypatch):
    """Two crowds that link across, with more rows than a block holds: all their rows link with each other."""
    monkeypatch.setattr(embed_dedup, "DEAL", 200)
    rng = np.random.default_rng(5)
    centre = np.zeros((2, 16))
    centre[0, 0] = 1
    centre[1, :2] = math.cos(math.radians(14)), math.sin(math.radians(14))
    crowds = np.repeat(centre, 600, axis=0) + rng.normal(scale=0.002, size=(1200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([crowds, rng.normal(size=(100, 16))]))]
    e = np.array([v for _, v in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    true = (e @ e.T >= 0.95).sum(axis=1) - 1
    assert (true[:1200] == 1199).all()
    out = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == dict(enumerate(true.tolist()))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = [("toxicity", 6), ("near_dedup", 3), ("decontamination", 8), ("packing", 2)]
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in plan]
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
    pieces = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {
        r["doc_id"] for r in docs.select("doc_id").collect()
    }


def test_registry(spark, sf, con):
    from oracle import compare

    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    for name, sql in queries.ORACLES.items():
        assert compare(queries.QUERIES[name](spark, sf), con, sql) == ""
    assert os.path.exists(corpus_pipeline.__file__)
