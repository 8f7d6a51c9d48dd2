"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score 1, tags score below 0 by how often they stand outside the
article on labelled pages (pages whose markup names one article); one scan finds the contiguous stretch with
the greatest sum, and the blocks of that stretch are the text. Elements that are never article text (menus,
forms, scripts, adverts, comments and so on) are passed over with all they hold, unless such a form or marked
element holds nearly all words of the page: then it wraps the article. Marks are whole class words or ids, so that a
layout named after its sidebar is no sidebar; class words that only contain a mark weigh on the scan.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks, slices

# Pages that the weights are learned from, in expectation (those whose hashes are lowest): the bound of the fit.
SAMPLE = 4_000
# A kind of tag needs this many sampled places to be weighed by them.
LEAST_PLACES = 20

# Elements whose content is not text, elements that hold no article text, class and id words and
# roles that mark such elements, elements that run on inside a block.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "math"}
APART = {"nav", "footer", "aside", "form", "button", "select", "dialog", "head", "menu", "header"} | RAW
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment",
    "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "footer",
    "header", "masthead", "widget", "pagination", "pager", "copyright", "login",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
# Elements that are apart whatever share of the words they hold.
ALWAYS = APART - {"form"}
# Share of the page's words from which on a form or a marked element wraps the page.
WRAPS = 0.8
# What a tag costs more whose class words contain a mark.
HINT = -4.0

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}

# Kinds of events: a piece of text, or a tag with its kind; apart is true in elements that are passed over.
Event = tuple[str, str, bool]


def _attributes(rest: str) -> tuple[set[str], set[str]]:
    marks, roles = set(), set()
    for found in _ATTRIBUTE.finditer(rest):
        value = (found[2] or found[3] or found[4] or "").lower()
        if found[1].lower() == "role":
            roles.update(value.split())
        else:
            marks.update(value.split())
    return marks, roles


def tokens(page: str) -> list[tuple[str, str, str, bool]]:
    """Tokens (text, tag name, kind, apart): text tokens have no name; closing kinds begin with a slash.

    The last entry says that the tag opens an element that is passed over.
    """
    out, at = [], 0
    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            out.append((page[at:], "", "", False))
            break
        if found.start() > at:
            out.append((page[at:found.start()], "", "", False))
        at = max(found.end(), found.start() + 1)
        if not found["name"]:
            continue
        name = found["name"].lower()
        if found["close"]:
            out.append(("", name, "/" + name, False))
            continue
        marks, roles = _attributes(found["rest"]) if "=" in found["rest"] else (set(), set())
        if name in RAW and not found["rest"].endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        apart = name not in VOID and name not in ARTICLE | {"body", "html"} and bool(
            name in APART or marks & MARKS or roles & ROLES
        )
        parts = {part for mark in marks for part in _PART.findall(mark)}
        kind = name if not marks else f"{name}.{min(parts & MARKS or parts or marks)}"
        out.append(("", name, kind, apart))
    return out


def _passed(page: list[tuple[str, str, str, bool]]) -> list[bool]:
    """Which tokens lie in (or bound) an element that is passed over.

    Such an element ends at its own closing tag; where that is missing, before the next article, heading or
    paragraph. A form or marked element that holds ``WRAPS`` of the words is not passed over, only what it holds.
    """
    out = [False] * len(page)
    words = [0]
    for text, _, _, _ in page:
        words.append(words[-1] + len(text.split()))
    i = 0
    while i < len(page):
        if not page[i][3]:
            i += 1
            continue
        name, depth, end = page[i][1], 0, None
        for j in range(i, len(page)):
            if page[j][1] == name:
                depth += -1 if page[j][2].startswith("/") else 1
                if not depth:
                    end = j + 1
                    break
            elif page[j][1] in ("body", "html") or page[j][1] in ARTICLE and not page[j][2].startswith("/"):
                break
        if end is None:
            end = next(
                (j for j in range(i + 1, len(page)) if page[j][1] in ARTICLE | {"h1", "p", "body"}), len(page)
            )
        if name not in ALWAYS and words[end] - words[i] >= max(WRAPS * words[-1], 1):
            i += 1
            continue
        out[i:end] = [True] * (end - i)
        i = end
    return out


class Weights:
    """Scores of kinds of tags: ``far`` for tags of the outside, near 0 for tags of the article."""

    def __init__(self, inside: dict[str, int], outside: dict[str, int], longest: int):
        self.far = float(max(longest, 20) + 1)
        self.score = {}
        for kind in inside.keys() | outside.keys():
            n_in, n_out = inside.get(kind, 0), outside.get(kind, 0)
            if n_in + n_out >= LEAST_PLACES:
                share = (n_out + 0.5) / (n_in + n_out + 1.0)
                self.score[kind] = -0.05 - self.far * share**2
        # where no labelled page has a tag, blocks cost little and lists and tables more
        self.unseen = {"ul": -1.0, "ol": -1.0, "table": -2.0}

    def of(self, kind: str, name: str) -> float:
        for k in (kind, kind.partition(".")[0]):
            if k in self.score:
                return self.score[k]
        if name in ARTICLE or name in ("body", "html"):
            return -self.far
        if kind.partition(".")[2] in MARKS:
            return HINT
        return self.unseen.get(name, -0.2 if name in INLINE else -0.5)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the greatest sum above 0; the first of equals."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def extract(page: str | None, weights: Weights) -> str:
    """The article text of one page, blocks joined by one space."""
    parsed = tokens(page or "")
    passed = _passed(parsed)
    scores = [
        0.0 if skip else float(len(text.split())) if not name else weights.of(kind, name)
        for (text, name, kind, _), skip in zip(parsed, passed, strict=True)
    ]
    lo, hi = best_stretch(scores)
    blocks, run = [], []
    for (text, name, _, _), skip in zip(parsed[lo:hi], passed[lo:hi], strict=True):
        if name:
            if name not in INLINE:
                blocks.append("".join(run))
                run = []
        elif not skip:
            run.append(text)
    blocks.append("".join(run))
    joined = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of kinds of tags inside and outside the article of labelled pages, and the longest outside run."""
    for batch in batches:
        inside, outside, longest = Counter(), Counter(), 0
        for page in batch.column("html").to_pylist():
            parsed = tokens(page or "")
            opens = [i for i, t in enumerate(parsed) if t[2].partition(".")[0] in ARTICLE]
            closes = [i for i, t in enumerate(parsed) if t[1] in ARTICLE and t[2].startswith("/")]
            if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
                continue
            for i, ((text, name, kind, _), skip) in enumerate(zip(parsed, _passed(parsed), strict=True)):
                within = opens[0] < i < closes[0]
                if name:
                    if not skip:
                        (inside if within else outside)[kind] += 1
                elif not within:
                    longest = max(longest, len(text.split()))
        kinds = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kinds, ""]), pa.array([*(inside[k] for k in kinds), 0], pa.int64()),
             pa.array([*(outside[k] for k in kinds), longest], pa.int64())],
            names=["kind", "inside", "outside"],
        )


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` pages; pages without exactly one article element teach nothing."""
    number = max(pages.count(), 1)
    drawn = pages.where(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / number) * (1 << 30)))
    )
    seen = in_tasks(drawn.select("html"), _observe, "kind string, inside long, outside long")
    rows = seen.groupBy("kind").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.max("outside").alias("longest")
    ).where(f"kind = '' or inside + outside >= {LEAST_PLACES}").collect()
    return Weights(
        {r["kind"]: r["inside"] for r in rows if r["kind"]}, {r["kind"]: r["outside"] for r in rows if r["kind"]},
        max((r["longest"] for r in rows if not r["kind"]), default=0),
    )


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [extract(p, weights) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space in a block becomes one space, blocks join by one. Null and
    empty pages, and pages without words outside the elements passed over, have the empty text; cut pages are
    read as far as they go; repeated rows are extracted each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return in_tasks(rows, _extract(learn(rows, sample)), "page_id long, url string, text string, n_chars long")
