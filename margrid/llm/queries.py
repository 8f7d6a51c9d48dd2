"""Registered queries of the training-data operators and the pipeline, with SQL where it can say the same."""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margrid.llm.common import table
from margrid.llm.decontaminate import decontaminate
from margrid.llm.embed_dedup import embedding_duplicates
from margrid.llm.exact_dedup import exact_duplicates
from margrid.llm.html_text import extract_text
from margrid.llm.katz import score_texts
from margrid.llm.license_scan import scan_licenses
from margrid.llm.near_dup import near_duplicates
from margrid.llm.packing import pack
from margrid.llm.periodic import periodic_runs
from margrid.llm.sharding import shard
from margrid.llm.token_counts import count_tokens
from margrid.llm.toxicity import score_toxicity
from margrid.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), size=2)


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages"))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_katz(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf, "embeddings"))


def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents"), keep="largest")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in a tenth of the documents, by crc32 of the id, the words from a place on repeat."""
    if doc_id is None or not words:
        return words
    kind, g = zlib.crc32(str(doc_id).encode()) % 10, zlib.crc32(str(doc_id).encode()) // 10
    if kind:
        return words
    start = g % len(words)
    tail = words[start:]
    period = 1 + len(tail) // (3 + g % 8)
    return words[:start] + (tail[:period] * (len(tail) // period + 1))[:len(tail)]


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    marked = periodic_runs(table(spark, sf, "documents"), edit=repeated_tail)
    # runs come by start, then period, so of equal exponents the first one stays
    best = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best),
    )
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return marked.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` at the repository's top."""
    return importlib.import_module("corpus_pipeline").run(spark, sf)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_packing, op3_minhash, op4_html_text, op5_token_counts, op6_toxicity, op7_katz,
        op8_decontamination, op9_sharding, op10_embedding_dedup, op11_exact_dedup, op12_periodic_runs,
        op13_whitening, pipeline,
    )
}

# Words of a text by the contract's rule, in DuckDB.
_WORDS = (
    r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_TOKENS = (
    r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x20\x09-\x0D]+')"
)

ORACLES: dict[str, str] = {
    "op3_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS.format(text='text')} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]]
        ELSE [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(text='text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k:k + 12] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(v) AS n FROM win),
spots AS (SELECT doc_id, n, k, w[k:k + n - 1] AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
          FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT s.doc_id, s.k, s.n, win.item_id FROM spots s JOIN win ON s.v = win.v),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS items_sha256
          FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}
