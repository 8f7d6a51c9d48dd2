"""Token counts: pieces counted once per distinct pre-token, summed by each text's pre-token frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm import pieces
from margrid.llm.common import in_tasks, slices

LIMIT = 512


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=pieces.SLICE):
                text = batch.column("text")
                tokens = pa.array(pieces.token_counts(path, text), pa.int64())
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    ``tokenizer`` is the path of a byte-level tokenizer file on every executor. Distinct pre-tokens of a
    few MB of text at a time are numbered and their pieces counted once (a bounded memo of the worker keeps the
    counts); rows (document, pre-token, frequency) are joined to them by number and summed in the same task, so
    nothing is shuffled and no ids are kept. Null and empty texts have
    no tokens; repeated rows are counted each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_tasks(rows, _count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
