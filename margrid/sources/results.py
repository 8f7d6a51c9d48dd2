"""The results table: one row per (method, fold, budget), one column per metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["method_name", "fold_num", "epsilon"]
BASELINE = "Original"


def epsilon_key(c: Column | str) -> Column:
    """Canonical budget text: "1.0" and "1" agree, NULL and blanks become ""."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^(-?\d+)\.0+$", "$1")


def results_skeleton(
    methods: DataFrame, folds: int, epsilons: Sequence[str], existing: DataFrame | None = None
) -> DataFrame:
    """Keys that are not in the results yet; the baseline method has a blank budget."""
    eps = F.when(F.col("method_name") == BASELINE, F.array(F.lit(""))).otherwise(
        F.array(*[epsilon_key(F.lit(str(e))) for e in epsilons])
    )
    keys = (
        methods.select("method_name", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold_num"))
        .select("method_name", "fold_num", F.explode(eps).alias("epsilon"))
        .distinct()
    )
    if existing is None:
        return keys
    have = existing.select("method_name", "fold_num", epsilon_key("epsilon").alias("epsilon"))
    return keys.join(have, KEYS, "left_anti")


def upsert_metric(
    existing: DataFrame, updates: DataFrame, metrics: Sequence[str], order: str | None = None
) -> DataFrame:
    """Set metrics by key: updates are (method_name, fold_num, epsilon, metric, value).

    Among several updates of one metric of a key the one with the greatest ``order`` column wins, and
    without such a column the greatest value; rows and columns that do not exist yet are made, other cells
    stay.  One full outer join on the key, whatever the number of metrics.
    """
    latest = updates.withColumn("epsilon", epsilon_key("epsilon"))
    wide = latest.groupBy(*KEYS).agg(
        *[
            F.max_by("value", F.when(F.col("metric") == m, F.col(order or "value"))).alias(f"__{m}") for m in metrics
        ]
    )
    old = existing.withColumn("epsilon", epsilon_key("epsilon"))
    joined = old.join(wide, KEYS, "full_outer")
    others = [c for c in existing.columns if c not in KEYS and c not in metrics]
    set_cols = [
        (F.coalesce(f"__{m}", F.col(f"`{m}`")) if m in existing.columns else F.col(f"__{m}")).alias(m)
        for m in metrics
    ]
    return joined.select(*KEYS, *others, *set_cols)


def fold_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("method_name", "epsilon")) -> DataFrame:
    """Mean, sample and population deviation of each metric over the folds."""
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_samp(m).alias(f"{m}_std"),
            F.stddev_pop(m).alias(f"{m}_pstd"),
        ]
    return results.groupBy(*by).agg(*aggs)
