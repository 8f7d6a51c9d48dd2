"""Cleaning, recoding, binning and imputation of raw tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margrid.functions.hashing import uniform
from margrid.operators.ranking import dense_codes, hash_order_number, running_total
from margrid.session import cut

# Spellings read as missing, and columns that leak the bar-passage label.
MISSING_TOKENS = ["unknown", "Unknown", "NA", "na", "NaN", ""]
LEAKY_COLUMNS = [
    "bar1", "bar2", "bar1_yr", "bar2_yr", "bar", "bar_passed", "Dropout",
    "dnn_bar_pass_prediction",
]


# ---------------------------------------------------------------- projection and filters


def project(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    return df.select(*cols, *([weight] if weight else []))


def drop_roles(df: DataFrame, *roles: Sequence[str]) -> DataFrame:
    """Drop protected, inadmissible or other role columns."""
    return df.drop(*[c for role in roles for c in role])


def filter_in(df: DataFrame, col: str, values: Sequence, keep: bool = True) -> DataFrame:
    hit = F.col(col).isin(list(values))
    return df.where(hit if keep else ~hit)


def cast_columns(df: DataFrame, cols: Sequence[str], source: str, target: str) -> DataFrame:
    """Cast columns after checking that they have the expected type."""
    types = dict(df.dtypes)
    wrong = [c for c in cols if types[c] != source]
    if wrong:
        raise TypeError(f"columns are not {source}: {wrong}")
    return df.withColumns({c: F.col(c).cast(target) for c in cols})


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)


def clean_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing spellings to NULL, then blanks and quotes trimmed off both ends."""
    strip = lambda c: F.regexp_replace(
        F.regexp_replace(F.trim(c), '^"+|"+$', ""), "^'+|'+$", ""
    )
    return df.withColumns(
        {c: strip(F.when(~F.col(c).isin(list(tokens)), F.col(c))) for c in cols}
    )


def boolean_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns whose every non-NULL value reads true/false become 1/0, the others stay text.

    Whether a column is boolean is found by one aggregate over all columns.
    """
    flags = df.agg(
        *[
            (
                F.coalesce(F.bool_and(F.lower(c).isin("true", "false")), F.lit(False))
            ).alias(c)
            for c in cols
        ]
    ).first()
    return df.withColumns(
        {c: (F.lower(c) == "true").cast("int") for c in cols if flags[c]}
    )


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-NULL value (min equals max: no distinct needed)."""
    row = df.agg(
        *[
            F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(c) for c in cols
        ]
    ).first()
    return [c for c in cols if row[c]]


def drop_constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, list(cols or df.columns)))


def drop_leaky_columns(df: DataFrame, names: Sequence[str] = LEAKY_COLUMNS) -> DataFrame:
    return df.drop(*names)


# ---------------------------------------------------------------- label codes


def fit_codes(df: DataFrame, col: str, as_text: bool = True) -> DataFrame:
    """Dictionary (value, code): rank of the value, as text by default."""
    value = F.col(col).cast("string") if as_text else F.col(col)
    values = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    return dense_codes(values, "value")


def apply_codes(df: DataFrame, col: str, codes: DataFrame, unknown: int | None = None) -> DataFrame:
    """Replace a column by its code; values missing from the dictionary become ``unknown``."""
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    key = F.col(col).cast(dict(codes.dtypes)["value"])
    joined = df.join(table, key == F.col("__value"), "left")
    code = F.col("__code") if unknown is None else F.coalesce("__code", F.lit(unknown))
    return joined.withColumn(col, code).drop("__value", "__code")


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes by text order, column by column ("10" sorts before "2")."""
    return reduce(lambda d, c: apply_codes(d, c, fit_codes(df, c)), cols, df)


def ordinal_encode_unknown(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes fitted on one table, applied to another; unseen and missing values become -1."""
    return reduce(lambda d, c: apply_codes(d, c, fit_codes(train, c), -1), cols, df)


def encode_with_mean_impute(df: DataFrame, cols: Sequence[str], missing: str = "?") -> DataFrame:
    """Codes by text order; the missing mark takes the rounded mean code of the other rows."""
    out = df
    for c in cols:
        codes = fit_codes(df, c)
        counts = df.select(F.col(c).cast("string").alias("value")).groupBy("value").count()
        known = codes.join(counts, "value").where(F.col("value") != missing)
        mean = known.select(F.sum(F.col("code") * F.col("count")) / F.sum("count")).scalar()
        filled = codes.withColumn(
            "code",
            F.when(F.col("value") == missing, F.bround(mean, 0).cast("int")).otherwise(
                F.col("code")
            ),
        )
        out = apply_codes(out, c, filled)
    return out


# ---------------------------------------------------------------- bins and scales


def quantile_array(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row with an array ``q``.

    Values are counted, their running total gives each value its rank range, and each value
    emits the wanted ranks it holds: nothing larger than a value count is moved.
    """
    counts = _value_counts(df, col)
    last = counts.select((F.sum("n") - 1).cast("double")).scalar()
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.col("last") * F.lit(float(p))).alias("at"))
            for i, p in enumerate(probs)
        ]
    )
    ranked = running_total(counts, "v", "n").withColumn("last", last).withColumn("wanted", wanted)
    held = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    inside = F.filter("wanted", lambda s: held(F.floor(s["at"])) | held(F.ceil(s["at"])))
    hits = ranked.select("v", "before", "n", F.explode(inside).alias("w"))
    frac = F.col("w.at") - F.floor("w.at")
    low = F.when(held(F.floor("w.at")), F.col("v"))
    high = F.when(held(F.ceil("w.at")), F.col("v"))
    ends = hits.groupBy("w.i").agg(F.max(low).alias("lo"), F.max(high).alias("hi"), F.max(frac).alias("f"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")
    # one entry per requested quantile
    return ends.agg(F.sort_array(F.collect_list(F.struct("i", value.alias("q")))).alias("s")).select(
        F.col("s.q").alias("q")
    )


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles as one row (q0, q1, ...)."""
    row = quantile_array(df, col, probs)
    return row.select(*[F.get("q", i).alias(f"q{i}") for i in range(len(probs))])


def _value_counts(df: DataFrame, col: str) -> DataFrame:
    values = df.where(F.col(col).isNotNull())
    return values.groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """Distinct quantile edges of a column on the driver: at most q+1 numbers.

    The value counts are written once; the ranks wanted are then plain numbers, and only the
    values that hold one of them (at most two per edge) come back.
    """
    counts = cut(_value_counts(df, col))
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return []
    places = [(total - 1) * (i / q) for i in range(q + 1)]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    held = [(F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("n")) for r in ranks]
    hits = running_total(counts, "v", "n").where(reduce(lambda x, y: x | y, held)).collect()
    value = {r: h["v"] for h in hits for r in ranks if h["before"] <= r < h["before"] + h["n"]}
    low, high = [value[math.floor(p)] for p in places], [value[math.ceil(p)] for p in places]
    return sorted({a + (b - a) * (p - math.floor(p)) for a, b, p in zip(low, high, places)})


def quantile_bin(df: DataFrame, cols: Sequence[str], q: int = 5) -> DataFrame:
    """Bin number by exact quantile edges, right-closed, equal edges merged."""
    out = {}
    for c in cols:
        inner = quantile_edges(df, c, q)[1:-1]
        above = [(F.lit(e) < F.col(c)).cast("int") for e in inner]
        out[c] = sum(above, F.when(F.col(c).isNotNull(), F.lit(0)))
    return df.withColumns(out)


def equal_width_bin_mean(df: DataFrame, col: str, n: int, whole: bool = False) -> DataFrame:
    """Equal-width right-closed bins; each value becomes its bin's mean (rounded if ``whole``).

    The bin means are one small table joined back, so no bin is gathered in one task.
    """
    span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = span.select(F.col("lo").cast("double")).scalar()
    hi = span.select(F.col("hi").cast("double")).scalar()
    pos = F.ceil((F.col(col) - lo) / ((hi - lo) / F.lit(float(n))))
    binned = df.withColumn(
        "__bin",
        F.when(hi > lo, F.greatest(F.least(pos, F.lit(n)), F.lit(1)).cast("int")).otherwise(1),
    )
    mean = F.avg(col)
    means = binned.groupBy("__bin").agg((F.bround(mean, 0) if whole else mean).alias("__mean"))
    return binned.join(means, "__bin").withColumn(col, F.col("__mean")).select(*df.columns)


def scale_by_std(
    df: DataFrame, cols: Sequence[str], coefs: Mapping[str, float] | None = None, digits: int = 4
) -> DataFrame:
    """Divide by the sample deviation (where not 0), apply a coefficient, round half-even."""
    stats = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    coefs = coefs or {}
    out = {}
    for c in cols:
        s = stats.select(c).scalar()
        scaled = F.when(s != 0, F.col(c) / s).otherwise(F.col(c)) * F.lit(float(coefs.get(c, 1.0)))
        out[c] = F.bround(scaled, digits)
    return df.withColumns(out)


def unscale(
    df: DataFrame,
    reference: DataFrame,
    cols: Sequence[str],
    coefs: Mapping[str, float] | None = None,
) -> DataFrame:
    """Undo ``scale_by_std`` with the deviations of the reference table, rounded to whole numbers."""
    stats = reference.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    coefs = coefs or {}
    out = {}
    for c in cols:
        s = stats.select(c).scalar()
        raw = F.col(c) / F.lit(float(coefs.get(c, 1.0)))
        out[c] = F.when(s != 0, F.bround(raw * s, 0)).otherwise(raw)
    return df.withColumns(out)


def one_hot(df: DataFrame, col: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """Indicator columns <prefix>_<value> in place of a column."""
    prefix = prefix or col
    marks = {f"{prefix}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(marks).drop(col)


def undummify(df: DataFrame, prefix: str, sep: str = "_") -> DataFrame:
    """Collapse <prefix>_<value> columns back to the value of the largest one (first on ties)."""
    cols = [c for c in df.columns if c.startswith(prefix + sep)]
    best = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    value: Column | None = None
    for c in cols:
        label = c[len(prefix + sep) :]
        hit = F.col(c) == best
        value = F.when(hit, label) if value is None else value.when(hit, label)
    return df.withColumn(prefix, value).drop(*cols)


# ---------------------------------------------------------------- imputation


def impute_random_observed(
    df: DataFrame, col: str, key: Sequence[str], seed: str, missing: int = -1
) -> DataFrame:
    """NULL and -1 become a uniform draw among the observed codes; 0 when nothing was observed.

    Observed codes are numbered 0..k-1 and drawn by number through an equi-join.
    """
    gap = F.col(col).isNull() | (F.col(col) == missing)
    seen = df.where(~gap).select(col).distinct()
    table = dense_codes(seen, col, "__code").withColumnRenamed(col, "__value")
    k = table.select(F.count(F.lit(1))).scalar()
    pick = F.when(gap, F.floor(uniform(seed, *key) * k).cast("int"))
    joined = df.withColumn("__pick", pick).join(table, F.col("__pick") == F.col("__code"), "left")
    value = F.when(gap, F.coalesce("__value", F.lit(0))).otherwise(F.col(col))
    return joined.withColumn(col, value).select(*df.columns)


def one_row_per_group(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """One random row per group: the smallest hash wins, by a combinable aggregate."""
    others = [c for c in df.columns if c != group]
    best = F.min_by(F.struct(*others), F.struct(uniform(seed, key), F.col(key))).alias("__row")
    return df.groupBy(group).agg(best).select(group, "__row.*").select(*df.columns)


def shuffle_rows(df: DataFrame, key: str, seed: str, name: str = "position") -> DataFrame:
    """Random order as a position 1..n."""
    return hash_order_number(df, [], uniform(seed, key), [key], name)
