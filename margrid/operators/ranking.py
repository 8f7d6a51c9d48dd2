"""Row numbers and running totals that stay distributed when one group, or the whole table, is hot.

A plain window puts a whole group into one task.  Here a group is cut into ordered pieces, the
pieces are numbered in parallel and a small table of piece sizes supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from margrid.session import shuffle_width

_SAMPLE_PER_PIECE = 16
_MAX_PIECES = 1024


def hash_order_number(
    df: DataFrame,
    groups: Sequence[str],
    u: Column,
    ties: Sequence[str],
    name: str = "rn",
    pieces: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by groups order by u, ties)`` for a uniform u in (0, 1).

    Piece k of a group holds u in [k/pieces, (k+1)/pieces), so pieces are even whatever the
    group sizes are; rows are shuffled once, by (groups, piece).
    """
    pieces = pieces or shuffle_width(df.sparkSession)
    piece = F.floor(F.col("__u") * F.lit(pieces)).cast("int")
    rows = df.withColumn("__u", u).withColumn("__piece", piece)
    keys = [*groups, "__piece"]
    inner = Window.partitionBy(*keys).orderBy("__u", *ties)
    numbered = rows.withColumn("__rn", F.row_number().over(inner))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__piece").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    on = numbered["__piece"] == offsets["__p"]
    for i, g in enumerate(groups):
        on = on & numbered[g].eqNullSafe(offsets[f"__g{i}"])
    joined = numbered.join(offsets, on)
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("__rn") + F.col("__before")).cast("bigint").alias(name),
    )


def piece_bounds(values: DataFrame, col: str, pieces: int, by: Sequence[str] = ()) -> list | None:
    """Up to pieces-1 split points of a column of distinct values, or None for a short table.

    The sample is the fixed number of rows with the smallest key hashes, so what reaches the
    driver is bounded whatever the size of the table.
    """
    want = pieces * _SAMPLE_PER_PIECE
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, col)])
    taken = values.select(col, F.md5(text).alias("__h")).orderBy("__h").limit(want).collect()
    if len(taken) < want:
        return None
    ordered = sorted(r[0] for r in taken if r[0] is not None)
    step = max(len(ordered) // pieces, 1)
    return ordered[step::step][: pieces - 1]


def piece_of(col: str, bounds: list, dtype: str) -> Column:
    """Number of split points not above a value, found in two steps over a square grid of them."""
    width = max(int(len(bounds) ** 0.5), 1)
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    lits = lambda vs: F.array(*[F.lit(v).cast(dtype) for v in vs])
    upto = lambda cuts: F.size(F.filter(cuts, lambda b: b <= F.col(col)))
    block = upto(lits([b[0] for b in blocks]))
    inside = F.element_at(F.array(*[lits(b) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.greatest(block - 1, F.lit(0)) * F.lit(width) + upto(inside)


def running_total(
    values: DataFrame,
    order: str,
    amount: str,
    name: str = "before",
    follow: str | None = None,
    how: str = "sum",
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum (0 at the start) or maximum (NULL at the start) of ``amount`` over smaller ``order`` values.

    Order values are distinct inside each ``by`` group.  With ``follow`` the next order value of
    the group is added under that name.  A short table is one small window; a long one is
    range-cut at sampled split points and offset piece by piece.
    """
    by = list(by)
    fold = {"sum": F.sum, "max": F.max}[how]
    start = (lambda c: F.coalesce(c, F.lit(0))) if how == "sum" else (lambda c: c)
    merge = (lambda a, b: a + b) if how == "sum" else F.greatest
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    pieces = min(shuffle_width(values.sparkSession), _MAX_PIECES)
    bounds = piece_bounds(values, order, pieces, by)
    if bounds is None:
        w = Window.partitionBy(*by).orderBy(order)
        out = values.withColumn(name, start(fold(amount).over(upto(w))))
        return out.withColumn(follow, F.lead(order).over(w)) if follow else out
    rows = values.withColumn("__piece", piece_of(order, bounds, dict(values.dtypes)[order]))
    w = Window.partitionBy(*by, "__piece").orderBy(order)
    rows = rows.withColumn("__in", start(fold(amount).over(upto(w))))
    if follow:
        rows = rows.withColumn(follow, F.lead(order).over(w))
    totals = rows.groupBy(*by, "__piece").agg(
        fold(amount).alias("__sum"), F.min(order).alias("__first")
    )
    across = Window.partitionBy(*by).orderBy("__piece")  # at most one row per piece
    offsets = totals.select(
        *by,
        "__piece",
        start(fold("__sum").over(upto(across))).alias("__before"),
        F.lead("__first").over(across).alias("__next"),
    )
    out = rows.join(offsets, [*by, "__piece"]).withColumn(
        name, merge(F.col("__before"), F.col("__in"))
    )
    if follow:
        out = out.withColumn(follow, F.coalesce(F.col(follow), F.col("__next")))
    return out.select(*values.columns, name, *([follow] if follow else []))


def key_order_number(
    df: DataFrame, key: str, u: Column, ties: Sequence[str], name: str = "rn"
) -> DataFrame:
    """``row_number() over (order by key, u, ties)`` over the whole table, hot keys included."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    starts = running_total(counts, key, "__n", "__start").select(
        F.col(key).alias("__key"), "__start"
    )
    inside = hash_order_number(df, [key], u, ties, "__within")
    joined = inside.join(starts, inside[key] == starts["__key"])
    return joined.select(
        *df.columns, (F.col("__start") + F.col("__within")).cast("bigint").alias(name)
    )


def dense_codes(values: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Codes 0..n-1 of a column of distinct values, in value order."""
    ones = values.select(col).withColumn("__one", F.lit(1).cast("bigint"))
    return running_total(ones, col, "__one", name).select(col, F.col(name).cast("int").alias(name))
