"""Order-dependent operators that never gather a whole group in one task.

A plain window sorts each of its partitions in a single task, which fails when
one entity, class or value holds a large part of the rows, or when there is no
partition key at all.  Here the rows are range-partitioned on (group, order), so
that a large group spreads over many *segments*.  Each segment is worked on by
itself, and what it owes to earlier segments of its group comes from a carry
table.  Only the first group of a segment can have begun in an earlier one, so
the carry table has at most one row per segment and is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelscape.session import settle

SEGMENT = "_segment"
_GROUP = "_group"
# Groups of up to this many rows are ordered by a plain window where a caller expects small ones.
SMALL_GROUP = 65_536


def segments(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Range-partition on ``order_by`` and number the partitions in that order."""
    return settle(df.repartitionByRange(*order_by).withColumn(SEGMENT, F.spark_partition_id()))


def all_small(df: DataFrame, within: Sequence[str]) -> bool:
    """Whether no group is too large for one task, and each is a small part of the whole; reads the group columns only."""
    sizes = df.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    return sizes["rows"] is not None and sizes["largest"] <= min(SMALL_GROUP, sizes["rows"] / 64)


def running(
    df: DataFrame,
    order_by: Sequence[Column | str],
    weight: Column | str | None = None,
    within: Sequence[str] = (),
    out: str = "before",
    often_small: bool = False,
) -> DataFrame:
    """Add the total weight of the rows before each row of its group (0 for the first one).

    ``order_by`` must order each group uniquely.  Without ``weight`` every row counts 1.
    With ``often_small`` a plain window is used if all groups are small.
    """
    weight = F.lit(1).cast("long") if weight is None else _col(weight)
    if often_small and all_small(df, within):
        earlier = Window.partitionBy(*within).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(earlier), F.lit(0).cast("long")))
    ranged = segments(df.withColumn("_weight", weight), [*within, *order_by])
    totals = ranged.groupBy(SEGMENT, *within).agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*within).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_carry", F.sum("_total").over(earlier)).where("_carry is not null").drop("_total")
    )
    local = Window.partitionBy(SEGMENT, *within).orderBy(*order_by)
    inside = F.sum("_weight").over(local.rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(carry), [SEGMENT, *within], "left")
        .withColumn(out, F.coalesce("_carry", zero) + F.coalesce("_inside", zero))
        .drop(SEGMENT, "_weight", "_inside", "_carry")
    )


def sequence(
    df: DataFrame,
    within: Sequence[str],
    order_by: Sequence[str],
    position: str = "token_pos",
    following: Mapping[str, str] | None = None,
    often_small: bool = False,
) -> DataFrame:
    """Number the rows of each group 1, 2, ... and look one row ahead.

    ``following`` maps new columns to the (never null) columns whose value in the
    next row of the group they take; they are null in the last row.
    With ``often_small`` a plain window is used if all groups are small.
    """
    following = dict(following or {})
    if often_small and all_small(df, within):
        whole = Window.partitionBy(*within).orderBy(*order_by)
        return df.select(
            *df.columns,
            F.row_number().over(whole).cast("long").alias(position),
            *[F.lead(src).over(whole).alias(new) for new, src in following.items()],
        )
    ranged = segments(df, [*within, *order_by])
    firsts = ranged.groupBy(SEGMENT, *within).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min_by(src, F.struct(*order_by)).alias(f"_first_{new}") for new, src in following.items()],
    )
    by_segment = Window.partitionBy(*within).orderBy(SEGMENT)
    carry = firsts.select(
        SEGMENT,
        *within,
        F.sum("_rows").over(by_segment.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        *[F.lead(f"_first_{new}").over(by_segment).alias(f"_ahead_{new}") for new in following],
    )
    ahead = [F.col(f"_ahead_{new}").isNotNull() for new in following]
    needed = F.col("_carry").isNotNull()
    for test in ahead:
        needed = needed | test
    local = Window.partitionBy(SEGMENT, *within).orderBy(*order_by)
    numbered = ranged.select(
        "*",
        F.row_number().over(local).cast("long").alias("_inside"),
        *[F.lead(src).over(local).alias(f"_next_{new}") for new, src in following.items()],
    ).join(F.broadcast(carry.where(needed)), [SEGMENT, *within], "left")
    return numbered.select(
        *[F.col(c) for c in df.columns],
        (F.coalesce("_carry", F.lit(0).cast("long")) + F.col("_inside")).alias(position),
        *[F.coalesce(f"_next_{new}", f"_ahead_{new}").alias(new) for new in following],
    )


def ordinal(
    df: DataFrame, order_by: Sequence[Column | str], within: Sequence[str] = (), out: str = "ordinal"
) -> DataFrame:
    """Add the 0-based place of each row in its group; ``order_by`` must be unique there."""
    return running(df, order_by, within=within, out=out)


def ladder(
    df: DataFrame,
    value: str,
    within: Sequence[str] = (),
    weights: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per distinct value with its count ``n`` and the count ``below`` of smaller ones.

    The rows are counted before they are moved, so a value that many rows share
    costs one row.  ``weights`` adds further per-value sums of the input rows.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*within, value)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(w).alias(name) for name, w in (weights or {}).items()],
        )
    )
    return running(counts, [value], weight="n", within=within, out="below")


def quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    joined = with_total(ladder(df, value, within), "n", within, "_total")
    picks, results = [], []
    for name, p in probabilities.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(covers, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * F.col(f"_{name}_part")).alias(name))
    return joined.groupBy(*within).agg(*picks).select(*within, *results)


def with_total(df: DataFrame, weight: str, within: Sequence[str] = (), out: str = "total") -> DataFrame:
    """Add the group's sum of ``weight`` to each row, without moving rows into one task."""
    if within:
        return df.join(df.groupBy(*within).agg(F.sum(weight).alias(out)), list(within))
    return df.withColumn(out, df.select(F.sum(weight)).scalar())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
