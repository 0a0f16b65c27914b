"""Rank statistics: ordinal and average ranks, Spearman, rank sums, strict percentiles, top sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.config import TOP_FRACTION
from novelscape.operators.ordering import ladder, ordinal, running, with_total
from novelscape.operators.tokens import ENTITY
from novelscape.session import settle


def average_ranks(df: DataFrame, value: str, within: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """``within, value, n, out``: the average rank (from 1) of each distinct value."""
    steps = ladder(df, value, within)
    return steps.select(*within, value, "n", (F.col("below") + (F.col("n") + 1) / 2).alias(out))


def rank01(df: DataFrame, value: str, ident: str = ENTITY, out: str = "rank01") -> DataFrame:
    """Ordinal rank scaled to 0..1, ties in id order; 0 if there is a single row."""
    placed = ordinal(df, [value, ident], out="_place")
    top = df.select(F.count(F.lit(1)) - 1).scalar()
    return placed.withColumn(out, F.coalesce(F.try_divide(F.col("_place"), top), F.lit(0.0))).drop("_place")


def rank_from_top(df: DataFrame, value: str, ident: str = ENTITY, out: str = "rank") -> DataFrame:
    """1 for the largest value, ties in id order."""
    return ordinal(df, [F.desc(value), F.asc(ident)], out="_place").withColumn(out, F.col("_place") + 1).drop("_place")


def spearman(df: DataFrame, x: str, y: str, within: Sequence[str] = ()) -> DataFrame:
    """``within, n, rho`` with average ranks for ties; rho is null for constant columns.

    Equal pairs are counted first; ranks come from the ladder of each column, and are
    centered before they are multiplied.
    """
    rows = df.select(*within, F.col(x).alias("_x"), F.col(y).alias("_y")).where(
        "_x is not null and _y is not null"
    )
    pairs = rows.groupBy(*within, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))

    def centered(column: str, out: str) -> DataFrame:
        ranks = with_total(average_ranks(rows, column, within, "_r"), "n", within, "_all")
        return ranks.select(*within, column, (F.col("_r") - (F.col("_all") + 1) / 2).alias(out))

    joined = pairs.join(centered("_x", "_rx"), [*within, "_x"]).join(centered("_y", "_ry"), [*within, "_y"])
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    sums = joined.groupBy(*within).agg(
        F.sum(n).alias("n"),
        F.sum(n * rx * ry).alias("_xy"),
        F.sum(n * rx * rx).alias("_xx"),
        F.sum(n * ry * ry).alias("_yy"),
    )
    return sums.select(*within, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("rho"))


def rank_sum(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """One row ``n_a, n_b, u, cliffs_delta, ties`` comparing two groups.

    ``u`` counts the pairs where a is larger, ties as one half; Cliff's delta is
    2 u / (n_a n_b) - 1.  Pairs are never formed: both follow from the ladder of values.
    """
    rows = df.where(in_a | in_b).select(value, in_a.alias("_a"), in_b.alias("_b"))
    one = F.lit(1).cast("long")
    steps = ladder(
        rows,
        value,
        weights={
            "_na": F.when(F.col("_a"), one).otherwise(0),
            "_nb": F.when(F.col("_b"), one).otherwise(0),
        },
    )
    rank = F.col("below") + (F.col("n") + 1) / 2
    tied = F.col("n").cast("double")
    sums = steps.agg(
        F.coalesce(F.sum("_na"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("_nb"), F.lit(0)).alias("n_b"),
        F.sum(F.col("_na") * rank).alias("_ra"),
        F.sum(tied * tied * tied - tied).alias("ties"),
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("_ra") - a * (a + 1) / 2
    return sums.select(
        "n_a",
        "n_b",
        u.alias("u"),
        F.coalesce(F.try_divide(2 * u, a * b) - 1, F.lit(0.0)).alias("cliffs_delta"),
        "ties",
    )


def strict_percentile(
    queries: DataFrame, references: DataFrame, value: str = "knn_mean_dist", out: str = "novelty", weight: str | None = None
) -> DataFrame:
    """Add the share of reference values that are strictly smaller; a reference row may stand for ``weight`` equal ones."""
    count = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    references = references.select(value, count.alias("_ref"))
    both = (
        references
        .unionAll(queries.select(value, F.lit(0).cast("long").alias("_ref")))
        .where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.sum("_ref").alias("_ref"))
    )
    total = references.select(F.sum(F.when(F.col(value).isNotNull(), F.col("_ref")))).scalar()
    steps = running(both, [value], "_ref", out="_below").select(value, (F.col("_below") / total).alias(out))
    return queries.join(steps, value, "left")


def top_count(n: Column, fraction: float = TOP_FRACTION) -> Column:
    """Size of the top set: the rounded fraction (half to even), at least 1."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(fraction)) * n).cast("long"))


def top_flag(
    df: DataFrame, value: str, fraction: float = TOP_FRACTION, within: Sequence[str] = (), out: str = "is_top"
) -> DataFrame:
    """Flag the rows in the top fraction of their group, ties in id order."""
    placed = ordinal(df, [F.desc(value), F.asc(ENTITY)], within, "_place")
    sizes = with_total(placed.withColumn("_one", F.lit(1)), "_one", within, "_size")
    return sizes.withColumn(out, F.col("_place") < top_count(F.col("_size"), fraction)).drop("_place", "_one", "_size")


def top_overlap(
    df: DataFrame, x: str, y: str, fraction: float = TOP_FRACTION, within: Sequence[str] = ()
) -> DataFrame:
    """``within, n, n_top, n_both, n_either, jaccard`` of the top sets by two scores."""
    flags = top_flag(top_flag(df, x, fraction, within, "_tx"), y, fraction, within, "_ty")
    both, either = F.col("_tx") & F.col("_ty"), F.col("_tx") | F.col("_ty")
    counted = flags.groupBy(*within).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_tx").alias("n_top"),
        F.count_if(both).alias("n_both"),
        F.count_if(either).alias("n_either"),
    )
    return counted.withColumn("jaccard", F.coalesce(F.try_divide("n_both", "n_either"), F.lit(0.0)))


def novelty_scores(distances: DataFrame, ident: str = ENTITY) -> DataFrame:
    """Add ``novelty``: the mean of the 0..1 ranks of mean and k-th neighbor distance."""
    ranked = rank01(settle(distances), "knn_mean_dist", ident, "_mean")
    ranked = rank01(ranked, "knn_kth_dist", ident, "_kth")
    return ranked.withColumn("novelty", 0.5 * F.col("_mean") + 0.5 * F.col("_kth")).drop("_mean", "_kth")
