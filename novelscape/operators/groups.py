"""Statistics of groups: class summaries, shares, contingency, effect sizes, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.functions.tails import Z_975
from novelscape.operators.ordering import quantiles
from novelscape.operators.ranks import rank_sum


def value_counts(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def group_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """``by, count, mean, median, std`` (sample standard deviation); null groups and values are dropped."""
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    moments = rows.groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    middle = quantiles(rows, value, {"median": 0.5}, [by])
    return moments.join(middle, by).select(by, "count", "mean", "median", "std")


def threshold(df: DataFrame, value: str, p: float) -> Column:
    """An exact quantile as a scalar of the query."""
    return quantiles(df, value, {"_q": p}).select("_q").scalar()


def high_share(df: DataFrame, value: str, p: float = 0.9) -> DataFrame:
    """Flag rows at or above the p-quantile as ``is_high``."""
    return df.withColumn("is_high", F.col(value) >= threshold(df, value, p))


def frame_limits(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, pad: float = 0.15):
    """One row with robust limits per column and ``n_outside``, the rows beyond any of them."""
    limits = None
    for c in columns:
        edges = quantiles(df, c, {"_lo": low, "_hi": high})
        span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
        row = edges.select(
            (F.col("_lo") - pad * span).alias(f"{c}_low"), (F.col("_hi") + pad * span).alias(f"{c}_high")
        ).withColumn("_one", F.lit(1))
        limits = row if limits is None else limits.join(row, "_one")
    beyond = F.lit(False)
    for c in columns:
        beyond = beyond | (F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))
    # The limits are one row.
    marked = df.withColumn("_one", F.lit(1)).join(F.broadcast(limits), "_one")
    names = [f"{c}_{side}" for c in columns for side in ("low", "high")]
    return marked.groupBy(*names).agg(F.count_if(beyond).alias("n_outside"))


def contingency(df: DataFrame, in_a: Column, in_b: Column, hit: Column) -> DataFrame:
    """One row ``a_hit, a_rest, b_hit, b_rest``."""
    return df.agg(
        F.count_if(in_a & hit).alias("a_hit"),
        F.count_if(in_a & ~hit).alias("a_rest"),
        F.count_if(in_b & hit).alias("b_hit"),
        F.count_if(in_b & ~hit).alias("b_rest"),
    )


def odds(table: DataFrame) -> DataFrame:
    """Add ``odds_ratio, ci_low, ci_high, enrichment_ratio`` to a contingency row.

    Half a count is added to all cells if one is empty; the interval is Woolf's; the
    ratio of the hit shares is null if it is undefined.
    """
    cells = [F.col(c).cast("double") for c in ("a_hit", "a_rest", "b_hit", "b_rest")]
    extra = F.when(F.least(*cells) == 0, 0.5).otherwise(0.0)
    a, b, c, d = (x + extra for x in cells)
    ratio = (a / b) / (c / d)
    error = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    share_a = F.try_divide(cells[0], cells[0] + cells[1])
    share_b = F.try_divide(cells[2], cells[2] + cells[3])
    return table.select(
        "*",
        ratio.alias("odds_ratio"),
        F.exp(F.log(ratio) - Z_975 * error).alias("ci_low"),
        F.exp(F.log(ratio) + Z_975 * error).alias("ci_high"),
        F.try_divide(share_a, share_b).alias("enrichment_ratio"),
    )


def cohens_d(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """One row ``n_a, n_b, cohens_d`` with pooled sample variances; 0 without spread."""

    def side(flag: Column, suffix: str) -> list[Column]:
        x = F.when(flag, F.col(value))
        return [
            F.count(x).alias(f"n_{suffix}"),
            F.avg(x).alias(f"_m{suffix}"),
            F.var_samp(x).alias(f"_v{suffix}"),
        ]

    sums = df.agg(*side(in_a, "a"), *side(in_b, "b"))
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb"), (na + nb - 2).cast("double")))
    d = F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / pooled).otherwise(0.0)
    return sums.select("n_a", "n_b", d.alias("cohens_d"))


def enrichment(df: DataFrame, by: str, hit: Column, min_hits: int = 3, min_rows: int = 5, limit: int = 12) -> DataFrame:
    """The groups with the largest share among hits relative to their share overall."""
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count_if(hit).alias("n_top"), F.count(F.lit(1)).alias("n_total")
    )
    hits = counts.select(F.sum("n_top")).scalar()
    rows = counts.select(F.sum("n_total")).scalar()
    ratio = (F.col("n_top") / hits) / (F.col("n_total") / rows)
    kept = counts.where((F.col("n_top") >= min_hits) & (F.col("n_total") >= min_rows))
    return kept.select(by, "n_top", "n_total", ratio.alias("enrichment")).orderBy(
        F.desc("enrichment"), F.desc("n_top"), by
    ).limit(limit)


def two_group_tests(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """Effect sizes of one comparison as one row."""
    ranks = rank_sum(df, value, in_a, in_b).withColumn("_one", F.lit(1))
    effect = cohens_d(df, value, in_a, in_b).select("cohens_d", F.lit(1).alias("_one"))
    return ranks.join(effect, "_one").drop("_one")
