"""Audit of a novelty ranking: label leaks, size outliers, neighbors, size confound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.functions.text import leaks_class
from novelscape.operators.features import Vocabulary
from novelscape.operators.groups import group_stats, high_share, threshold
from novelscape.operators.ranks import spearman
from novelscape.plans.report import beside, records
from novelscape.session import settle

TOP_ROWS = 50
MAX_SIZE_OUTLIERS = 25


def leaking_features(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where(leaks_class(F.col("feature"))).select("feature")


def size_outliers(scores: DataFrame, sizes: DataFrame, size: str = "n_genes", top: int = TOP_ROWS) -> DataFrame:
    """One row ``n_outliers``: of the first ranks, those larger than the 99 % quantile of size."""
    limit = threshold(sizes, size, 0.99)
    return scores.orderBy("rank").limit(top).agg(F.count_if(F.col(size) > limit).alias("n_outliers"))


def same_class_rate(scores: DataFrame, label: str = "biosynth_class") -> DataFrame:
    """One row ``rate``: how often a top-decile entity and its nearest neighbor share the class."""
    high = high_share(scores, "novelty").where("is_high")
    same = F.coalesce((F.col(label) == F.col("neighbor_class")).cast("double"), F.lit(0.0))
    return high.agg(F.avg(same).alias("rate"))


def validate(scores: DataFrame, entities: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The audit as one row; it passes without leaks and with fewer than 25 size outliers."""
    scores = settle(scores)
    spark = scores.sparkSession
    leaks = leaking_features(vocabulary.frame(spark)).agg(
        F.array_sort(F.collect_list("feature")).alias("forbidden_features")
    )
    audit = beside(
        scores.agg(F.count(F.lit(1)).alias("n_entities")),
        leaks.withColumn("class_label_leak", F.size("forbidden_features") > 0),
        size_outliers(scores, entities).withColumnRenamed("n_outliers", "top50_size_outliers"),
        same_class_rate(scores).withColumnRenamed("rate", "top_decile_same_class_neighbor_rate"),
        spearman(scores, "novelty", "n_genes").select(F.col("rho").alias("novelty_size_spearman")),
        records(group_stats(scores, "novelty", "biosynth_class"), "biosynth_class", "novelty_by_class"),
    )
    passed = ~F.col("class_label_leak") & (F.col("top50_size_outliers") < MAX_SIZE_OUTLIERS)
    return audit.withColumn("checks_passed", passed)
