"""Roll-up of encoder sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_learned(scores: DataFrame) -> DataFrame:
    """``run, macro_f1_learned``: the best macro F1 of a run among learned, not combined, representations."""
    learned = F.contains(F.col("representation"), F.lit("learned"))
    combined = F.contains(F.col("representation"), F.lit("combined"))
    return scores.where(learned & ~combined).groupBy("run").agg(F.max("macro_f1").alias("macro_f1_learned"))


def sweep_rows(runs: DataFrame) -> DataFrame:
    """Finished runs with ``cfg`` and ``temporal_delta``."""
    done = runs.where((F.col("status") == "ok") & F.col("macro_f1_learned").isNotNull())
    return done.withColumn("cfg", F.concat_ws("/", "objective", "pooling")).withColumn(
        "temporal_delta", F.col("temporal_heldout_mean") - F.col("temporal_control_mean")
    )


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Mean class recovery, size confound and temporal difference per configuration."""
    return sweep_rows(runs).groupBy("cfg").agg(
        F.avg("macro_f1_learned").alias("macro_f1_learned"),
        F.avg("size_confound_learned").alias("size_confound_learned"),
        F.avg("temporal_delta").alias("temporal_delta"),
        F.count(F.lit(1)).alias("n_runs"),
    )
