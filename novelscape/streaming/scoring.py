"""Scoring of predicted entities that keep arriving, against a frozen reference.

An entity's tokens may come in any number of files and batches.  They are kept as state of the entity in the stream's
state store; a batch reads and scores the entities it touched only, from all of their tokens so far, however long the
stream has run.  Readers take the latest scores of each entity.  Scores of a batch replace those that an earlier try of
the same batch wrote.

Without a ``time`` column nothing is forgotten, and the state is that of a plain aggregation.  With one, tokens may be late
by ``delay``; the watermark drops later ones.  An entity that has been silent for ``keep`` beyond that is forgotten: its
scores stay, and a token that comes after that begins the entity anew.  Its timer costs a call of Python for each entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from novelscape.operators.ranks import rank_from_top
from novelscape.operators.tokens import ENTITY
from novelscape.plans.novelty import Reference, apply_reference
from novelscape.session import stored

KEY = ("genome", "bgc_id", "predicted_class")


def remember(keep: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """All tokens of an entity so far, told again whenever more of them arrive; ``keep`` is in milliseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, until = state.get if state.exists else ([], 0)
        tokens = list(known)
        for frame in frames:
            tokens += frame["token"].tolist()
            until = max(until, int(frame["at"].max()))
        state.update((tokens, until))
        state.setTimeoutTimestamp(max(until + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**dict(zip(KEY, ([k] * len(tokens) for k in key))), "token": tokens})

    return run


def token_histories(tokens: DataFrame, time: str | None = None, delay: str = "1 day", keep: str = "30 days") -> DataFrame:
    """Every batch's touched entities with all of their tokens so far; the columns but ``time`` are those of ``tokens``."""
    spark, told = tokens.sparkSession, [c for c in tokens.columns if c not in (*KEY, time)]
    known = tokens.where(" and ".join(f"{name} is not null" for name in KEY))
    keys = [F.col(k).cast("string").alias(k) for k in KEY]
    if time is None:
        whole = known.select(*keys, F.struct(*told).alias("token")).groupBy(*KEY).agg(F.collect_list("token").alias("tokens"))
        return whole.select(*KEY, F.inline("tokens"))
    timed = known.where(F.col(time).isNotNull()).withWatermark(time, delay)
    silent = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {keep})").first()[0]
    rows = timed.select(*keys, F.to_json(F.struct(*told)).alias("token"), F.unix_millis(time).alias("at"), F.col(time).alias("time"))
    told_ = StructType([tokens.schema[c] for c in told])
    texts, state, limit = "genome string, bgc_id string, predicted_class string, token string", "tokens array<string>, until long", GroupStateTimeout.EventTimeTimeout
    found = rows.groupBy(*KEY).applyInPandasWithState(remember(silent), texts, state, "update", limit)
    return found.select(*KEY, F.inline(F.array(F.from_json("token", told_))))


def score_stream(
    tokens: DataFrame, reference: Reference, entities: DataFrame, output: str, checkpoint: str, time: str | None = None, delay: str = "1 day", keep: str = "30 days"
) -> DataStreamWriter:
    """A writer that keeps scores under ``output/scores``; see ``read_scores``.  The state lies under ``checkpoint``."""

    def score(batch: DataFrame, number: int) -> None:
        # Written first: each read of the batch itself would go through the state again.
        scored = apply_reference(reference, stored(batch), entities, source="stream", ranked=False)
        rows = scored.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("batch").parquet(f"{output}/scores")

    histories = token_histories(tokens, time, delay, keep)
    return histories.writeStream.outputMode("update").foreachBatch(score).option("checkpointLocation", checkpoint)


def read_scores(spark: SparkSession, output: str) -> DataFrame:
    """The latest scores of each entity, with their rank among all."""
    scores = spark.read.parquet(f"{output}/scores")
    latest = Window.partitionBy(*KEY).orderBy(F.desc("batch"))
    last = scores.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")
    ranked = rank_from_top(last.withColumn(ENTITY, F.concat_ws("|", *KEY)), "novelty").drop(ENTITY)
    return ranked.select("rank", *[c for c in ranked.columns if c != "rank"])
