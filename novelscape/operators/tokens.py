"""Ordered tokens of entities: order, counts, document frequency, hashed grams.

A token table has ``entity_id, gene_order, token_pos, token`` where
``(gene_order, token_pos)`` orders the tokens of an entity uniquely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelscape.config import HASH_WIDTH, MIN_ENTITIES_PER_TOKEN
from novelscape.functions.hashing import bigram_bucket, unigram_bucket
from novelscape.operators.ordering import running, sequence

ENTITY = "entity_id"
TOKEN = "token"
NEXT = "next_token"


def present(tokens: DataFrame, entity: str = ENTITY, token: str = TOKEN) -> DataFrame:
    """Drop rows without an entity or without a token."""
    return tokens.where(F.col(entity).isNotNull() & (F.length(F.col(token).cast("string")) > 0))


def ordered_tokens(
    tokens: DataFrame,
    order_by: Sequence[str] = ("gene_order", "token_pos"),
    entity: str = ENTITY,
    token: str = TOKEN,
) -> DataFrame:
    """``entity, pos, token, next_token``: dense positions and the token that follows."""
    rows = present(tokens, entity, token).select(entity, *order_by, token)
    return sequence(rows, [entity], list(order_by), "pos", {NEXT: token}, often_small=True).select(entity, "pos", token, NEXT)


def token_counts(tokens: DataFrame, entity: str = ENTITY, token: str = TOKEN) -> DataFrame:
    return present(tokens, entity, token).groupBy(entity, token).agg(F.count(F.lit(1)).alias("n"))


def distinct_tokens(lists: DataFrame, entity: str = ENTITY, tokens: str = "tokens", token: str = TOKEN) -> DataFrame:
    """``entity, token``: each token of an entity once; ``lists`` has the tokens of a row as an array.

    Entities in one row each need no shuffle; that is found by a count of their ids.  Else all rows are grouped.
    """
    known = lists.where(F.col(entity).isNotNull())
    rows = known.select(entity, F.explode(F.array_distinct(tokens)).alias(token))
    rows = rows.where(F.length(F.col(token).cast("string")) > 0)
    once = known.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return rows if once else rows.distinct()


def document_frequency(counts: DataFrame, token: str = TOKEN, at_least: int = 1) -> DataFrame:
    """Number of entities per token; ``counts`` holds one row per entity and token."""
    return counts.groupBy(token).agg(F.count(F.lit(1)).alias("n_entities")).where(F.col("n_entities") >= at_least)


def frequent_tokens(counts: DataFrame, at_least: int = MIN_ENTITIES_PER_TOKEN) -> DataFrame:
    return document_frequency(counts, at_least=at_least)


def document_share(counts: DataFrame, entity: str = ENTITY, token: str = TOKEN) -> DataFrame:
    """Document frequency and its share of all entities that have tokens."""
    total = counts.select(F.countDistinct(entity)).scalar()
    return document_frequency(counts, token).withColumn("share", F.col("n_entities") / total)


def token_pivot(
    counts: DataFrame, entities: DataFrame, columns: Sequence[str], entity: str = ENTITY, token: str = TOKEN
) -> DataFrame:
    """One column per listed token, 0 where an entity lacks it; keeps entities without tokens.

    ``counts`` may hold several rows for one entity and token.  One aggregation of all rows by entity, without a join of
    wide rows, which would be sorted besides.
    """
    listed = counts.where(F.col(token).isin(list(columns))).select(entity, token, F.col("n").cast("long"), F.lit(0).alias("_known"))
    asked = entities.select(entity, F.lit(None).cast(counts.schema[token].dataType), F.lit(None).cast("long"), F.lit(1))
    sums = [F.coalesce(F.sum(F.when(F.col(token) == c, F.col("n"))), F.lit(0)).alias(c) for c in columns]
    wide = listed.unionAll(asked).groupBy(entity).agg(F.max("_known").alias("_known"), *sums)
    return wide.where("_known = 1").select(entity, *columns)


def gram_buckets(ordered: DataFrame, width: int = HASH_WIDTH, token: str = TOKEN) -> DataFrame:
    """One row per unigram and bigram: the entity columns, ``gram`` and ``bucket``."""
    tok, nxt = F.col(token), F.col(NEXT)
    one = F.struct(F.lit("uni").alias("gram"), unigram_bucket(tok, width).alias("bucket"))
    two = F.struct(F.lit("bi").alias("gram"), bigram_bucket(tok, nxt, width).alias("bucket"))
    grams = F.when(nxt.isNull(), F.array(one)).otherwise(F.array(one, two))
    keep = [c for c in ordered.columns if c not in (token, NEXT, "pos")]
    return ordered.select(*keep, F.inline(grams))


def hashed_counts(ordered: DataFrame, width: int = HASH_WIDTH, entity: str = ENTITY) -> DataFrame:
    """Hashed unigram and bigram counts per entity and bucket."""
    return gram_buckets(ordered, width).groupBy(entity, "bucket").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(ordered: DataFrame, token: str = TOKEN) -> DataFrame:
    return ordered.where(F.col(NEXT).isNotNull()).groupBy(token, NEXT).agg(F.count(F.lit(1)).alias("n"))


def running_flag(
    rows: DataFrame, flag: Column, within: str, order_by: Sequence[str], out: str = "gene_order"
) -> DataFrame:
    """How many flagged rows an entity has up to and including each row."""
    flagged = rows.withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0).cast("long")))
    counted = running(flagged, list(order_by), "_flag", [within], "_earlier", often_small=True)
    return counted.withColumn(out, F.col("_earlier") + F.col("_flag")).drop("_earlier", "_flag")


def top_per_group(
    df: DataFrame, within: str, order_by: Sequence[Column | str], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark prunes each input task to ``n`` rows per group before the shuffle
    (WindowGroupLimit), so a large group sends few rows.
    """
    place = rank or "_place"
    window = Window.partitionBy(within).orderBy(*order_by)
    kept = df.withColumn(place, F.row_number().over(window)).where(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def first_rows(df: DataFrame, key: str, order_by: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order."""
    return top_per_group(df, key, order_by, 1)


def distinct_list(counts: DataFrame, n: int, entity: str = ENTITY, token: str = TOKEN) -> DataFrame:
    """``entity, token_list``: its first ``n`` distinct tokens in order; groups are cut to n before."""
    firsts = top_per_group(counts.select(entity, token), entity, [token], n)
    return firsts.groupBy(entity).agg(F.array_sort(F.collect_list(token)).alias("token_list"))
