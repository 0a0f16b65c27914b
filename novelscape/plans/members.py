"""Members of entities: cleaning, caps and pooling of their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.config import MAX_MEMBER_LENGTH, MAX_MEMBERS, MIN_MEMBER_LENGTH, POOLING
from novelscape.functions.text import clean_sequence, cut_sequence, number_or
from novelscape.operators.tokens import ENTITY, top_per_group
from novelscape.operators.vectors import pool_members


def prepare_members(
    members: DataFrame,
    max_aa: int = MAX_MEMBER_LENGTH,
    max_members: int = MAX_MEMBERS,
    min_aa: int = MIN_MEMBER_LENGTH,
    ident: str = "member_id",
) -> DataFrame:
    """Clean sequences, drop short ones, cut long ones, keep the longest members per entity.

    Within each partition the longest sequences come first, which helps batching.
    """
    cleaned = members.withColumn("sequence", clean_sequence(F.col("sequence"))).where(F.length("sequence") >= min_aa)
    length = number_or(F.col("aa_length")).cast("int") if "aa_length" in members.columns else F.length("sequence")
    sized = cleaned.withColumn("aa_length", length).withColumn("sequence", cut_sequence(F.col("sequence"), max_aa))
    kept = top_per_group(sized, ENTITY, [F.desc("aa_length"), F.asc(ident)], max_members)
    return kept.sortWithinPartitions(F.desc(F.length("sequence")))


def repool(cache: DataFrame, pooling: str = POOLING, expected: int | None = None) -> DataFrame:
    """Pool cached member vectors again; the cache must be complete."""
    bad = F.col("embedding").isNull()
    check = cache.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad")).first()
    if check["n_bad"] or (expected is not None and check["n"] != expected):
        raise ValueError(f"member cache has {check['n']} rows, {check['n_bad']} without a vector; expected {expected}")
    return pool_members(cache, pooling)
