"""Curation: cluster records and GenBank files into entity, token and member tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.functions.classes import OTHER
from novelscape.operators.tokens import first_rows
from novelscape.session import settle
from novelscape.sources import genbank, records


def merge_entities(meta: DataFrame, summary: DataFrame) -> DataFrame:
    """Full outer join; the gene count comes from the sequence side, else the record, else 0."""
    joined = meta.join(summary, "entity_id", "full_outer")
    stated = F.col("n_genes_json") if "n_genes_json" in joined.columns else F.lit(None).cast("int")
    return (
        joined.withColumn("biosynth_class", F.coalesce("biosynth_class", F.lit(OTHER)))
        .withColumn("organism", F.coalesce("organism", F.lit("unknown")))
        .withColumn("n_genes", F.coalesce(F.col("n_genes"), stated, F.lit(0)).cast("long"))
    )


def curate(spark: SparkSession, json_path: str, gbk_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entities, tokens, members)``; of files with the same id the first in path order counts."""
    meta = records.read_records(spark, json_path)
    summary, tokens, members = genbank.curated_tables(settle(genbank.read_records(spark, gbk_path)))
    first = first_rows(summary, "entity_id", ["gbk_path"])
    return merge_entities(meta, first), tokens, members
