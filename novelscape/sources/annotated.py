"""Annotated-region JSON files of genome annotation tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.functions import records as R
from novelscape.functions.classes import product_class
from novelscape.functions.text import PREDICTED_LENGTH, clean_id
from novelscape.sources.records import parsed, read_documents


# Sequences and all other fields of a record are skipped.
REGION_FIELDS = "records array<struct<name variant, id variant, areas variant, regions variant>>"


def region_records(documents: DataFrame) -> DataFrame:
    """``path, records, broken``; entries that are no objects hold no regions."""
    found = parsed(documents, REGION_FIELDS)
    # A list with odd entries has no struct type; its entries are read one by one.
    mixed = F.from_json("content", "records array<variant>")["records"]
    fields = lambda x: F.struct(*[F.try_variant_get(x, f"$.{c}", "variant").alias(c) for c in ("name", "id", "areas", "regions")])
    records = F.coalesce("record.records", F.transform(mixed, fields))
    return found.select("path", records.alias("records"), (F.col("broken") & records.isNull()).alias("broken"))


def region_rejects(documents: DataFrame) -> DataFrame:
    """Documents of which no record can be read."""
    return region_records(documents).where("broken").select("path")


def region_rows(documents: DataFrame) -> DataFrame:
    """``path, bgc_id, products, genes``: one row per area of each record."""
    # The outer form spares a second evaluation of the array by an inferred filter.
    records = region_records(documents).select(
        "path", F.posexplode_outer("records").alias("_no", "_rec")
    ).where("_rec is not null")
    rec = F.col("_rec")
    name = F.coalesce(
        *[F.when(c != "", c) for c in (R.text(rec["name"]), R.text(rec["id"]))],
        F.concat(F.lit("record"), F.col("_no").cast("string")),
    )
    areas = R.items(rec["areas"], "$")
    areas = F.when(F.size(areas) > 0, areas).otherwise(R.items(rec["regions"], "$"))
    rows = records.select("path", name.alias("_name"), F.posexplode_outer(areas).alias("_at", "_area")).where(
        "_area is not null"
    )
    area = F.col("_area")
    genes = R.items(area, "$.cds")
    genes = F.when(F.size(genes) > 0, genes).otherwise(R.items(area, "$.orfs"))
    return rows.select(
        "path",
        clean_id(F.concat("_name", F.lit("_r"), (F.col("_at") + 1).cast("string"))).alias("bgc_id"),
        R.names(area, "$.products").alias("products"),
        genes.alias("genes"),
    )


def predicted_tokens(documents: DataFrame, genome: str | None = None) -> DataFrame:
    """The six-column token table: gene tokens, else products, else one ``unknown``."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    regions = region_rows(documents).withColumn("_tokens", F.flatten(F.transform("genes", R.gene_tokens)))
    tokens = F.col("_tokens")
    plain = F.when(F.size("products") > 0, F.col("products")).otherwise(F.array(F.lit("unknown")))
    chosen = regions.select(
        (F.lit(genome) if genome is not None else stem).alias("genome"),
        "bgc_id",
        product_class(F.col("products")).alias("predicted_class"),
        F.when(F.size(tokens) > 0, F.struct(tokens.alias("tokens"), F.size("genes").alias("n")))
        .otherwise(F.struct(plain.alias("tokens"), F.size(plain).alias("n")))
        .alias("_found"),
    )
    return chosen.select(
        "genome",
        "bgc_id",
        "predicted_class",
        F.greatest(F.col("_found.n"), F.lit(1)).alias("n_genes"),
        F.posexplode_outer("_found.tokens").alias("_at", "_token"),
    ).select(
        "genome",
        "bgc_id",
        "predicted_class",
        (F.col("_at") + 1).alias("gene_order"),
        F.left("_token", F.lit(PREDICTED_LENGTH)).alias("domain_id"),
        "n_genes",
    )


def read_regions(spark: SparkSession, paths: str | list[str], genome: str | None = None) -> DataFrame:
    return predicted_tokens(read_documents(spark, paths), genome)
