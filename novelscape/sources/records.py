"""Cluster-record JSON files: one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.functions import records as R
from novelscape.functions.classes import coarsen_classes
from novelscape.functions.text import accession
from novelscape.operators.tokens import first_rows

RECORD_FILE = r"BGC[^/]*\.json$"
RECORD_FIELDS = ", ".join(f"{name} variant" for name in R.FIELDS)


def read_documents(spark: SparkSession, paths: str | list[str], name: str = r"\.json$") -> DataFrame:
    """``path, content`` of the files whose path matches ``name``."""
    spark_reader = spark.read.option("recursiveFileLookup", True)
    whole = spark_reader.text(paths, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(
        F.col("path").rlike(name)
    )


def parsed(documents: DataFrame, fields: str) -> DataFrame:
    """``path`` and the wanted ``fields`` of each document as ``record``; ``broken`` is null if it is a JSON object.

    Fields that are not wanted are skipped and may be of any size.
    """
    record = F.from_json("content", f"{fields}, broken string", {"columnNameOfCorruptRecord": "broken"})
    whole = documents.select("path", "content", record.alias("record"))
    odd = ~F.col("content").rlike(r"\A\s*\{")
    return whole.select("path", "content", "record", F.when(F.col("record.broken").isNotNull() | odd, True).alias("broken"))


def rejects(documents: DataFrame) -> DataFrame:
    """Documents that are no JSON objects."""
    return parsed(documents, RECORD_FIELDS).where("broken").select("path")


def record_rows(documents: DataFrame) -> DataFrame:
    """One metadata row per readable document."""
    rows = parsed(documents, RECORD_FIELDS).where("broken is null")
    record = F.col("record")
    stem = F.substring_index(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), ".", 1)
    stated = R.text(record["accession"])
    empty = F.lit("")
    staged = rows.select(
        accession(F.coalesce(F.when(stated != "", stated), stem)).alias("entity_id"),
        R.class_names(record).alias("classes"),
        R.organism(record).alias("organism"),
        R.tax_id(record).alias("ncbi_tax_id"),
        R.compound_names(record).alias("names"),
        R.gene_count(record).alias("n_genes_json"),
        F.coalesce(R.text(record["status"]), empty).alias("status"),
        F.coalesce(R.text(record["completeness"]), empty).alias("completeness"),
        F.coalesce(R.text(record["quality"]), empty).alias("quality"),
        R.change_dates(record).alias("dates"),
        F.col("path").alias("json_path"),
    )
    return staged.select(
        "entity_id",
        F.col("classes").alias("biosynth_classes_raw"),
        coarsen_classes(F.col("classes")).alias("biosynth_class"),
        "organism",
        "ncbi_tax_id",
        F.size("names").alias("n_compounds"),
        F.slice("names", 1, R.MAX_COMPOUNDS).alias("compounds"),
        "n_genes_json",
        "status",
        "completeness",
        "quality",
        F.get("dates", 0).alias("date_added"),
        F.try_element_at("dates", F.lit(-1)).alias("date_latest"),
        "json_path",
    )


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Metadata of all cluster-record files, the first in path order per id."""
    rows = record_rows(read_documents(spark, paths, RECORD_FILE))
    return first_rows(rows, "entity_id", ["json_path"])
