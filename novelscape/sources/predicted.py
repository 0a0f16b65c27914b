"""Predicted token tables from CSV, annotated-region JSON or GenBank files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.sources import annotated, genbank

COLUMNS = ("genome", "bgc_id", "predicted_class", "gene_order", "domain_id", "n_genes")
_TYPES = {"gene_order": "int", "n_genes": "int"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The six columns of a CSV with header and its order as ``token_pos``; other columns are dropped, missing ones are an error."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"token table lacks the columns {missing}; it needs {list(COLUMNS)}")
    # Ties of gene_order keep the order of the file.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return raw.select(*[F.col(c).try_cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS], place.alias("token_pos"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select("path")


def _has(files: DataFrame, pattern: str) -> bool:
    return not files.where(F.col("path").rlike(pattern)).isEmpty()


def read_genbank(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """All records of a file or folder; region files, if there are any, replace the others."""
    records = genbank.read_records(spark, path, (".gbk", ".gbff"))
    if _has(_files(spark, path), genbank.REGION_FILE):
        records = records.where(F.col("path").rlike(genbank.REGION_FILE))
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem else stem
    return genbank.predicted_tokens(records, genome or stem)


def load_predicted(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """Dispatch by suffix; in a folder GenBank files come before JSON files.  No rows at all are an error."""
    tokens = _load(spark, path, genome)
    if tokens.isEmpty():
        raise ValueError(f"no regions could be read from {path}")
    return tokens


def _load(spark: SparkSession, path: str, genome: str | None) -> DataFrame:
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return read_csv(spark, path)
    if lowered.endswith(".json"):
        return annotated.read_regions(spark, path, genome)
    if lowered.endswith((".gbk", ".gbff")):
        return read_genbank(spark, path, genome)
    files = _files(spark, path)
    if _has(files, r"(?i)\.(gbk|gbff)$"):
        return read_genbank(spark, path, genome)
    if _has(files, r"\.json$"):
        return annotated.read_regions(spark, path, genome)
    raise FileNotFoundError(f"no GenBank or JSON files under {path}")
