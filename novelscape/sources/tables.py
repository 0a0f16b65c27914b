"""Tables, vectors, audits: reading and writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str, ident: str = "entity_id", column: str = "embedding") -> DataFrame:
    """``entity_id, embedding array<float>``."""
    table = spark.read.parquet(path)
    return table.select(F.col(ident).alias("entity_id"), F.col(column).cast("array<float>").alias("embedding"))


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """An earlier audit, or None if it is missing or holds no readable record."""
    try:
        audit = spark.read.option("mode", "DROPMALFORMED").json(path)
        return None if not audit.columns or audit.isEmpty() else audit
    except AnalysisException:
        return None


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays of strings are joined by ``;``."""
    flat = [
        F.array_join(c, ";").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add the rows of one sweep cell to the results so far."""
    df.write.mode("append").parquet(path)


def cache_input(tokens: DataFrame, path: str, run_id: str) -> None:
    """Keep the normalized input of a scoring run, one partition per run."""
    tokens.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
