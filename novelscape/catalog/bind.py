"""Bindings of entities, tokens, classes and vectors to the tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# Baskets: an order is an entity, its lines are the ordered tokens.
BASKET_ORDER = ("gene_order", "l_partkey", "l_suppkey")
BASKET = """
basket AS (
  SELECT l_orderkey AS entity_id, l_linenumber AS gene_order, l_partkey, l_suppkey, l_quantity,
         p_type AS token, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def basket(spark: SparkSession, folder: str, token: str = "p_type") -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, folder, "part").select("p_partkey", token)
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select(
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_linenumber").alias("gene_order"),
        "l_partkey",
        "l_suppkey",
        F.struct("l_partkey", "l_suppkey").alias("token_pos"),
        F.col(token).alias("token"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as entities with class, date and sizes; those without lines have null sizes."""
    sizes = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("entity_id"))
        .agg(
            F.count(F.lit(1)).alias("n_genes"),
            F.sum("l_quantity").cast("long").alias("total_aa_length"),
            F.avg("l_quantity").alias("mean_aa_length"),
        )
    )
    heads = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("entity_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("biosynth_class"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_added"),
        F.col("o_orderstatus").alias("status"),
    )
    return heads.join(sizes, "entity_id", "left").withColumn("n_domain_annotations", F.col("n_genes"))


# Activity: a user is an entity, events by time are the tokens.
def activity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("gene_order"),
        F.col("event_id").alias("token_pos"),
        F.col("event_type").alias("token"),
    )


# Vectors.
VECTORS = "v AS (SELECT vec_id AS entity_id, label, embedding::DOUBLE[] AS z FROM embeddings)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("entity_id"),
        F.col("embedding").cast("array<double>").alias("z"),
        F.col("label").cast("string").alias("biosynth_class"),
    )


def loo_sql(source: str, z: str = "z", out: str = "s", k: int = 5) -> str:
    """Leave-one-out neighbor distances of ``source`` as SQL."""
    return f"""
{out}_pairs AS (
  SELECT a.entity_id, b.entity_id AS other, list_distance(a.{z}, b.{z}) AS d
  FROM {source} a JOIN {source} b ON a.entity_id <> b.entity_id
),
{out}_near AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, other) AS rn FROM {out}_pairs
),
{out}_dist AS (
  SELECT entity_id, avg(d) AS knn_mean_dist, max(d) AS knn_kth_dist, min(d) AS nearest_dist,
         min(CASE WHEN rn = 1 THEN other END) AS nearest_id
  FROM {out}_near WHERE rn <= {k} GROUP BY entity_id
),
{out} AS (
  SELECT *,
    0.5 * (row_number() OVER (ORDER BY knn_mean_dist, entity_id) - 1) / (count(*) OVER () - 1)
    + 0.5 * (row_number() OVER (ORDER BY knn_kth_dist, entity_id) - 1) / (count(*) OVER () - 1) AS novelty
  FROM {out}_dist
)"""


# Documents: words are tokens, quality is the class.
WORDS = r"""
words AS (
  SELECT doc_id AS entity_id, pos, word AS token FROM (
    SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word,
           generate_subscripts(string_split_regex(lower(text), '\s+'), 1) AS pos
    FROM documents) WHERE word <> ''
)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumnRenamed("doc_id", "entity_id")


def words(spark: SparkSession, folder: str) -> DataFrame:
    split = F.split(F.lower("text"), r"\s+")
    return (
        documents(spark, folder)
        .select("entity_id", F.posexplode_outer(split).alias("pos", "token"))
        .where("token <> ''")
        .select("entity_id", (F.col("pos") + 1).alias("gene_order"), F.lit(0).alias("token_pos"), "token")
    )


def word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each row of ``documents`` as an array."""
    return documents(spark, folder).select("entity_id", F.split(F.lower("text"), r"\s+").alias("tokens"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("entity_id"), "quality", "toxic")
    return documents(spark, folder).drop("text").join(labels, "entity_id")


DOCUMENTS = "d AS (SELECT doc_id AS entity_id, lang, source, n_chars FROM documents)"
LABELLED = "d AS (SELECT doc_id AS entity_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for the output of a query: shared on a cluster, temporary on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        stamp = spark.range(1).select(F.uuid()).first()[0]
        return f"{shared.rstrip('/')}/{name}-{stamp}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"novelscape-{name}-")
