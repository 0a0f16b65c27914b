"""Novelty: ranking within a table, and scoring new entities against a frozen reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.config import HASH_WIDTH, NEIGHBORS, PCA_COMPONENTS
from novelscape.operators.features import Vocabulary, cells_of, predicted_sizes, vectorize
from novelscape.operators.neighbors import against_reference, collapse, leave_one_out
from novelscape.operators.ranks import novelty_scores, rank_from_top, strict_percentile
from novelscape.operators.tokens import ENTITY
from novelscape.operators.vectors import Projection
from novelscape.session import drop, fresh_path, settle


def score_novelty(embedding: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """Leave-one-out neighbor distances and ``novelty`` of ``(entity_id, z)``."""
    return novelty_scores(leave_one_out(embedding, k))


def with_neighbor(scores: DataFrame, entities: DataFrame, attributes: tuple[str, ...] = ("biosynth_class",)) -> DataFrame:
    """Add attributes of the nearest entity as ``neighbor_<name>``; the class is ``neighbor_class``."""
    names = {a: "neighbor_class" if a == "biosynth_class" else f"neighbor_{a}" for a in attributes}
    side = entities.select(F.col(ENTITY).alias("nearest_id"), *[F.col(a).alias(n) for a, n in names.items()])
    return scores.join(side, "nearest_id", "left")


def rank_novelty(embedding: DataFrame, entities: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """Entities with their scores, nearest neighbor, its class and the rank by novelty."""
    scored = settle(score_novelty(embedding, k))
    joined = with_neighbor(entities.join(scored, ENTITY), entities)
    return rank_from_top(joined, "novelty")


def embed_scores(vectors: DataFrame, k: int = NEIGHBORS, center: bool = False, components: int = PCA_COMPONENTS):
    """Novelty of any representation: scale, PCA, leave-one-out neighbors."""
    vectors = settle(vectors)
    return score_novelty(Projection.fit(vectors, components, center).transform(vectors), k)


@dataclass(frozen=True)
class Reference:
    """A fitted reference: projection, distinct embedded points and the counts of the entities' own distances.

    What scoring needs is worked out once, and can be kept: ``save`` and ``load``.
    """

    projection: Projection
    points: DataFrame
    distances: DataFrame
    k: int
    vocabulary: Vocabulary | None = None

    @staticmethod
    def fit(
        vectors: DataFrame,
        k: int = NEIGHBORS,
        components: int = PCA_COMPONENTS,
        vocabulary: Vocabulary | None = None,
    ) -> Reference:
        projection = Projection.fit(vectors, components)
        collapsed = collapse(projection.transform(vectors))
        distances = leave_one_out(vectors, k, collapsed).groupBy("knn_mean_dist").agg(F.count(F.lit(1)).alias("n"))
        points = collapsed.points.select("point", "z", "last", "copies")
        return Reference(projection, points, settle(distances), k, vocabulary)

    def save(self, path: str) -> None:
        """Write the reference as a folder of tables and a model, replacing what is there."""
        spark = self.points.sparkSession
        self.projection.save(spark, f"{path}/projection")
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        self.distances.write.mode("overwrite").parquet(f"{path}/distances")
        size = len(self.vocabulary) if self.vocabulary else None
        if self.vocabulary:
            self.vocabulary.frame(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([(self.k, size)], "k int, columns int").write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reference:
        row = spark.read.parquet(f"{path}/settings").first()
        known = row["columns"] is not None
        vocabulary = Vocabulary(table=spark.read.parquet(f"{path}/vocabulary"), size=row["columns"]) if known else None
        tables = (spark.read.parquet(f"{path}/{name}") for name in ("points", "distances"))
        return Reference(Projection.load(spark, f"{path}/projection"), *tables, row["k"], vocabulary)

    def score(self, vectors: DataFrame) -> DataFrame:
        """Neighbor distances of new entities and ``novelty``, their strict percentile in the reference."""
        queries = self.projection.transform(vectors)
        found = settle(against_reference(queries, self.points, self.k, self.points))
        return strict_percentile(found, self.distances, weight="n")


def predicted_entities(tokens: DataFrame) -> DataFrame:
    """Entities of a predicted token table: genes, tokens and assumed sizes.

    The key is (genome, bgc_id, predicted_class); ``entity_id`` joins its parts.
    """
    grouped = tokens.groupBy("genome", "bgc_id", "predicted_class").agg(
        F.min_by("n_genes", F.struct("gene_order", "n_genes")).alias("n_genes"),
        F.count("domain_id").alias("n_domain_annotations"),
    )
    sizes = predicted_sizes(F.col("n_genes"), F.col("n_domain_annotations"))
    return grouped.select(
        predicted_id().alias(ENTITY),
        "genome",
        "bgc_id",
        "predicted_class",
        *[c.alias(name) for name, c in sizes.items()],
    )


def predicted_id():
    return F.concat_ws("|", "genome", "bgc_id", "predicted_class")


def vectorize_predicted(tokens: DataFrame, vocabulary: Vocabulary, n_hash: int = HASH_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Predicted entities and their vectors over the reference vocabulary."""
    keyed = tokens.where(
        F.col("genome").isNotNull() & F.col("bgc_id").isNotNull() & F.col("predicted_class").isNotNull()
    )
    entities = predicted_entities(keyed)
    position = F.col("token_pos") if "token_pos" in tokens.columns else F.xxhash64("domain_id")
    rows = keyed.select(
        predicted_id().alias(ENTITY), "gene_order", position.alias("token_pos"), F.col("domain_id").alias("token")
    )
    folder = fresh_path(tokens.sparkSession)
    cells, _ = cells_of(entities, rows, n_hash, folder)
    vectors = vectorize(cells, vocabulary)
    drop(tokens.sparkSession, folder)
    return entities, vectors


def apply_reference(
    reference: Reference, tokens: DataFrame, entities: DataFrame, source: str = "", n_hash: int = HASH_WIDTH, ranked: bool = True
) -> DataFrame:
    """Ranking of predicted entities; ``entities`` are those of the reference."""
    predicted, vectors = vectorize_predicted(tokens, reference.vocabulary, n_hash)
    scored = with_neighbor(predicted.join(reference.score(vectors), ENTITY), entities)
    ranked = rank_from_top(scored, "novelty") if ranked else scored
    return ranked.select(
        *["rank"] * ("rank" in ranked.columns),
        "genome",
        "bgc_id",
        "predicted_class",
        "n_genes",
        "n_domain_annotations",
        "novelty",
        "knn_mean_dist",
        "nearest_dist",
        "nearest_id",
        "neighbor_class",
        F.lit(source).alias("source"),
    )
