"""Vectors: scaling, PCA, pooling, concatenation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.config import DENSE_COLUMNS, PCA_COMPONENTS, POOLING
from novelscape.operators.pca import Basis
from novelscape.operators.tokens import ENTITY


def as_vectors(df: DataFrame, column: str, out: str = "features", entity: str = ENTITY) -> DataFrame:
    """``(entity_id, features)`` from an array column."""
    return df.select(F.col(entity).alias(ENTITY), array_to_vector(F.col(column).cast("array<double>")).alias(out))


@dataclass(frozen=True)
class Scaler:
    """Divide by the population standard deviation (1 for constants), after centering if asked."""

    count: int
    mean: np.ndarray
    deviation: np.ndarray
    center: bool = False
    constant: np.ndarray | None = None

    @staticmethod
    def fit(vectors: DataFrame, center: bool = False, column: str = "features") -> Scaler:
        summary = vectors.select(
            Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")
        ).first()["s"]
        n = int(summary["count"])
        if n == 0:
            raise ValueError("no vectors to scale")
        mean = summary["mean"].toArray()
        spread = np.sqrt(np.maximum(summary["variance"].toArray(), 0.0) * (n - 1) / n)
        # A spread at rounding level belongs to a constant column.
        constant = spread <= 10 * np.finfo(float).eps * np.maximum(np.abs(mean), np.finfo(float).tiny)
        return Scaler(n, mean, np.where(constant, 1.0, spread), center, constant)

    def transform(self, vectors: DataFrame, column: str = "features", out: str | None = None) -> DataFrame:
        out = out or column
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(1.0 / self.deviation), inputCol=column, outputCol="_scaled"
        ).transform(vectors)
        if self.center:
            shift = F.lit((self.mean / self.deviation).tolist())
            moved = array_to_vector(F.zip_with(vector_to_array("_scaled"), shift, lambda a, b: a - b))
            scaled = scaled.withColumn("_scaled", moved)
        keep = [c for c in vectors.columns if c != out]
        return scaled.select(*keep, F.col("_scaled").alias(out))


@dataclass(frozen=True)
class Projection:
    """Scaling and PCA; ``transform`` gives centered coordinates as ``z array<double>``.

    Up to ``DENSE_COLUMNS`` columns Spark's PCA works out their covariance on the driver; wider vectors get a ``Basis``.
    """

    scaler: Scaler
    pca: PCAModel | Basis
    offset: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model and the scaling under ``path``, replacing what is there."""
        wide = isinstance(self.pca, Basis)
        if wide:
            self.pca.table.write.mode("overwrite").parquet(f"{path}/basis")
        else:
            self.pca.write().overwrite().save(f"{path}/pca")
        known = (list(self.pca.variances), self.pca.total) if wide else (None, None)
        row = (self.scaler.count, self.scaler.mean.tolist(), self.scaler.deviation.tolist(), self.scaler.center, self.offset.tolist(), *known)
        kinds = "count long, mean array<double>, deviation array<double>, center boolean, offset array<double>, variances array<double>, total double"
        spark.createDataFrame([row], kinds).write.mode("overwrite").parquet(f"{path}/scaling")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Projection:
        row = spark.read.parquet(f"{path}/scaling").first()
        scaler = Scaler(row["count"], np.array(row["mean"]), np.array(row["deviation"]), row["center"])
        if row["total"] is None:
            model = PCAModel.load(f"{path}/pca")
        else:
            model = Basis(spark.read.parquet(f"{path}/basis"), tuple(row["variances"]), row["total"])
        return Projection(scaler, model, np.array(row["offset"]))

    @property
    def explained(self) -> list[float]:
        if isinstance(self.pca, Basis):
            return self.pca.explained
        return [float(v) for v in self.pca.explainedVariance.toArray()]

    @staticmethod
    def fit(vectors: DataFrame, components: int = PCA_COMPONENTS, center: bool = False) -> Projection:
        scaler = Scaler.fit(vectors, center)
        k = max(1, min(components, scaler.count - 1, len(scaler.mean)))
        if len(scaler.mean) > DENSE_COLUMNS:
            basis = Basis.fit(vectors, scaler.mean, scaler.deviation, scaler.count, scaler.constant, k)
            return Projection(scaler, basis, np.zeros(len(basis.variances)))
        model = PCA(k=k, inputCol="features", outputCol="_z").fit(scaler.transform(vectors))
        middle = np.zeros_like(scaler.mean) if center else scaler.mean / scaler.deviation
        return Projection(scaler, model, middle @ model.pc.toArray())

    def transform(self, vectors: DataFrame, out: str = "z") -> DataFrame:
        if isinstance(self.pca, Basis):
            return self.pca.transform(vectors, self.scaler.mean, self.scaler.deviation, out)
        moved = F.zip_with(vector_to_array("_z"), F.lit(self.offset.tolist()), lambda a, b: a - b)
        projected = self.pca.transform(self.scaler.transform(vectors))
        keep = [c for c in vectors.columns if c != "features"]
        return projected.select(*keep, moved.alias(out))


def concatenate(left: DataFrame, right: DataFrame, center_left: bool = False, center_right: bool = True) -> DataFrame:
    """Scale two representations on their common entities and put them side by side."""
    both = left.select(ENTITY, F.col("features").alias("_l")).join(
        right.select(ENTITY, F.col("features").alias("_r")), ENTITY
    )
    for column, center in (("_l", center_left), ("_r", center_right)):
        both = Scaler.fit(both, center, column).transform(both, column)
    joined = VectorAssembler(inputCols=["_l", "_r"], outputCol="features").transform(both)
    return joined.select(ENTITY, "features")


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both representations restricted to their common entities."""
    return (
        left.join(right.select(ENTITY), ENTITY, "left_semi"),
        right.join(left.select(ENTITY), ENTITY, "left_semi"),
    )


def pool_members(members: DataFrame, pooling: str = POOLING, entity: str = ENTITY) -> DataFrame:
    """``(entity_id, embedding array<float>, n_members)`` from member vectors.

    Weights are member lengths (at least 1) or 1.  Spark combines the means in the map
    tasks, so a large entity sends one partial mean per task.
    """
    if pooling == "length_weighted":
        weight = F.greatest(F.coalesce(F.col("aa_length").cast("double"), F.lit(1.0)), F.lit(1.0))
    elif pooling == "mean":
        weight = F.lit(1.0)
    else:
        raise ValueError(f"unknown pooling {pooling!r}; use mean or length_weighted")
    rows = members.select(
        entity, array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"), weight.alias("_w")
    )
    return rows.groupBy(entity).agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w")), "float32").alias("embedding"),
        F.count(F.lit(1)).alias("n_members"),
    )


def cells_long(df: DataFrame, column: str, entity: str = ENTITY) -> DataFrame:
    """``(entity_id, dim, value)``, one row per vector component."""
    return df.select(entity, F.posexplode(column).alias("dim", "value"))

