import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from novelscape.operators import pca, vectors
from novelscape.sources.tables import read_table

EMBEDDINGS = "/root/testdata/sf0.001/embeddings.parquet"


def fixture(seed=0, n=160, d=30, rank=6):
    """Sparse rows with a falling spectrum, a constant column and an empty one."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, rank)) * 3.0 ** -np.arange(rank) @ draw.normal(size=(rank, d)) + 0.01 * draw.normal(size=(n, d))
    x[draw.random((n, d)) < 0.05] = 0
    x[:, 3], x[:, 4] = 7.0, 0.0
    x[5] = 0
    return x


def frame(spark, x, sparse=True):
    make = (lambda r: Vectors.sparse(len(r), [(i, v) for i, v in enumerate(r.tolist()) if v])) if sparse else (lambda r: Vectors.dense(r.tolist()))
    return spark.createDataFrame([(i, make(r)) for i, r in enumerate(x)], ["entity_id", "features"]).repartition(5)


def expected(x, k, center=False):
    spread = x.std(axis=0)
    scaled = x / np.where(spread > 0, spread, 1.0)
    scaled = scaled - scaled.mean(axis=0)
    u, s, _ = np.linalg.svd(scaled, full_matrices=False)
    return u[:, :k] * s[:k], s**2 / (s**2).sum()


def coordinates(projection, frame_):
    rows = sorted(projection.transform(frame_).collect(), key=lambda r: r["entity_id"])
    return np.array([r["z"] for r in rows])


def same_up_to_signs(a, b, tolerance=1e-6):
    signs = np.sign((a * b).sum(axis=0))
    np.testing.assert_allclose(a * signs, b, atol=tolerance)


@pytest.mark.parametrize("sparse, limit", [(True, 1000), (True, 10), (False, 10)])
def test_reducing_projection_equals_svd(spark, monkeypatch, sparse, limit):
    x = fixture()
    rows = frame(spark, x, sparse)
    z, explained = expected(x, 4)
    monkeypatch.setattr(vectors, "DENSE_COLUMNS", limit)
    projection = vectors.Projection.fit(rows, 4)
    assert isinstance(projection.pca, pca.Basis) == (limit == 10)
    same_up_to_signs(coordinates(projection, rows), z)
    np.testing.assert_allclose(projection.explained, explained[:4], atol=1e-9)


def test_directions_in_several_groups(spark, monkeypatch, tmp_path):
    """Directions that do not fit into one task's share are worked out group by group; a saved projection is the same."""
    x = fixture(1, 60, 20)
    rows = frame(spark, x)
    monkeypatch.setattr(vectors, "DENSE_COLUMNS", 4)
    monkeypatch.setattr(pca, "BOUND", 8 * 20 * 5)
    monkeypatch.setattr(pca, "HELD", 64)
    projection = vectors.Projection.fit(rows, 7)
    same_up_to_signs(coordinates(projection, rows), expected(x, 7)[0])
    projection.save(spark, str(tmp_path / "p"))
    again = vectors.Projection.load(spark, str(tmp_path / "p"))
    np.testing.assert_array_equal(coordinates(again, rows), coordinates(projection, rows))
    assert again.explained == projection.explained


def test_fewer_directions_than_asked(spark, monkeypatch):
    """Rank 2: the other components have no variance."""
    monkeypatch.setattr(vectors, "DENSE_COLUMNS", 3)
    x = np.outer(np.arange(12.0), np.ones(8)) + np.outer(np.arange(12.0) ** 2, [1, 2, 3, 4, 0, 0, 0, 0])
    projection = vectors.Projection.fit(frame(spark, x), 6)
    z, explained = expected(x, 2)
    got = coordinates(projection, frame(spark, x))
    same_up_to_signs(got[:, :2], z)
    assert np.abs(got[:, 2:]).max(initial=0) < 1e-6 and abs(sum(projection.explained) - 1) < 1e-9


def test_more_columns_than_a_covariance_allows(spark):
    draw, d = np.random.default_rng(2), 70_000
    common = [{j: float(draw.integers(1, 4)) for j in (i % 5, 10 + i % 3)} | {int(j): 1.0 for j in draw.integers(100, d, 3)} for i in range(40)]
    rows = spark.createDataFrame([(i, Vectors.sparse(d, c)) for i, c in enumerate(common)], ["entity_id", "features"])
    dense = np.zeros((40, d))
    for i, c in enumerate(common):
        dense[i, list(c)] = list(c.values())
    used = dense[:, dense.any(axis=0)]
    projection = vectors.Projection.fit(rows, 39)
    z, explained = expected(used, 39)
    got = coordinates(projection, rows)
    # All components together keep all distances.
    np.testing.assert_allclose(got @ got.T, z @ z.T, atol=1e-5 * np.abs(z @ z.T).max())
    assert abs(sum(projection.explained) - 1) < 1e-9


def test_reducing_all_components_of_the_embeddings(spark):
    table = read_table(spark, EMBEDDINGS).select("vec_id", "embedding").orderBy("vec_id")
    x = np.array([r["embedding"] for r in table.collect()], dtype=np.float64)
    rows = vectors.as_vectors(table, "embedding", entity="vec_id")
    z, explained = expected(x, 10)
    projection = vectors.Projection.fit(rows, 10)
    got = coordinates(projection, rows)
    np.testing.assert_allclose(projection.explained, explained[:10], rtol=1e-9)
    np.testing.assert_allclose(got @ got.T, z @ z.T, atol=1e-6)
