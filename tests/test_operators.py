import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from novelscape.functions.hashing import bucket
from novelscape.operators import classify, features, groups, neighbors, ordering, ranks, tokens, vectors
from novelscape.operators.ordering import SEGMENT
from novelscape.session import shared_folder

random.seed(5)


@pytest.fixture(scope="module", autouse=True)
def apart(spark):
    """Keep small fixtures in several partitions, so that segment boundaries are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 holds most of the rows, and one value is shared by a third of them."""
    rows = [(0 if i % 10 else 1 + i % 7, i * 7919 % 5000, i, float(i % 3 and i * 31 % 97)) for i in range(5000)]
    return spark.createDataFrame(rows, "g int, o int, id int, v double").repartition(5)


def test_pivots_send_few_rows_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL_POINTS", 50)
    vectors_ = points(spark, np.random.default_rng(3).normal(size=(20000, 4))).repartition(40)
    known = neighbors.distinct_points(vectors_).localCheckpoint()
    read = []
    whole = known.orderBy(F.xxhash64("z"), "point").limit(400).select("z").collect()
    original = type(known).orderBy
    monkeypatch.setattr(type(known), "orderBy", lambda df, *by: read.append(df.count()) or original(df, *by))
    assert neighbors._pivots(known, 20000).tolist() == [r["z"] for r in whole]
    assert read and max(read) < 1200


def test_segments_split_a_large_group(skewed):
    parts = ordering.segments(skewed, ["g", "o"]).groupBy("g").agg(F.countDistinct(SEGMENT).alias("n"))
    assert parts.where("g = 0").first()["n"] > 1


def test_sequence_equals_window(skewed):
    window = Window.partitionBy("g").orderBy("o")
    expected = skewed.select(
        "*", F.row_number().over(window).cast("long").alias("p"), F.lead("id").over(window).alias("nxt")
    )
    got = ordering.sequence(skewed, ["g"], ["o"], "p", {"nxt": "id"})
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_running_equals_window(skewed):
    window = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.select("id", F.coalesce(F.sum("id").over(window), F.lit(0)).alias("before"))
    got = ordering.running(skewed, ["o"], "id", ["g"]).select("id", "before")
    assert got.exceptAll(expected).isEmpty() and got.count() == 5000
    everything = ordering.ordinal(skewed, [F.desc("o")]).select("id", "ordinal").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in everything] == list(range(5000))


def test_small_groups_are_ordered_by_one_window(spark, monkeypatch):
    rows = [(i % 500, i * 7919 % 5003, i) for i in range(5000)]
    even = spark.createDataFrame(rows, "g int, o int, id int").repartition(5)
    window = Window.partitionBy("g").orderBy("o")
    before = F.coalesce(F.sum("id").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = even.select("*", F.row_number().over(window).cast("long").alias("p"), F.lead("id").over(window).alias("nxt"))
    summed = even.withColumn("before", before)
    settled = []
    monkeypatch.setattr(ordering, "settle", lambda df: settled.append(1) or df.checkpoint())
    for limit, cuts in ((100, 0), (5, 1)):
        monkeypatch.setattr(ordering, "SMALL_GROUP", limit)
        settled.clear()
        got = ordering.sequence(even, ["g"], ["o"], "p", {"nxt": "id"}, often_small=True)
        assert got.exceptAll(placed).isEmpty() and placed.exceptAll(got).isEmpty() and len(settled) == cuts
        got = ordering.running(even, ["o"], "id", ["g"], often_small=True)
        assert got.exceptAll(summed).isEmpty() and summed.exceptAll(got).isEmpty() and len(settled) == 2 * cuts


def test_quantiles(skewed):
    got = {r["g"]: r for r in ordering.quantiles(skewed, "v", {"a": 0.13, "m": 0.5}, ["g"]).collect()}
    frame = skewed.toPandas()
    for g, part in frame.groupby("g"):
        assert got[g]["a"] == pytest.approx(np.quantile(part.v, 0.13))
        assert got[g]["m"] == pytest.approx(np.quantile(part.v, 0.5))


def brute(z, k, r=None):
    other = z if r is None else r
    d = np.sqrt(((z[:, None] - other[None]) ** 2).sum(-1))
    if r is None:
        np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :k]
    return near.mean(1), near[:, -1], near[:, 0]


def points(spark, z, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(z)], "entity_id long, z array<double>")


@pytest.mark.parametrize("cut", [False, True])
def test_neighbors_equal_brute_force(spark, monkeypatch, cut):
    if cut:  # many small cells and blocks, bounds always used
        for name, value in (("CELL_POINTS", 15), ("MIN_BLOCK", 16), ("MAX_BLOCK", 32), ("WORTHWHILE", -1), ("_PROBE", 8)):
            monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(size=(150, 3)), np.round(rng.normal(size=(150, 3))), np.ones((60, 3)), rng.normal(size=(40, 3)) * 0.1 + 9])
    out = neighbors.leave_one_out(points(spark, z), 5).orderBy("entity_id").toPandas()
    for column, expected in zip(("knn_mean_dist", "knn_kth_dist", "nearest_dist"), brute(z, 5)):
        assert np.allclose(out[column], expected, atol=1e-12)
    assert np.allclose(np.sqrt(((z[out.nearest_id] - z) ** 2).sum(1)), out.nearest_dist) and (out.nearest_id != out.entity_id).all()
    queries, refs = z[::4], z[1::2]
    got = neighbors.against_reference(points(spark, queries), points(spark, refs), 4).orderBy("entity_id").toPandas()
    for column, expected in zip(("knn_mean_dist", "knn_kth_dist", "nearest_dist"), brute(queries, 4, refs)):
        assert np.allclose(got[column], expected, atol=1e-12)


def test_blocks_look_at_few_references_twice():
    """A block's k best equal brute force, ties by id; beside them few references are compared in double precision."""
    rng = np.random.default_rng(8)
    r = np.vstack([rng.normal(size=(5000, 6)), np.round(rng.normal(size=(1501, 6)))])
    q, ids = r[rng.permutation(len(r))[:300]], rng.permutation(len(r))
    rows, cols, dist = neighbors._k_best(np.arange(300), q, ids + 1000, r, 5, False)
    far = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(ids, far.shape), far))[:, :5]
    assert cols.reshape(300, 5).tolist() == order.tolist() and rows.tolist() == np.repeat(np.arange(300), 5).tolist()
    assert np.allclose(dist.reshape(300, 5), np.take_along_axis(far, order, 1))
    score = rng.normal(size=(64, 32768)).astype(np.float32)
    rows, cols = neighbors._lowest(score, 5, 64, np.zeros(64))
    found = set(zip(rows.tolist(), cols.tolist()))
    assert all((i, j) in found for i in range(64) for j in np.argsort(score[i])[:5].tolist()) and len(found) < 64 * 8


def test_blocks_are_read_not_shuffled(spark, monkeypatch):
    """Blocks are checkpointed once, and copies of a vector are shuffled by name only."""
    monkeypatch.setattr(neighbors, "MIN_BLOCK", 64)
    z = np.random.default_rng(4).normal(size=(400, 3))
    rows = [(i + 1000 * copy, [float(x) for x in row]) for copy in range(3) for i, row in enumerate(z)]
    rows += [(7, [0.0, 0.0, 0.0]), (7, [-0.0, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (7, [5.0, 5.0, 5.0])]
    found = neighbors.collapse(spark.createDataFrame(rows, "entity_id long, z array<double>"))
    known = {r["point"]: (r["last"], r["copies"]) for r in found.points.collect() if r["copies"] == 3 and r["point"] != 7}
    assert known == {i: (i + 2000, 3) for i in range(400) if i != 7}
    assert sorted((list(map(abs, r["z"])), r["last"], r["copies"]) for r in found.points.where("point = 7").collect()) == sorted(
        [([0.0] * 3, 9, 3), ([5.0] * 3, 7, 1), (list(map(abs, rows[7][1])), 2007, 3)]
    )
    assert found.members.columns == ["entity_id", "_key", "_more"] and found.members.count() == len(rows)
    once = found.points.where("point <> 7").localCheckpoint()
    near = neighbors.nearest_points(once, once, 5, True, 399, 399)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.index("Exchange") < plan.index("CartesianProduct") and plan.count("Exchange ") == 1
    assert near.count() == 399 * 5


def test_features_leave_their_vectors_only(spark):
    """What vectors are made of are tables, each shuffle of which ends with its table, and all of them are deleted."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    rows = [(e, i, 0, "abc"[(e * i) % 3]) for e in range(6) for i in range(5)]
    entities = spark.createDataFrame([(e, 5) for e in range(5)], "entity_id long, n_genes int")
    vectors, vocabulary = features.build_features(entities, spark.createDataFrame(rows, "entity_id long, gene_order int, token_pos int, token string"))
    found = {r["entity_id"]: r["features"].toArray() for r in vectors.collect()}
    assert len(set(folder.glob("table-*")) - before) == 1
    assert sorted(found) == [0, 1, 2, 3, 4] and len(vocabulary) == 3 + 256 + 6
    for e, z in found.items():
        held = ["abc"[(e * i) % 3] for i in range(5)]
        assert z[:3].tolist() == [held.count(t) for t in "abc"] and z[3:259].sum() == 9 and z[259] == 5


@pytest.mark.parametrize("scale", [1e-20, 1e25])
def test_neighbors_at_any_scale(spark, scale):
    z = np.random.default_rng(8).normal(size=(80, 4)) * scale + 1e3 * scale
    out = neighbors.leave_one_out(points(spark, z), 3).orderBy("entity_id").toPandas()
    assert np.allclose(out.knn_mean_dist / scale, brute(z / scale, 3)[0], rtol=1e-9)


def test_neighbors_few_points(spark):
    out = neighbors.leave_one_out(points(spark, np.array([[0.0], [1.0], [3.0]])), 5).orderBy("entity_id").toPandas()
    assert out.knn_mean_dist.tolist() == [2.0, 1.5, 2.5]
    same = neighbors.leave_one_out(points(spark, np.zeros((4, 2))), 2).orderBy("entity_id").toPandas()
    assert same.knn_mean_dist.tolist() == [0.0] * 4 and same.nearest_id.tolist() == [3, 0, 0, 0]


def test_novelty_orders_by_mean_distance(spark):
    """On a line the mean distances to the two nearest are 3, 2, 3, 6 and 13.5."""
    line = np.array([[0.0], [2.0], [4.0], [9.0], [20.0]]) + 100
    found = neighbors.leave_one_out(points(spark, line), 2)
    out = ranks.novelty_scores(found).orderBy("entity_id").toPandas()
    assert out.knn_mean_dist.tolist() == pytest.approx([3.0, 2.0, 3.0, 6.0, 13.5])
    assert out.novelty.tolist() == [0.25, 0.0, 0.5, 0.75, 1.0]  # the tie goes by id


def average_rank(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_spearman_by_hand(spark):
    """Without ties 1 - 6 * sum(d^2) / (n * (n^2 - 1)); a tie takes the mean rank of its places."""
    pairs = [(3, 900), (1, 20), (4, 5), (15, 70), (9, 81)]  # ranks 2 1 3 5 4 and 5 2 1 3 4: d^2 sums to 18
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "x double, y double")
    assert ranks.spearman(df, "x", "y").first()["rho"] == pytest.approx(1 - 6 * 18 / (5 * 24))
    tied = spark.createDataFrame([(a, b) for a in (1.0, 2.0, 2.0, 8.0) for b in (a * a, -a)], "x double, y double")
    x, y = (np.array(c, dtype=float) for c in zip(*tied.collect()))
    assert ranks.spearman(tied, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(average_rank(x), average_rank(y))[0, 1])
    assert ranks.spearman(df.withColumn("c", F.lit(1)), "x", "c").first()["rho"] is None


def test_rank_sum_and_effects(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 20, 40).astype(float), rng.integers(0, 15, 60).astype(float)
    df = spark.createDataFrame([(v, "a") for v in a.tolist()] + [(v, "b") for v in b.tolist()], "v double, g string")
    row = groups.two_group_tests(df, "v", F.col("g") == "a", F.col("g") == "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row["u"] == u and row["cliffs_delta"] == pytest.approx(2 * u / 2400 - 1)
    pooled = math.sqrt((39 * a.var(ddof=1) + 59 * b.var(ddof=1)) / 98)
    assert row["cohens_d"] == pytest.approx((a.mean() - b.mean()) / pooled)


def test_odds_with_empty_cell(spark):
    table = spark.createDataFrame([(3, 2, 0, 5)], "a_hit long, a_rest long, b_hit long, b_rest long")
    row = groups.odds(table).first()
    assert row["odds_ratio"] == pytest.approx((3.5 / 2.5) / (0.5 / 5.5)) and row["enrichment_ratio"] is None


def test_strict_percentile_and_overlap(spark):
    refs = spark.createDataFrame([(0.1,), (0.1,), (0.3,), (0.4,)], "knn_mean_dist double")
    queries = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 9.0)], "entity_id int, knn_mean_dist double")
    got = {r["entity_id"]: r["novelty"] for r in ranks.strict_percentile(queries, refs).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(25)], "entity_id int, x double, y double")
    row = ranks.top_overlap(df, "x", "y").first()
    assert (row["n_top"], row["n_both"], row["jaccard"]) == (2, 0, 0.0)


def test_features(spark):
    entities = spark.createDataFrame(
        [("A", "NRPS", 3, 10.5), ("B", "PKS", 2, None), ("C", "PKS", 1, 2.0), ("Z", "other", 0, 1.0)],
        "entity_id string, biosynth_class string, n_genes int, mean_aa_length double",
    )
    listed = {"A": ["x", "y", "x"], "B": ["x", "w"], "D": ["x", "y", "y"], "Z": ["y"]}
    rows = [(e, i // 2, i % 2, t) for e, ts in listed.items() for i, t in enumerate(ts)]
    rows += [("A", 9, 0, ""), ("A", 9, 1, None)]
    table = spark.createDataFrame(rows, "entity_id string, gene_order int, token_pos int, token string")
    got, vocabulary = features.build_features(entities, table, n_hash=64)
    # Entities outside of the table of entities count for the document frequency.
    assert [n for n in vocabulary.names if n.startswith("dom::")] == ["dom::x", "dom::y"]
    assert not any("class" in n for n in vocabulary.names)
    found = {r["entity_id"]: r["features"].toArray() for r in got.collect()}
    assert set(found) == {"A", "B", "C"} and len(vocabulary) == 2 + 64 + 6

    def expected(e, n_genes, mean):
        ts = listed.get(e, [])
        grams = [f"uni::{t}" for t in ts] + [f"bi::{a}::{b}" for a, b in zip(ts, ts[1:])]
        hashed = np.zeros(64)
        for row in spark.createDataFrame([(g,) for g in grams] or [("",)], "g string").select("g", bucket(F.col("g"), 64).alias("b")).collect():
            hashed[row["b"]] += bool(grams)
        return [ts.count("x"), ts.count("y"), *hashed, n_genes, 0, mean, 0, 0, 0]

    assert found["A"].tolist() == expected("A", 3, 10.5)
    assert found["B"].tolist() == expected("B", 2, 0.0)
    assert found["C"].tolist() == expected("C", 1, 2.0)


def test_vocabulary_is_a_table(spark):
    many = features.Vocabulary.of(spark.createDataFrame([(c,) for c in "dbca"], "token string"), 64)
    assert len(many) == 4 + 64 + 6 and many.names[:5] == ("dom::a", "dom::b", "dom::c", "dom::d", "arch_hash::0")
    assert sorted(r["idx"] for r in many.frame(spark).collect()) == list(range(74))


@pytest.mark.parametrize("center", [False, True])
def test_projection_equals_svd(spark, center):
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5] + 7, np.full((40, 1), 3.0)])
    df = vectors.as_vectors(points(spark, x), "z")
    projection = vectors.Projection.fit(df, 3, center)
    z = np.stack(projection.transform(df).orderBy("entity_id").toPandas().z.to_numpy())
    sd = np.where(x.std(0) < 1e-12, 1, x.std(0))
    scaled = x / sd - (x / sd).mean(0)
    expected = scaled @ np.linalg.svd(scaled, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(z), np.abs(expected), atol=1e-8) and np.allclose(z.mean(0), 0, atol=1e-8)


def test_pooling_weights_by_length(spark):
    """Two entities of two and three members: weighted means and plain means by hand."""
    rows = [("p", 30, [6.0, -2.0, 0.0]), ("p", 60, [0.0, 4.0, 3.0]), ("q", 5, [1.0, 0.0, 0.0]), ("q", 5, [0.0, 1.0, 0.0]), ("q", 10, [0.0, 0.0, 8.0])]
    table = spark.createDataFrame(rows, "entity_id string, aa_length int, embedding array<float>")
    weighted = {r["entity_id"]: r for r in vectors.pool_members(table).collect()}
    assert weighted["p"]["embedding"] == pytest.approx([2.0, 2.0, 2.0]) and weighted["q"]["embedding"] == pytest.approx([0.25, 0.25, 4.0])
    assert (weighted["p"]["n_members"], weighted["q"]["n_members"]) == (2, 3)
    plain = {r["entity_id"]: r["embedding"] for r in vectors.pool_members(table, "mean").collect()}
    assert plain["p"] == pytest.approx([3.0, 1.0, 1.5]) and plain["q"] == pytest.approx([1 / 3, 1 / 3, 8 / 3])
    with pytest.raises(ValueError, match="unknown pooling"):
        vectors.pool_members(table, "median")


def test_top_per_group_prunes_before_the_shuffle(spark, skewed):
    df = tokens.top_per_group(skewed, "g", ["o"], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.groupBy("g").count().agg(F.max("count")).first()[0] == 3


def test_stratified_folds(spark):
    labels = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(60)], "entity_id int, label string")
    counts = classify.stratified_folds(labels, 5).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in counts} == {("a", 8), ("b", 4)} and len(counts) == 10


def test_class_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    predictions = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entity_id int, label string, predicted string")
    got = {r["class"]: r for r in classify.class_report(predictions).collect()}
    assert got["a"]["f1"] == pytest.approx(0.5) and got["b"]["f1"] == pytest.approx(2 / 3) and got["c"]["f1"] == 0
    assert got["macro avg"]["f1"] == pytest.approx((0.5 + 2 / 3) / 3)
    assert got["weighted avg"]["f1"] == pytest.approx((0.5 * 2 + 2 / 3) / 4)
    assert got["accuracy"]["f1"] == 0.5


def test_token_pivot_takes_several_rows_of_a_token(spark):
    """Tokens need not be counted before, and entities without tokens or unknown ones are told apart."""
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "z", 1), (2, "b", 1), (9, "a", 1)], "entity_id long, token string, n long")
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    got = tokens.token_pivot(rows, entities, ["a", "b"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 0), (2, 0, 1), (3, 0, 0)]


def test_distinct_tokens(spark):
    """Rows of one entity are one; entities in one row each are not shuffled by entity and token."""
    lists = spark.createDataFrame([(1, ["a", "b", "a", ""]), (2, ["a"]), (3, None), (None, ["a"])], "entity_id long, tokens array<string>")
    got = tokens.distinct_tokens(lists)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    assert "Exchange" not in got._jdf.queryExecution().toString()
    more = lists.unionAll(spark.createDataFrame([(1, ["a", "c"])], lists.schema))
    assert sorted(tuple(r) for r in tokens.distinct_tokens(more).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
