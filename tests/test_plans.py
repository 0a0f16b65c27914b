import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from novelscape.operators import classify
from novelscape.operators.features import Vocabulary
from novelscape.operators.vectors import as_vectors
from novelscape.plans import compare, enrichment, members, novelty, recovery, sweep, temporal
from novelscape.plans.atlas import atlas, frame
from novelscape.plans.validate import validate
from novelscape.session import settle
from novelscape.streaming.scoring import read_scores, score_stream


def frame_of(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x)]
    return spark.createDataFrame(rows, "entity_id long, z array<double>")


def test_far_query_is_novel(spark):
    rng = np.random.default_rng(0)
    reference = novelty.Reference.fit(as_vectors(frame_of(spark, rng.normal(size=(40, 4))), "z"), k=3)
    queries = as_vectors(frame_of(spark, np.array([[0.0] * 4, [50.0] * 4]), [100, 101]), "z")
    got = {r["entity_id"]: r["novelty"] for r in reference.score(queries).collect()}
    assert got[101] == 1.0 > got[100]


def test_rank_novelty_and_audit(spark):
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(size=(60, 3)), [[30.0] * 3]])
    entities = spark.createDataFrame([(i, "ab"[i % 2], i % 9 + 1) for i in range(61)], "entity_id long, biosynth_class string, n_genes int")
    scores = settle(novelty.rank_novelty(frame_of(spark, z), entities))
    top = scores.where("rank = 1").first()
    assert top["entity_id"] == 60 and top["novelty"] == 1.0
    assert scores.select("rank").distinct().count() == 61
    audit = validate(scores, entities, Vocabulary(("dom::x", "size::n_genes"))).first()
    assert audit["checks_passed"] and not audit["class_label_leak"] and audit["n_entities"] == 61
    assert [c["biosynth_class"] for c in audit["novelty_by_class"]] == ["a", "b"]
    leaky = validate(scores, entities, Vocabulary(("class::x", "my_biosynth_class"))).first()
    assert leaky["forbidden_features"] == ["class::x", "my_biosynth_class"] and not leaky["checks_passed"]
    _, coords, projection = atlas(as_vectors(frame_of(spark, z), "z"), entities)
    limits = frame(coords).first()
    assert limits["n_outside"] >= 0 and limits["dim1_low"] < limits["dim1_high"] and len(projection.explained) == 3


def test_holdout(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(12, 3)) + 40])
    dates = ["2020-01-01"] * 60 + ["2022-01-01"] * 11 + [None]
    rows = [(i, "PKS" if i % 2 else "x", d) for i, d in enumerate(dates)]
    entities = spark.createDataFrame(rows, "entity_id long, biosynth_class string, date_added string")
    features = as_vectors(frame_of(spark, x), "z")
    audit, ranking, main = temporal.temporal_holdout(features, entities, "2021-01-01", k=3, n_controls=3)
    row = audit.first()
    assert (row["n_reference"], row["n_heldout"], row["n_controls"]) == (60, 12, 3)
    assert row["heldout_novelty_mean"] == 1.0 and row["heldout_more_novel_than_control"]
    assert 0.2 < row["control_novelty_mean_of_means"] < 0.8
    # Twelve held-out percentiles of 1 against three control means below it.
    assert row["mann_whitney_u"] == 36.0 and row["p_value_heldout_gt_control"] < 0.05
    assert row["minor_class_subset"]["n_heldout"] == 6 and row["minor_class_subset"]["excluded_classes"] == ["PKS", "NRPS", "hybrid"]
    assert ranking.count() == 12 and main.samples().groupBy("group").count().count() == 2
    again, _ = temporal.learned_temporal(features, entities, train_cutoff="2020-06-01", cutoff="2021-01-01", k=3, n_controls=2, baseline=main.figures)
    other = again.first()
    assert other["leakage_safe"] and other["baseline"]["heldout_novelty_mean"] == 1.0
    with pytest.raises(ValueError, match="held-out"):
        temporal.holdout(features, entities, F.col("date_added") > "2030")
    assert not temporal.leakage_safe(None, "2021-01-01") and not temporal.leakage_safe("2022-01-01", "2021-01-01")


def test_train_split(spark):
    dates = ["2020-01-01"] * 16 + ["2023-01-01"] * 7 + [None]
    entities = spark.createDataFrame([(f"e{i}", d) for i, d in enumerate(dates)], "entity_id string, date_added string")
    split = temporal.train_split(entities, entities, "2022-09-16")
    assert (split.where("is_train").count(), split.count()) == (16, 24)
    with pytest.raises(ValueError, match="before"):
        temporal.train_split(entities, entities.limit(3), "2022-09-16")


def swapped(n):
    """``(i, j)`` where neighbors of 0..n-1 change places: rho is 1 - 6 n / (n (n^2 - 1)) for even ``n``."""
    return [(i, i + 1 - 2 * (i % 2)) for i in range(n)]


def test_compare(spark):
    """Classes apart in score, so that each class's own rank correlation is known by hand."""
    order = {"swap": swapped(12), "turn": [(i, 9 - i) for i in range(10)], "tiny": [(0, 0), (1, 1), (2, 2)]}
    rows = []
    for shift, (label, pairs) in enumerate(order.items()):
        rows += [(f"{label}-{i:02d}", label, 3 * i + 1, shift + i / 20, shift + j / 20) for i, j in pairs]
    table = spark.createDataFrame(rows, "entity_id string, biosynth_class string, n_genes int, a double, b double")
    entities = table.select("entity_id", "biosynth_class", "n_genes")
    first = table.select("entity_id", F.col("a").alias("novelty"))
    second = table.select("entity_id", F.col("b").alias("novelty"))
    audit, by_class, _ = compare.compare_novelty({"hashed": first, "esm": second}, entities)
    got = by_class.collect()
    assert [r["biosynth_class"] for r in got] == ["turn", "swap"]  # the third has too few rows
    assert [r["spearman"] for r in got] == pytest.approx([-1.0, 1 - 6 * 12 / (12 * 143)])
    assert [r["n"] for r in got] == [10, 12] and [r["top_jaccard"] for r in got] == [0.0, 0.0]
    row = audit.first()
    squares = 12 + sum((2 * i - 9) ** 2 for i in range(10))
    assert row["spearman_hashed_vs_esm"] == pytest.approx(1 - 6 * squares / (25 * 624))
    assert (row["n_entities"], row["n_top"], len(row["by_class"])) == (25, 2, 2)
    learned, _ = compare.learned_compare(first, second, entities, third=second.where("entity_id <> 'tiny-01'"))
    row = learned.first()
    left = 1 - 6 * squares / (24 * 575)
    assert row["spearman_hashed_vs_third"] == pytest.approx(left)
    assert row["size_confound_delta"] == pytest.approx(row["size_confound_spearman_learned"] - row["size_confound_spearman_hashed"])


def test_group_enrichment(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        organism = ["Myxococcus x", "Streptomyces y", "Bacillus z"][i % 3]
        rows.append((i, organism, float(rng.random() + (i % 3 == 0) * 0.4), i % 80))
    scores = enrichment.with_genus(spark.createDataFrame(rows, "entity_id int, organism string, novelty double, n_genes int"))
    row = enrichment.group_enrichment(scores, "Myxobacteria", "Streptomyces", size_max=60).first()
    kept = [r for r in rows if r[3] <= 60]
    a = [r[2] for r in kept if r[0] % 3 == 0]
    b = [r[2] for r in kept if r[0] % 3 == 1]
    limit = np.quantile([r[2] for r in kept], 0.9)
    assert (row["a_hit"], row["b_hit"]) == (sum(x >= limit for x in a), sum(x >= limit for x in b))
    assert row["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row["odds_ratio"] > 1 and 0 <= row["p_value"] < 0.05
    assert [g["group"] for g in row["groups"]] == ["Myxobacteria", "Other", "Streptomyces"]
    assert row["top_decile_enrichment"][0]["genus"] == "Myxococcus"


def test_case_lookup(spark):
    entities = spark.createDataFrame([("a", "A x", "k", "c1"), ("b", "B y", "m", "c2")], "entity_id string, organism string, biosynth_class string, compounds string")
    scores = spark.createDataFrame([("a", 0.9, 1, "b", "m"), ("b", 0.1, 2, "a", "k")], "entity_id string, novelty double, rank int, nearest_id string, neighbor_class string")
    tokens = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t2"), ("b", "t2")], "entity_id string, token string")
    row = enrichment.case_lookup(entities.limit(1).select("entity_id"), scores, entities, tokens, scores).first()
    assert (row["nearest_organism"], row["novelty_other"]) == ("B y", 0.9)
    assert [(t["token"], t["n_entities"], t["share"]) for t in row["rarest_tokens"]] == [("t1", 1, 0.5), ("t2", 2, 1.0)]


def test_members(spark):
    rows = [("e", i, "m" * (9 + i) + "-1", 9 + i) for i in range(6)]
    table = spark.createDataFrame(rows, "entity_id string, member_id int, sequence string, aa_length int")
    kept = members.prepare_members(table, max_aa=12, max_members=3).orderBy(F.desc("aa_length")).collect()
    assert [(r["aa_length"], r["sequence"]) for r in kept] == [(n, "M" * 12) for n in (14, 13, 12)]
    cache = spark.createDataFrame([("e", 3, [1.0]), ("e", 1, None)], "entity_id string, aa_length int, embedding array<float>")
    with pytest.raises(ValueError, match="member cache"):
        members.repool(cache)
    assert members.repool(cache.where("embedding is not null"), expected=1).first()["embedding"] == [1.0]


def test_forests_keep_the_nodes_of_their_rows(spark, monkeypatch):
    made, real = [], classify.RandomForestClassifier
    monkeypatch.setattr(classify, "RandomForestClassifier", lambda **k: made.append(real(**k)) or made[-1])
    rng = np.random.default_rng(2)
    rows = [(i, Vectors.dense(rng.normal(size=3) + i % 2), "ab"[i % 2], i % 3) for i in range(60)]
    table = spark.createDataFrame(rows, ["entity_id", "features", "label", "fold"])
    found = {r["entity_id"]: r["predicted"] for r in classify.out_of_fold(table, "rf", 3, trees=4, depth=4).collect()}
    assert len(made) == 3 and all(m.getCacheNodeIds() for m in made)
    monkeypatch.setattr(classify, "RandomForestClassifier", lambda **k: real(**{**k, "cacheNodeIds": False}))
    assert found == {r["entity_id"]: r["predicted"] for r in classify.out_of_fold(table, "rf", 3, trees=4, depth=4).collect()}


def test_class_recovery(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 8, rng.normal(size=(2, 2))])
    labels = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 60 else "rare") for i in range(62)], "entity_id long, label string")
    features = as_vectors(frame_of(spark, x), "z")
    metrics, confusion, report = recovery.class_recovery(features, labels, n_splits=3, trees=5, max_iter=50, depth=4)
    rows = {r["model"]: r for r in metrics.collect()}
    assert set(rows) == {"logreg", "rf"} and rows["logreg"]["macro_f1"] > 0.95
    assert confusion.agg(F.sum("n")).first()[0] == 60 and report.where("class = 'rare'").isEmpty()
    noise = as_vectors(frame_of(spark, rng.normal(size=(60, 2))), "z")
    table = recovery.ablation({"good": features, "noise": noise}, labels, n_splits=3, models=("logreg",), max_iter=50)
    got = {r["representation"]: r["macro_f1"] for r in table.collect()}
    assert got["good"] > 0.95 > got["noise"]
    assert recovery.metrics_long(table).count() == 4
    assert {r["model"] for r in report.collect()} == {"logreg", "rf"}
    both = recovery.variants(noise, features, noise)
    assert list(both) == ["hashed", "embedding", "learned", "combined+embedding", "combined+learned"]
    assert both["combined+embedding"].first()["features"].size == 4


def test_sweep(spark):
    columns = "objective string, pooling string, status string, macro_f1_learned double, size_confound_learned double, temporal_heldout_mean double, temporal_control_mean double"
    runs = spark.createDataFrame([("s", "m", "ok", 0.5, 0.1, 0.6, 0.5), ("s", "m", "ok", 0.7, 0.3, 0.5, 0.5), ("s", "m", "error", None, None, None, None)], columns)
    row = sweep.sweep_summary(runs).first()
    assert (row["cfg"], row["n_runs"]) == ("s/m", 2)
    assert row["macro_f1_learned"] == pytest.approx(0.6) and row["temporal_delta"] == pytest.approx(0.05)


def token_table(n, ident=lambda i: f"e{i}"):
    rng = np.random.default_rng(7)
    return [("g", ident(i), "PKS", j, f"t{rng.integers(0, 6)}", i % 5 + 1) for i in range(n) for j in range(i % 6 + 1)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "genome string, bgc_id string, predicted_class string, gene_order int, domain_id string, n_genes int"
    known = spark.createDataFrame(token_table(40), schema)
    entities = known.groupBy(F.col("bgc_id").alias("entity_id")).agg(F.first("n_genes").alias("n_genes"), F.lit("PKS").alias("biosynth_class"))
    tokens = known.select(F.col("bgc_id").alias("entity_id"), "gene_order", F.lit(0).alias("token_pos"), F.col("domain_id").alias("token"))
    from novelscape.operators.features import build_features

    features, vocabulary = build_features(entities, tokens)
    reference = novelty.Reference.fit(settle(features), vocabulary=vocabulary)
    new = spark.createDataFrame(token_table(9, lambda i: f"n{i}"), schema)
    batch = novelty.apply_reference(reference, new, entities)
    source = tmp_path / "in"
    # The second file holds more tokens of entities of the first one.
    early = (F.col("bgc_id") <= "n4") & (F.col("gene_order") % 2 == 0)
    for part in (early, ~early):
        new.where(part).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    writer = score_stream(stream, reference, entities, str(tmp_path / "out"), str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    out = read_scores(spark, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/scores")).select("batch").distinct().count() == 2
    columns = ["rank", "bgc_id", "novelty", "nearest_id", "n_domain_annotations"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert [r["rank"] for r in batch.orderBy("rank").collect()] == list(range(1, 10))
    reference.save(str(tmp_path / "reference"))
    again = novelty.Reference.load(spark.newSession(), str(tmp_path / "reference"))
    twice = novelty.apply_reference(again, new, entities)
    assert sorted(map(tuple, twice.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_stream_histories_without_time(spark, tmp_path):
    """A stream without a time column goes on with its state, keeps values as they are, and calls no Python for each entity."""
    from novelscape.streaming.scoring import token_histories

    schema = "genome string, bgc_id int, predicted_class string, gene_order timestamp, domain_id string, n_genes int"
    source, seen = tmp_path / "in", []

    def arrive(values):
        frame = spark.sql(f"SELECT * FROM VALUES {values} AS t").toDF(*[c.split()[0] for c in schema.split(", ")])
        frame.coalesce(1).write.mode("append").parquet(str(source))
        keep = lambda batch, _: seen.append(sorted((r["bgc_id"], r["gene_order"].microsecond, r["domain_id"], r["n_genes"]) for r in batch.collect()))
        found = token_histories(spark.readStream.schema(schema).parquet(str(source)))
        query = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        return seen[-1], query._jsq.explainInternal(False)

    at = "timestamp'2020-01-01 00:00:00.00000"
    first, plan = arrive(f"('g', 1, 'c', {at}1', 'x', 3), ('g', 1, 'c', {at}2', 'x', 3), ('g', 2, 'c', {at}1', 'y', cast(null as int)), ('g', 3, null, {at}1', 'z', 1)")
    assert first == [("1", 1, "x", 3), ("1", 2, "x", 3), ("2", 1, "y", None)]
    assert "Python" not in plan and "Pandas" not in plan
    assert arrive(f"('g', 1, 'c', {at}3', 'w', 3), ('g', 4, 'c', {at}1', 'v', 1)")[0] == [("1", 1, "x", 3), ("1", 2, "x", 3), ("1", 3, "w", 3), ("4", 1, "v", 1)]


def test_stream_restarts_and_forgets(spark, tmp_path):
    """A stopped stream goes on with its state; late tokens are dropped, silent entities forgotten."""
    from novelscape.streaming.scoring import token_histories

    schema = "genome string, bgc_id string, predicted_class string, gene_order int, token_pos int, domain_id string, n_genes int, at timestamp"
    source, seen = tmp_path / "in", []

    def arrive(*rows):
        frame = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('g', '{b}', 'c', {i}, 0, 't{i}', 3, timestamp'2020-01-{day:02} 00:00:00')" for b, i, day in rows) + " AS t")
        frame.toDF(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        found = token_histories(stream, "at", "1 day", "5 days")
        keep = lambda batch, _: seen.append(sorted((r["bgc_id"], r["gene_order"]) for r in batch.collect()))
        before = len(seen)
        found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        return sorted(sum(seen[before:], []))

    assert arrive(("a", 0, 1), ("b", 0, 1)) == [("a", 0), ("b", 0)]
    assert arrive(("a", 1, 3)) == [("a", 0), ("a", 1)]
    # The watermark is the 2nd: a token of the 1st is too late, one of the 2nd is not.
    assert arrive(("b", 1, 1)) == []
    assert arrive(("b", 2, 3)) == [("b", 0), ("b", 2)]
    assert arrive(("c", 0, 20)) == [("c", 0)]
    # The others were silent for more than five days before the 19th.
    assert arrive(("a", 2, 20), ("c", 1, 20)) == [("a", 2), ("c", 0), ("c", 1)]
