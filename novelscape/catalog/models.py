"""Whole plans on the tables: features to ranking, holdouts, recovery, comparison, streams.

Projections and trained models have no SQL twin; their rows are only counted, and the
plans are tested against brute force on small fixtures.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from novelscape.catalog.bind import VECTORS, WORDS, activity, basket, documents, loo_sql, orders, r6, scratch, table, vectors, word_lists
from novelscape.operators import pca
from novelscape.operators.features import Vocabulary, build_features
from novelscape.operators.tokens import distinct_tokens
from novelscape.operators.vectors import as_vectors, pool_members
from novelscape.plans import compare as M
from novelscape.plans import temporal as H
from novelscape.plans.atlas import atlas, frame
from novelscape.plans.enrichment import case_lookup, group_enrichment, with_genus
from novelscape.plans.novelty import Reference, apply_reference, embed_scores, rank_novelty
from novelscape.plans.recovery import ablation, class_recovery, variants
from novelscape.plans.sweep import best_learned, sweep_summary
from novelscape.plans.validate import validate
from novelscape.session import settle, stored
from novelscape.streaming.scoring import read_scores, score_stream

CUTOFF = "1998-06-01"


def basket_features(spark, d, token="p_brand"):
    """Entities with lines, their vectors and the vocabulary."""
    entities = stored(orders(spark, d).where("n_genes > 0"))
    vectors_, vocabulary = build_features(entities, basket(spark, d, token).drop("l_partkey", "l_suppkey"))
    return entities, vectors_, vocabulary


def user_features(spark, d):
    """Users with their events as tokens; the class is the most frequent event type."""
    events = activity(spark, d)
    entities = settle(
        events.groupBy("entity_id").agg(
            F.count(F.lit(1)).alias("n_genes"),
            F.mode("token", True).alias("biosynth_class"),
            F.date_format(F.min("gene_order"), "yyyy-MM-dd").alias("date_added"),
        )
    )
    vectors_, vocabulary = build_features(entities, events)
    return entities, vectors_, vocabulary


def flagship(spark, d):
    """Baskets to features, PCA, leave-one-out neighbors and the ranking."""
    entities, features, _ = basket_features(spark, d)
    embedding, _, _ = atlas(features, entities.select("entity_id"))
    ranked = rank_novelty(embedding, entities)
    return ranked.select(
        "rank", "entity_id", "biosynth_class", "novelty", "knn_mean_dist", "nearest_dist", "nearest_id", "neighbor_class", "n_genes"
    )


def _dense(spark, d, width=50):
    """Vectors of as many dimensions as the projection has components, so that it is a rotation."""
    return vectors(spark, d).select("entity_id", "biosynth_class", F.slice("z", 1, width).alias("z"))


def pca_embed(spark, d):
    rows = _dense(spark, d)
    embedding, _, projection = atlas(settle(as_vectors(rows, "z")), rows.select("entity_id"))
    norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    return embedding.select("entity_id", F.size("z").alias("dims"), r6(norm).alias("norm"), F.lit(round(sum(projection.explained), 6)).alias("explained"))


def basket_vectors(spark, d):
    """Each entity's vector, by its number of non-zero features and its sum by kind."""
    _, features, vocabulary = basket_features(spark, d)
    z = vector_to_array("features")
    hashed = len(vocabulary) - 256 - 6
    end = hashed + 256
    total = lambda a, n: F.aggregate(F.slice(z, a + 1, n), F.lit(0.0), lambda s, x: s + x)
    return features.select(
        "entity_id",
        F.size(F.filter(F.slice(z, 1, hashed), lambda x: x != 0)).alias("n_tokens"),
        total(0, hashed).alias("tokens"),
        total(hashed, 256).alias("hashed"),
        r6(total(end, 6)).alias("sizes"),
    )


def document_cells(spark, d):
    """Every non-zero cell of the sparse vectors of all documents over all their words, hashed cells and sizes too."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    words = docs.select("entity_id", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+")).alias("gene_order", "token")).where("token <> ''")
    entities = settle(docs.select("entity_id", F.length("text").alias("n_genes"), (F.length("text") * 3).alias("cluster_nt_length")))
    vectors_, vocabulary = build_features(entities, words.withColumn("token_pos", F.lit(0)), min_df=1)
    cells = pca.cells(vectors_).select("entity_id", F.inline(F.arrays_zip("indices", "values")))
    last = F.lit(len(vocabulary) - 256 - 6)
    return cells.select(
        "entity_id",
        F.when(F.col("indices") < last, "token").when(F.col("indices") < last + 256, "hash").otherwise("size").alias("kind"),
        F.when(F.col("indices") < last, F.col("indices")).when(F.col("indices") < last + 256, F.col("indices") - last).otherwise(F.col("indices") - last - 256).alias("place"),
        "values",
    )


def atlas_frame(spark, d):
    entities, features, _ = basket_features(spark, d, "p_type")
    _, coords, _ = atlas(features, entities)
    return frame(coords)


def _sized(spark, d):
    """Entities of ``_dense`` with sizes that some of them exceed by far."""
    size = (F.col("entity_id") * 7919) % 1009 + 1
    return settle(_dense(spark, d).select("entity_id", "biosynth_class", size.alias("n_genes")))


def validate_audit(spark, d):
    rows, entities = _dense(spark, d), _sized(spark, d)
    embedding, _, _ = atlas(settle(as_vectors(rows, "z")), entities.select("entity_id"))
    leaky = Vocabulary(("dom::a", "class::b", "size::n_genes", "arch_hash::0", "dom::Biosynth_class_c"))
    audit = validate(rank_novelty(embedding, entities), entities, leaky)
    return audit.select(
        "n_entities",
        F.array_join("forbidden_features", ";").alias("forbidden_features"),
        "class_label_leak",
        "top50_size_outliers",
        r6("top_decile_same_class_neighbor_rate").alias("same_class_rate"),
        r6("novelty_size_spearman").alias("novelty_size_spearman"),
        F.size("novelty_by_class").cast("long").alias("n_classes"),
        r6(F.aggregate("novelty_by_class", F.lit(0.0), lambda a, x: a + x["median"])).alias("sum_of_medians"),
        "checks_passed",
    )


def _predicted(spark, d):
    """Lines of late orders as a predicted token table."""
    late = orders(spark, d).where(F.col("date_added") >= CUTOFF).select("entity_id", "biosynth_class", "n_genes")
    return basket(spark, d, "p_brand").join(late, "entity_id").select(
        F.lit("late").alias("genome"),
        F.col("entity_id").cast("string").alias("bgc_id"),
        F.col("biosynth_class").alias("predicted_class"),
        "gene_order",
        "token_pos",
        F.col("token").alias("domain_id"),
        F.col("n_genes").cast("int").alias("n_genes"),
    )


def apply_score(spark, d):
    early = stored(orders(spark, d).where((F.col("date_added") < CUTOFF) & (F.col("n_genes") > 0)))
    features, vocabulary = build_features(early, basket(spark, d, "p_brand").drop("l_partkey", "l_suppkey"))
    reference = Reference.fit(features, vocabulary=vocabulary)
    return apply_reference(reference, _predicted(spark, d), early, source="lineitem")


def _dated_vectors(spark, d):
    """Vectors of as many dimensions as the projection has components, with dates and sizes by id."""
    rows = _dense(spark, d)
    date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("entity_id") % 1000).cast("int")), "yyyy-MM-dd")
    entities = rows.select("entity_id", "biosynth_class", date.alias("date_added"), (F.col("entity_id") % 17 + 1).alias("n_genes"))
    return settle(entities), settle(as_vectors(rows, "z"))


SPLIT_DATE = "2020-12-01"
_FIGURES = ("heldout_novelty_mean", "heldout_novelty_median", "control_novelty_mean_of_means", "control_novelty_std_of_means")


def _figures(audit, prefix="", field=None):
    """The figures of a holdout as plain columns."""
    value = (lambda c: F.col(c)) if field is None else (lambda c: F.col(f"{field}.{c}"))
    whole = [value(c).cast("long").alias(prefix + c) for c in ("n_reference", "n_heldout", "n_controls")]
    return [*whole, *[r6(value(c)).alias(prefix + c) for c in _FIGURES], value("mann_whitney_u").alias(f"{prefix}mann_whitney_u")]


def temporal_holdout(spark, d):
    entities, features = _dated_vectors(spark, d)
    audit, _, _ = H.temporal_holdout(features, entities, SPLIT_DATE, exclude=("0", "1"))
    return audit.select(*_figures(audit), *_figures(audit, "minor_", "minor_class_subset"))


def _learned_temporal(spark, d):
    entities, features = _dated_vectors(spark, d)
    return H.learned_temporal(features, entities, train_cutoff="2020-11-01", cutoff=SPLIT_DATE)[0]


def learned_temporal(spark, d):
    audit = _learned_temporal(spark, d)
    return audit.select("cutoff_date", "leakage_safe", *_figures(audit))


def _holdout_sql(name, where, seed, repeats=50, k=5):
    """Figures of a holdout of ``vectors``: at full rank the projection is a rotation, so distances are those of scaled vectors."""
    return f"""
{name}_all AS (
  SELECT entity_id, z[1:50] AS z, strftime(DATE '2020-01-01' + (entity_id % 1000)::INT, '%Y-%m-%d') >= '{SPLIT_DATE}' AS held FROM v WHERE {where}
),
{name}_n AS (SELECT count(*) FILTER (NOT held) AS n_ref, count(*) FILTER (held) AS n_held, least(count(*) FILTER (held), count(*) FILTER (NOT held) // 2) AS n_drawn FROM {name}_all),
{name}_deal AS (
  SELECT -1 AS rep, entity_id, z, held AS asked FROM {name}_all UNION ALL
  SELECT rep, entity_id, z, place <= n_drawn FROM (
    SELECT rep, entity_id, z, row_number() OVER (PARTITION BY rep ORDER BY md5('{seed}:' || rep || ':' || entity_id), entity_id) AS place
    FROM {name}_all, range({repeats}) AS r(rep) WHERE NOT held), {name}_n
),
{name}_cells AS (SELECT rep, entity_id, asked, generate_subscripts(z, 1) AS dim, unnest(z) AS x FROM {name}_deal),
{name}_sd AS (SELECT rep, dim, stddev_pop(x) AS sd FROM {name}_cells WHERE NOT asked GROUP BY ALL),
{name}_z AS (SELECT rep, entity_id, asked, list(x / sd ORDER BY dim) AS z FROM {name}_cells JOIN {name}_sd USING (rep, dim) GROUP BY ALL),
{name}_near AS (
  SELECT a.rep, a.entity_id, a.asked, list_distance(a.z, b.z) AS d,
         row_number() OVER (PARTITION BY a.rep, a.entity_id ORDER BY list_distance(a.z, b.z), b.entity_id) AS rn
  FROM {name}_z a JOIN {name}_z b ON a.rep = b.rep AND NOT b.asked AND a.entity_id <> b.entity_id
),
{name}_mean AS (SELECT rep, entity_id, asked, avg(d) AS m FROM {name}_near WHERE rn <= {k} GROUP BY ALL),
{name}_novelty AS (
  SELECT rep, entity_id, (SELECT count(*) FROM {name}_mean r WHERE r.rep = q.rep AND NOT r.asked AND r.m < q.m)
    / (SELECT count(*) FROM {name}_mean r WHERE r.rep = q.rep AND NOT r.asked)::DOUBLE AS novelty
  FROM {name}_mean q WHERE asked
),
{name}_means AS (SELECT rep, avg(novelty) AS m FROM {name}_novelty WHERE rep >= 0 GROUP BY rep),
{name} AS (
  SELECT n_ref AS n_reference, n_held AS n_heldout, (SELECT count(*) FROM {name}_means) AS n_controls,
    (SELECT round(avg(novelty), 6) FROM {name}_novelty WHERE rep = -1) AS heldout_novelty_mean,
    (SELECT round(quantile_cont(novelty, 0.5), 6) FROM {name}_novelty WHERE rep = -1) AS heldout_novelty_median,
    (SELECT round(avg(m), 6) FROM {name}_means) AS control_novelty_mean_of_means,
    (SELECT round(stddev_pop(m), 6) FROM {name}_means) AS control_novelty_std_of_means,
    (SELECT sum(CASE WHEN h.novelty > c.m THEN 1.0 WHEN h.novelty = c.m THEN 0.5 ELSE 0 END)::DOUBLE FROM {name}_novelty h, {name}_means c WHERE h.rep = -1) AS mann_whitney_u
  FROM {name}_n
)"""


def class_recovery_metrics(spark, d):
    rows = vectors(spark, d)
    metrics, _, _ = class_recovery(settle(as_vectors(rows, "z")), rows.select("entity_id", F.col("biosynth_class").alias("label")))
    return metrics


def representation_ablation(spark, d):
    rows = vectors(spark, d)
    labels = rows.select("entity_id", F.col("biosynth_class").alias("label"))
    parts = [settle(as_vectors(rows.select("entity_id", F.slice("z", start, 20).alias("z")), "z")) for start in (1, 21, 41)]
    return ablation(variants(*parts), labels)


def _representations(spark, d):
    """Two of 25 dimensions each, so that both side by side are of full rank, too."""
    rows = vectors(spark, d)
    return [settle(as_vectors(rows.select("entity_id", F.slice("z", start, 25).alias("z")), "z")) for start in (1, 26)]


def representation_compare(spark, d):
    entities, _ = _dated_vectors(spark, d)
    scores = M.representation_scores(*_representations(spark, d))
    audit, _, _ = M.compare_novelty(scores, entities)
    names = [f"{kind}_{a}_vs_{b}" for kind, a, b in (
        ("spearman", "hashed", "other"), ("spearman", "hashed", "combined"), ("top_jaccard", "hashed", "other"), ("top_jaccard", "hashed", "combined"), ("top_jaccard", "other", "combined"))]
    return audit.select("n_entities", "n_top", *[r6(c).alias(c) for c in names], F.size("by_class").cast("long").alias("n_classes"))


def _learned_compare(spark, d):
    entities, dense = _dated_vectors(spark, d)
    left, right = _representations(spark, d)
    third = embed_scores(dense.where("entity_id % 10 <> 3"), center=True)
    return M.learned_compare(embed_scores(left), embed_scores(right, center=True), entities, third)[0]


def learned_compare(spark, d):
    names = ("spearman_hashed_vs_learned", "spearman_hashed_vs_third", "spearman_learned_vs_third", "top_jaccard_hashed_vs_learned",
             "size_confound_spearman_hashed", "size_confound_spearman_learned", "size_confound_delta")
    return _learned_compare(spark, d).select("n_entities", *[r6(c).alias(c) for c in names])


def _scores_sql(name, low, high, where="true"):
    """Novelty of a slice of ``vectors`` as table ``name``."""
    return f"""
{name}_c AS (SELECT entity_id, generate_subscripts(z[{low}:{high}], 1) AS dim, unnest(z[{low}:{high}]) AS x FROM v WHERE {where}),
{name}_d AS (SELECT dim, stddev_pop(x) AS sd FROM {name}_c GROUP BY dim),
{name}_q AS (SELECT entity_id, list(x / sd ORDER BY dim) AS z FROM {name}_c JOIN {name}_d USING (dim) GROUP BY entity_id),
{loo_sql(f"{name}_q", out=name)}"""


def _rho_sql(table, a, b):
    """Spearman's correlation of two columns, ties with average ranks; rows with both only."""
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
    return f"(SELECT round(corr(x, y), 6) FROM (SELECT {rank.format(a)} AS x, {rank.format(b)} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"


def _jaccard_sql(table, a, b):
    top = "row_number() OVER (ORDER BY {0} DESC, entity_id) <= (SELECT greatest(1, round_even(0.1 * count(*), 0)) FROM " + table + ")"
    return f"""(SELECT round(count(*) FILTER (p AND q)::DOUBLE / count(*) FILTER (p OR q), 6)
    FROM (SELECT {top.format(a)} AS p, {top.format(b)} AS q FROM {table}))"""


def eval_summary(spark, d):
    recovery = settle(representation_ablation(spark, d))
    entities, _ = _dated_vectors(spark, d)
    left, right = _representations(spark, d)
    novelty, _ = M.learned_compare(embed_scores(left), embed_scores(right, center=True), entities)
    return M.eval_summary(recovery, novelty, _learned_temporal(spark, d))


def group_enrichment_report(spark, d):
    docs = documents(spark, d).select(
        "entity_id", F.col("n_chars").cast("double").alias("novelty"), F.col("lang").alias("group"), F.col("source").alias("genus"), (F.col("n_chars") / 1000).cast("int").alias("n_genes")
    )
    out = group_enrichment(docs, "fr", "en", size_max=60)
    top = "top_decile_enrichment"
    return out.select(
        *["a_hit", "a_rest", "b_hit", "b_rest", "n_a", "n_b", "u"],
        *[r6(c).alias(c) for c in ("odds_ratio", "enrichment_ratio", "cohens_d", "cliffs_delta")],
        F.concat_ws(";", F.transform("groups", lambda g: F.concat_ws(":", g["group"], g["n"], F.round(g["median"], 3)))).alias("groups"),
        F.concat_ws(";", F.transform(top, lambda g: F.concat_ws(":", g["genus"], g["n_top"], g["n_total"]))).alias(top),
    )


def genus_groups(spark, d):
    genera = F.array(*[F.lit(g) for g in ("Myxococcus xanthus", "Streptomyces sp.", "Bacillus subtilis", "")])
    docs = documents(spark, d).select("entity_id", F.get(genera, (F.col("entity_id") % 4).cast("int")).alias("organism"))
    return with_genus(docs).groupBy("genus", "group").agg(F.count(F.lit(1)).alias("n"))


def case_lookups(spark, d):
    """The documents that are most novel by their vectors, with their words."""
    vectors_ = _dense(spark, d)
    entities = settle(
        documents(spark, d).select("entity_id", F.col("lang").alias("biosynth_class"), F.col("source").alias("organism"), F.col("n_chars").alias("n_genes"))
    )
    embedding, _, _ = atlas(settle(as_vectors(vectors_, "z")), entities.select("entity_id"))
    scores = settle(rank_novelty(embedding, entities))
    top = scores.orderBy("rank").limit(20).select("entity_id")
    found = case_lookup(top, scores, entities, distinct_tokens(word_lists(spark, d)), distinct=True)
    return found.select(
        *["entity_id", "rank", "organism", "biosynth_class", "n_genes", "nearest_id", "neighbor_class", "nearest_organism"],
        r6("novelty").alias("novelty"),
        F.concat_ws(";", F.transform("rarest_tokens", lambda t: F.concat_ws(":", t["token"], t["n_entities"]))).alias("rarest_tokens"),
    )


def pooled_novelty(spark, d):
    """Members pooled by 100 entities, in at most as many dimensions as the projection has components."""
    members = table(spark, d, "embeddings").select(
        (F.col("vec_id") % 100).alias("entity_id"), (F.col("vec_id") % 7 * 100).alias("aa_length"), F.slice("embedding", 1, 50).alias("embedding")
    )
    pooled = settle(as_vectors(pool_members(members), "embedding"))
    return embed_scores(pooled, center=True).select("entity_id", "nearest_id", *[r6(c).alias(c) for c in ("knn_mean_dist", "nearest_dist", "novelty")])


def sweep(spark, d):
    heads = table(spark, d, "orders")
    runs = heads.select(
        F.lower("o_orderpriority").alias("objective"),
        F.col("o_orderstatus").alias("pooling"),
        F.when(F.col("o_orderkey") % 11 == 0, "error").otherwise("ok").alias("status"),
        F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice") / 1000000).alias("macro_f1_learned"),
        (F.col("o_custkey") / 1000).alias("size_confound_learned"),
        (F.col("o_totalprice") / 500000).alias("temporal_heldout_mean"),
        (F.col("o_orderkey") / 500000).alias("temporal_control_mean"),
    )
    out = sweep_summary(runs)
    return out.select("cfg", "n_runs", *[r6(c).alias(c) for c in ("macro_f1_learned", "size_confound_learned", "temporal_delta")])


def sweep_best(spark, d):
    lines = table(spark, d, "lineitem")
    scores = lines.select(
        F.col("l_suppkey").alias("run"),
        F.when(F.col("l_returnflag") == "A", "hashed").when(F.col("l_returnflag") == "N", "learned-x").otherwise("combined+learned-x").alias("representation"),
        F.col("l_discount").alias("macro_f1"),
    )
    return best_learned(scores)


def stream_apply(spark, d):
    """Events as a stream of predicted tokens, scored against all users; a user's day may come in several batches."""
    entities, features, vocabulary = user_features(spark, d)
    reference = Reference.fit(features, vocabulary=vocabulary)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    tokens = stream.select(
        F.lit("events").alias("genome"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "D")).alias("bgc_id"),
        F.lit("day").alias("predicted_class"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("gene_order"),
        F.col("event_id").alias("token_pos"),
        F.col("event_type").alias("domain_id"),
        F.lit(1).alias("n_genes"),
    )
    output = scratch(spark, "stream")
    query = score_stream(tokens, reference, entities, output, scratch(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_scores(spark, output)


QUERIES = {
    "flagship_ranking": (flagship, None),
    "pca_embed": (
        pca_embed,
        f"""WITH {VECTORS}, c AS (SELECT entity_id, generate_subscripts(z[1:50], 1) AS dim, unnest(z[1:50]) AS x FROM v),
        s AS (SELECT dim, stddev_pop(x) AS sd, avg(x) AS m FROM c GROUP BY dim)
        SELECT entity_id, 50 AS dims, round(sum(((x - m) / sd) ** 2), 6) AS norm, 1.0::DOUBLE AS explained FROM c JOIN s USING (dim) GROUP BY entity_id""",
    ),
    "basket_vectors": (
        basket_vectors,
        """WITH b AS (SELECT l_orderkey AS entity_id, p_brand AS token, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
        freq AS (SELECT token FROM (SELECT DISTINCT entity_id, token FROM b) GROUP BY token HAVING count(*) >= 3),
        n AS (SELECT entity_id, count(DISTINCT token) AS n_tokens, count(*)::DOUBLE AS tokens FROM b SEMI JOIN freq USING (token) GROUP BY entity_id),
        e AS (SELECT entity_id, count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM b GROUP BY entity_id)
        SELECT entity_id, coalesce(n_tokens, 0)::INT AS n_tokens, coalesce(tokens, 0.0)::DOUBLE AS tokens, (2 * n - 1)::DOUBLE AS hashed,
               round((n + n + total + mean)::DOUBLE, 6) AS sizes FROM e LEFT JOIN n USING (entity_id)""",
    ),
    "document_cells": (
        document_cells,
        r"""WITH listed AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS token FROM listed),
        vocabulary AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INT AS place FROM (SELECT DISTINCT token FROM words)),
        grams AS (SELECT doc_id, 'uni::' || token AS gram FROM words UNION ALL
          SELECT doc_id, 'bi::' || w[i] || '::' || w[i + 1] FROM listed, range(1, len(w)) AS r(i)),
        hashed AS (SELECT doc_id, (('0x' || substr(md5(gram), 31, 2))::INT) AS place, count(*)::DOUBLE AS v FROM grams GROUP BY ALL)
        SELECT doc_id AS entity_id, 'token' AS kind, place, count(*)::DOUBLE AS values FROM words JOIN vocabulary USING (token) WHERE true GROUP BY ALL
        UNION ALL SELECT doc_id, 'hash', place, v FROM hashed
        UNION ALL SELECT doc_id, 'size', 0, length(text)::DOUBLE FROM documents WHERE length(text) > 0
        UNION ALL SELECT doc_id, 'size', 1, (length(text) * 3)::DOUBLE FROM documents WHERE length(text) > 0""",
    ),
    "atlas_frame": (atlas_frame, None),
    "validate_audit": (
        validate_audit,
        f"""WITH {VECTORS}, {_scores_sql("a", 1, 50)},
        e AS (SELECT entity_id, label, (entity_id * 7919) % 1009 + 1 AS size, novelty, nearest_id, row_number() OVER (ORDER BY novelty DESC, entity_id) AS rank FROM a JOIN v USING (entity_id)),
        g AS (SELECT label, quantile_cont(novelty, 0.5) AS median FROM e GROUP BY label),
        o AS (SELECT count(*) FILTER (size > (SELECT quantile_cont(size, 0.99) FROM e)) AS n FROM e WHERE rank <= 50),
        h AS (SELECT e.label = f.label AS same FROM e LEFT JOIN v f ON f.entity_id = e.nearest_id WHERE novelty >= (SELECT quantile_cont(novelty, 0.9) FROM e))
        SELECT (SELECT count(*) FROM e) AS n_entities, 'class::b;dom::Biosynth_class_c' AS forbidden_features, true AS class_label_leak, n AS top50_size_outliers,
               (SELECT round(avg(same::INT), 6) FROM h) AS same_class_rate, {_rho_sql("e", "novelty", "size")} AS novelty_size_spearman,
               (SELECT count(*) FROM g) AS n_classes, (SELECT round(sum(median), 6) FROM g) AS sum_of_medians, false AS checks_passed FROM o""",
    ),
    "apply_score": (apply_score, None),
    "temporal_holdout": (
        temporal_holdout,
        f"""WITH {VECTORS}, {_holdout_sql("t", "true", 42)}, {_holdout_sql("m", "label NOT IN (0, 1)", 43)}
        SELECT t.*, m.n_reference AS minor_n_reference, m.n_heldout AS minor_n_heldout, m.n_controls AS minor_n_controls, m.heldout_novelty_mean AS minor_heldout_novelty_mean,
               m.heldout_novelty_median AS minor_heldout_novelty_median, m.control_novelty_mean_of_means AS minor_control_novelty_mean_of_means,
               m.control_novelty_std_of_means AS minor_control_novelty_std_of_means, m.mann_whitney_u AS minor_mann_whitney_u FROM t, m""",
    ),
    "learned_temporal": (
        learned_temporal,
        f"""WITH {VECTORS}, {_holdout_sql("t", "true", 42)}
        SELECT '{SPLIT_DATE}' AS cutoff_date, true AS leakage_safe, t.* FROM t""",
    ),
    "class_recovery": (class_recovery_metrics, None),
    "representation_ablation": (representation_ablation, None),
    "representation_compare": (
        representation_compare,
        f"""WITH {VECTORS}, {_scores_sql("a", 1, 25)}, {_scores_sql("b", 26, 50)}, {_scores_sql("c", 1, 50)},
        j AS (SELECT entity_id, v.label, a.novelty AS na, b.novelty AS nb, c.novelty AS nc FROM v JOIN a USING (entity_id) JOIN b USING (entity_id) JOIN c USING (entity_id))
        SELECT (SELECT count(*) FROM j) AS n_entities, (SELECT greatest(1, round_even(0.1 * count(*), 0))::BIGINT FROM j) AS n_top,
               {_rho_sql("j", "na", "nb")} AS spearman_hashed_vs_other, {_rho_sql("j", "na", "nc")} AS spearman_hashed_vs_combined,
               {_jaccard_sql("j", "na", "nb")} AS top_jaccard_hashed_vs_other, {_jaccard_sql("j", "na", "nc")} AS top_jaccard_hashed_vs_combined,
               {_jaccard_sql("j", "nb", "nc")} AS top_jaccard_other_vs_combined,
               (SELECT count(*) FROM (SELECT label FROM j GROUP BY label HAVING count(*) >= 10)) AS n_classes""",
    ),
    "learned_compare": (
        learned_compare,
        f"""WITH {VECTORS}, {_scores_sql("a", 1, 25)}, {_scores_sql("b", 26, 50)}, {_scores_sql("c", 1, 50, "entity_id % 10 <> 3")},
        j AS (SELECT entity_id, entity_id % 17 + 1 AS size, a.novelty AS na, b.novelty AS nb, c.novelty AS nc FROM v JOIN a USING (entity_id) JOIN b USING (entity_id) LEFT JOIN c USING (entity_id)),
        o AS (SELECT (SELECT count(*) FROM j) AS n_entities, {_rho_sql("j", "na", "nb")} AS spearman_hashed_vs_learned, {_rho_sql("j", "na", "nc")} AS spearman_hashed_vs_third,
               {_rho_sql("j", "nb", "nc")} AS spearman_learned_vs_third, {_jaccard_sql("j", "na", "nb")} AS top_jaccard_hashed_vs_learned,
               {_rho_sql("j", "na", "size").replace(", 6)", ", 9)")} AS ra, {_rho_sql("j", "nb", "size").replace(", 6)", ", 9)")} AS rb)
        SELECT * EXCLUDE (ra, rb), round(ra, 6) AS size_confound_spearman_hashed, round(rb, 6) AS size_confound_spearman_learned, round(rb - ra, 6) AS size_confound_delta FROM o""",
    ),
    "eval_summary": (eval_summary, None),
    "group_enrichment": (
        group_enrichment_report,
        """WITH d AS (SELECT doc_id, n_chars::DOUBLE AS x, lang, source FROM documents WHERE lang IS NOT NULL AND n_chars // 1000 <= 60),
        h AS (SELECT *, x >= (SELECT quantile_cont(x, 0.9) FROM d) AS is_high FROM d),
        r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM h WHERE lang IN ('fr', 'en')),
        t AS (SELECT count(*) FILTER (lang = 'fr' AND is_high) AS a_hit, count(*) FILTER (lang = 'fr' AND NOT is_high) AS a_rest,
                     count(*) FILTER (lang = 'en' AND is_high) AS b_hit, count(*) FILTER (lang = 'en' AND NOT is_high) AS b_rest,
                     count(*) FILTER (lang = 'fr') AS n_a, count(*) FILTER (lang = 'en') AS n_b,
                     avg(x) FILTER (lang = 'fr') - avg(x) FILTER (lang = 'en') AS gap, var_samp(x) FILTER (lang = 'fr') AS va, var_samp(x) FILTER (lang = 'en') AS vb,
                     sum(rk) FILTER (lang = 'fr') AS ra FROM r),
        c AS (SELECT *, CASE WHEN least(a_hit, a_rest, b_hit, b_rest) = 0 THEN 0.5::DOUBLE ELSE 0 END AS k, (ra - n_a * (n_a + 1) / 2)::DOUBLE AS u FROM t),
        s AS (SELECT source, count(*) FILTER (is_high) AS n_top, count(*) AS n_total FROM h GROUP BY source HAVING count(*) FILTER (is_high) >= 3 AND count(*) >= 5
              ORDER BY count(*) FILTER (is_high) / count(*) DESC, count(*) FILTER (is_high) DESC, source LIMIT 12)
        SELECT a_hit, a_rest, b_hit, b_rest, n_a, n_b, u, round(((a_hit + k) / (a_rest + k)) / ((b_hit + k) / (b_rest + k)), 6) AS odds_ratio,
               round((a_hit / n_a) / nullif(b_hit / n_b, 0), 6) AS enrichment_ratio, round(gap / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS cohens_d,
               round(2 * u / (n_a * n_b) - 1, 6) AS cliffs_delta,
               (SELECT string_agg(lang || ':' || n || ':' || m, ';' ORDER BY lang) FROM (SELECT lang, count(*) AS n, round(quantile_cont(x, 0.5), 3) AS m FROM h GROUP BY lang)) AS groups,
               (SELECT string_agg(source || ':' || n_top || ':' || n_total, ';' ORDER BY n_top / n_total DESC, source) FROM s) AS top_decile_enrichment FROM c""",
    ),
    "genus_groups": (
        genus_groups,
        """WITH g AS (SELECT ['Myxococcus', 'Streptomyces', 'Bacillus', ''][doc_id % 4 + 1] AS genus FROM documents)
        SELECT genus, CASE genus WHEN 'Myxococcus' THEN 'Myxobacteria' WHEN 'Streptomyces' THEN 'Streptomyces' ELSE 'Other' END AS "group", count(*) AS n
        FROM g GROUP BY genus""",
    ),
    "case_lookup": (
        case_lookups,
        f"""WITH {VECTORS}, {WORDS}, {_scores_sql("a", 1, 50)},
        e AS (SELECT a.*, lang, source, n_chars FROM a JOIN documents ON doc_id = entity_id),
        r AS (SELECT *, row_number() OVER (ORDER BY novelty DESC, entity_id) AS rank FROM e),
        top AS (SELECT * FROM r WHERE rank <= 20),
        n AS (SELECT token, count(DISTINCT entity_id) AS n_entities FROM words GROUP BY token),
        w AS (SELECT entity_id, token, n_entities, row_number() OVER (PARTITION BY entity_id ORDER BY n_entities, token) AS k
              FROM (SELECT DISTINCT entity_id, token FROM words WHERE entity_id IN (SELECT entity_id FROM top)) JOIN n USING (token)),
        l AS (SELECT entity_id, string_agg(token || ':' || n_entities, ';' ORDER BY k) AS rarest_tokens FROM w WHERE k <= 6 GROUP BY entity_id)
        SELECT top.entity_id, rank, top.source AS organism, top.lang AS biosynth_class, top.n_chars AS n_genes, nearest_id, f.lang AS neighbor_class, f.source AS nearest_organism,
               round(novelty, 6) AS novelty, coalesce(rarest_tokens, '') AS rarest_tokens
        FROM top LEFT JOIN documents f ON f.doc_id = nearest_id LEFT JOIN l ON l.entity_id = top.entity_id""",
    ),
    "pooled_novelty": (
        pooled_novelty,
        f"""WITH c AS (SELECT vec_id % 100 AS entity_id, greatest((vec_id % 7) * 100, 1)::DOUBLE AS w, generate_subscripts(embedding[1:50], 1) AS dim, unnest(embedding[1:50])::DOUBLE AS x FROM embeddings),
        p AS (SELECT entity_id, dim, (sum(w * x) / sum(w))::FLOAT::DOUBLE AS x FROM c GROUP BY ALL),
        sd AS (SELECT dim, stddev_pop(x) AS sd FROM p GROUP BY dim),
        q AS (SELECT entity_id, list(x / sd ORDER BY dim) AS z FROM p JOIN sd USING (dim) GROUP BY entity_id),
        {loo_sql("q")}
        SELECT entity_id, nearest_id, round(knn_mean_dist, 6) AS knn_mean_dist, round(nearest_dist, 6) AS nearest_dist, round(novelty, 6) AS novelty FROM s""",
    ),
    "sweep_summary": (
        sweep,
        """WITH r AS (SELECT lower(o_orderpriority) || '/' || o_orderstatus AS cfg, o_totalprice / 1000000 AS f1, o_custkey / 1000 AS s,
                    o_totalprice / 500000 - o_orderkey / 500000 AS t FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 > 0)
        SELECT cfg, count(*) AS n_runs, round(avg(f1), 6) AS macro_f1_learned, round(avg(s), 6) AS size_confound_learned, round(avg(t), 6) AS temporal_delta
        FROM r GROUP BY cfg""",
    ),
    "sweep_best": (
        sweep_best,
        "SELECT l_suppkey AS run, max(l_discount) AS macro_f1_learned FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey",
    ),
    "stream_apply": (stream_apply, None),
}
