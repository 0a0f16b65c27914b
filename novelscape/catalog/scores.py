"""Vector, novelty and statistics queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from novelscape.catalog.bind import DOCUMENTS, LABELLED, VECTORS, documents, labelled, loo_sql, orders, r6, table, vectors
from novelscape.functions.text import leaks_class
from novelscape.operators import classify as C
from novelscape.operators import groups as G
from novelscape.operators import ranks as R
from novelscape.operators import vectors as V
from novelscape.operators.neighbors import against_reference, leave_one_out
from novelscape.operators.ordering import quantiles
from novelscape.plans import validate as P
from novelscape.plans.compare import by_class
from novelscape.plans.enrichment import group_label, group_summary
from novelscape.plans.novelty import rank_novelty, score_novelty
from novelscape.plans.recovery import metrics_long
from novelscape.session import settle


def knn_loo(spark, d):
    out = leave_one_out(vectors(spark, d), 5)
    return out.select("entity_id", r6("knn_mean_dist").alias("knn_mean_dist"), r6("knn_kth_dist").alias("knn_kth_dist"))


def nearest_neighbor(spark, d):
    entities = vectors(spark, d)
    out = leave_one_out(entities, 5).join(
        entities.select(F.col("entity_id").alias("nearest_id"), F.col("biosynth_class").alias("neighbor_class")), "nearest_id", "left"
    )
    return out.select("entity_id", "nearest_id", "neighbor_class", r6("nearest_dist").alias("nearest_dist"))


def _split(spark, d):
    rows = vectors(spark, d)
    return rows.where("entity_id % 5 = 0"), rows.where("entity_id % 5 <> 0")


def knn_query(spark, d):
    queries, refs = _split(spark, d)
    out = against_reference(queries, refs, 5)
    return out.select("entity_id", "nearest_id", r6("knn_mean_dist").alias("knn_mean_dist"), r6("nearest_dist").alias("nearest_dist"))


def novelty_percentile(spark, d):
    queries, refs = _split(spark, d)
    scored = R.strict_percentile(against_reference(queries, refs, 5), leave_one_out(refs, 5))
    return scored.select("entity_id", r6("novelty").alias("novelty"))


def novelty_ranking(spark, d):
    rows = vectors(spark, d)
    out = rank_novelty(rows, rows.drop("z"))
    return out.select("entity_id", "rank", r6("novelty").alias("novelty"), "nearest_id", "neighbor_class")


def _scores(spark, d):
    rows = vectors(spark, d)
    return settle(rank_novelty(rows, rows.drop("z")))


def class_stats(spark, d):
    out = G.group_stats(_scores(spark, d), "novelty", "biosynth_class")
    return out.select("biosynth_class", "count", *[r6(c).alias(c) for c in ("mean", "median", "std")])


def high_novelty_share(spark, d):
    flagged = G.high_share(_scores(spark, d), "novelty")
    return flagged.groupBy("biosynth_class").agg(r6(F.avg(F.col("is_high").cast("double"))).alias("share"))


def same_class_neighbor_rate(spark, d):
    return P.same_class_rate(_scores(spark, d)).select(r6("rate").alias("rate"))


def size_outliers(spark, d):
    entities = orders(spark, d).where("n_genes > 0")
    ranked = R.rank_from_top(entities.withColumn("value", F.col("mean_aa_length") * F.col("n_genes")), "value")
    return P.size_outliers(ranked, entities)


def exact_quantiles(spark, d):
    lines = table(spark, d, "lineitem")
    q = quantiles(lines, "l_extendedprice", {"q01": 0.01, "q50": 0.5, "q90": 0.9, "q99": 0.99}, ["l_returnflag"])
    return q.select("l_returnflag", *[r6(c).alias(c) for c in ("q01", "q50", "q90", "q99")])


def ordinal_rank01(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), "o_totalprice")
    return R.rank01(rows, "o_totalprice").select("entity_id", r6("rank01").alias("rank01"))


def average_rank(spark, d):
    ranks = R.average_ranks(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], "avg_rank")
    return ranks.select("l_returnflag", "l_quantity", "n", "avg_rank")


def strict_ecdf(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("value"))
    refs, queries = rows.where("c_mktsegment = 'BUILDING'"), rows.where("c_mktsegment <> 'BUILDING'")
    out = R.strict_percentile(queries.select("c_custkey", "value"), refs, "value", "percentile")
    return out.select("c_custkey", r6("percentile").alias("percentile"))


def spearman_size(spark, d):
    return R.spearman(orders(spark, d), "n_genes", "total_aa_length").select("n", r6("rho").alias("rho"))


def spearman_by_group(spark, d):
    out = R.spearman(orders(spark, d), "n_genes", "mean_aa_length", ["biosynth_class"])
    return out.select("biosynth_class", "n", r6("rho").alias("rho"))


def _two_scores(spark, d):
    rows = vectors(spark, d)
    parts = {}
    for name, start in (("a", 1), ("b", 33)):
        half = rows.select("entity_id", F.slice("z", start, 32).alias("z"))
        parts[name] = score_novelty(half).select("entity_id", F.col("novelty").alias(f"novelty_{name}"))
    return settle(rows.select("entity_id", "biosynth_class").join(parts["a"], "entity_id").join(parts["b"], "entity_id"))


def jaccard_top_decile(spark, d):
    out = R.top_overlap(_two_scores(spark, d), "novelty_a", "novelty_b")
    return out.select("n", "n_top", "n_both", r6("jaccard").alias("jaccard"))


def disagreement_by_class(spark, d):
    out = by_class(_two_scores(spark, d), "a", "b")
    return out.select(
        "biosynth_class",
        "n",
        *[r6(c).alias(c) for c in ("spearman", "top_jaccard", "mean_novelty_a", "mean_novelty_b")],
    )


def _docs(spark, d):
    return labelled(spark, d)


def contingency(spark, d):
    docs = G.high_share(_docs(spark, d), "n_chars")
    return G.contingency(docs, F.col("quality") == 1, F.col("quality") == 0, F.col("is_high"))


def odds_ratio(spark, d):
    out = G.odds(contingency(spark, d))
    return out.select(*[r6(c).alias(c) for c in ("odds_ratio", "ci_low", "ci_high", "enrichment_ratio")])


def enrichment_by_group(spark, d):
    docs = G.high_share(documents(spark, d).drop("text"), "n_chars")
    out = G.enrichment(docs, "source", F.col("is_high"))
    return out.select("source", "n_top", "n_total", r6("enrichment").alias("enrichment"))


def group_summaries(spark, d):
    docs = G.high_share(documents(spark, d).drop("text"), "n_chars")
    labelled_docs = docs.withColumn("group", group_label(F.col("lang"), {"Romance": ("fr", "es"), "Germanic": ("de", "en")}))
    out = group_summary(labelled_docs, "n_chars", "group")
    return out.select("group", "n", *[r6(c).alias(c) for c in ("mean", "median", "share_high")])


def cohens_d(spark, d):
    out = G.cohens_d(_docs(spark, d), "n_chars", F.col("quality") == 1, F.col("quality") == 0)
    return out.select("n_a", "n_b", r6("cohens_d").alias("cohens_d"))


def cliffs_delta(spark, d):
    out = R.rank_sum(_docs(spark, d), "n_chars", F.col("quality") == 1, F.col("quality") == 0)
    return out.select(r6("cliffs_delta").alias("cliffs_delta"))


def mann_whitney_u(spark, d):
    out = R.rank_sum(_docs(spark, d), "n_chars", F.col("quality") == 1, F.col("quality") == 0)
    return out.select("n_a", "n_b", "u", "ties")


def value_counts(spark, d):
    return G.value_counts(table(spark, d, "events"), "event_type")


def strat_folds(spark, d):
    rows = vectors(spark, d).select("entity_id", F.col("biosynth_class").alias("label"))
    return C.stratified_folds(rows).select("entity_id", "label", "fold")


def class_weights(spark, d):
    rows = vectors(spark, d).select("entity_id", F.col("biosynth_class").alias("label"))
    return C.class_weights(rows).select("label", "class_size", r6("weight").alias("weight"))


def common_classes(spark, d):
    docs = table(spark, d, "events").select(F.col("event_id").alias("entity_id"), F.col("user_id").cast("string").alias("label"))
    return C.common_classes(docs, 60).groupBy("label").agg(F.max("class_size").alias("class_size"))


def _guesses(spark, d):
    docs = _docs(spark, d)
    guess = F.when(F.col("n_chars") > G.threshold(docs, "n_chars", 0.5), "1").otherwise("0")
    return docs.select("entity_id", F.col("quality").cast("string").alias("label"), guess.alias("predicted"))


def confusion(spark, d):
    return C.confusion(_guesses(spark, d))


def confusion_matrix(spark, d):
    wide = C.confusion_matrix(_guesses(spark, d), ["0", "1"])
    return wide.select("label", F.col("0").alias("as_0"), F.col("1").alias("as_1"))


def class_report(spark, d):
    out = C.class_report(settle(_guesses(spark, d)))
    return out.select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def pool_weighted(spark, d):
    members = table(spark, d, "embeddings").select(
        F.col("label").alias("entity_id"), (F.col("vec_id") % 7 * 100).alias("aa_length"), "embedding"
    )
    pooled = V.pool_members(members)
    return V.cells_long(pooled, "embedding").select(
        "entity_id", (F.col("dim") + 1).alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value")
    )


def pool_mean(spark, d):
    members = table(spark, d, "embeddings").select(F.col("label").alias("entity_id"), F.lit(1).alias("aa_length"), "embedding")
    pooled = V.pool_members(members, "mean")
    return V.cells_long(pooled, "embedding").select(
        "entity_id", (F.col("dim") + 1).alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value")
    )


def scale_pop(spark, d):
    return _scaled(spark, d, center=False)


def scaler_vectors(spark, d):
    return _scaled(spark, d, center=True)


def _scaled(spark, d, center):
    rows = V.as_vectors(table(spark, d, "embeddings"), "embedding", entity="vec_id")
    scaled = V.Scaler.fit(rows, center).transform(rows)
    cells = V.cells_long(scaled.select("entity_id", vector_to_array("features").alias("z")), "z")
    return cells.select("entity_id", (F.col("dim") + 1).alias("dim"), r6("value").alias("scaled"))


def frame_limits(spark, d):
    rows = vectors(spark, d).select("entity_id", F.get("z", 0).alias("dim1"), F.get("z", 1).alias("dim2"))
    out = G.frame_limits(rows, ["dim1", "dim2"])
    return out.select("n_outside", *[r6(c).alias(c) for c in ("dim1_low", "dim1_high", "dim2_low", "dim2_high")])


def melt_metrics(spark, d):
    report = C.class_report(settle(_guesses(spark, d))).select(
        F.col("class").alias("representation"), F.col("f1").alias("macro_f1"), F.col("recall").alias("weighted_f1")
    )
    out = metrics_long(report)
    return out.select("representation", "metric", r6("f1").alias("f1"))


def union_groups(spark, d):
    docs = _docs(spark, d)
    held = docs.where("quality = 1").select("n_chars", F.lit("heldout").alias("group"))
    both = docs.where("quality = 0").select("n_chars", F.lit("control").alias("group")).unionByName(held)
    return both.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def leak_scan(spark, d):
    names = table(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 3 == 0, "class::").otherwise("dom::"), F.col("url")).alias("feature"))
    return names.where(leaks_class(F.col("feature")))


_SCORES = f"""WITH {VECTORS}, {loo_sql("v")},
scored AS (
  SELECT s.*, v.label::VARCHAR AS biosynth_class, o.label::VARCHAR AS neighbor_class,
         row_number() OVER (ORDER BY novelty DESC, s.entity_id) AS rank
  FROM s JOIN v USING (entity_id) JOIN v o ON o.entity_id = s.nearest_id
)"""
_HALVES = f"""WITH h AS (
  SELECT vec_id AS entity_id, label::VARCHAR AS biosynth_class, (embedding::DOUBLE[])[1:32] AS za, (embedding::DOUBLE[])[33:64] AS zb FROM embeddings
), {loo_sql("h", "za", "sa")}, {loo_sql("h", "zb", "sb")},
two AS (
  SELECT entity_id, biosynth_class, sa.novelty AS novelty_a, sb.novelty AS novelty_b
  FROM h JOIN sa USING (entity_id) JOIN sb USING (entity_id)
)"""
_QUERY = f"""WITH {VECTORS},
q AS (SELECT * FROM v WHERE entity_id % 5 = 0),
r AS (SELECT * FROM v WHERE entity_id % 5 <> 0),
qn AS (
  SELECT q.entity_id, r.entity_id AS other, list_distance(q.z, r.z) AS d,
         row_number() OVER (PARTITION BY q.entity_id ORDER BY list_distance(q.z, r.z), r.entity_id) AS rn
  FROM q, r
),
qs AS (
  SELECT entity_id, min(CASE WHEN rn = 1 THEN other END) AS nearest_id, avg(d) AS knn_mean_dist, min(d) AS nearest_dist
  FROM qn WHERE rn <= 5 GROUP BY entity_id
)"""
_HIGH_DOCS = f"""WITH {LABELLED},
h AS (SELECT *, n_chars >= (SELECT quantile_cont(n_chars, 0.9) FROM d) AS is_high FROM d),
t AS (SELECT count(*) FILTER (quality = 1 AND is_high) AS a_hit, count(*) FILTER (quality = 1 AND NOT is_high) AS a_rest,
             count(*) FILTER (quality = 0 AND is_high) AS b_hit, count(*) FILTER (quality = 0 AND NOT is_high) AS b_rest FROM h)"""
_HIGH_ALL = f"""WITH {DOCUMENTS}, h AS (SELECT *, n_chars >= (SELECT quantile_cont(n_chars, 0.9) FROM d) AS is_high FROM d)"""
_RANKED_DOCS = f"""WITH {LABELLED},
r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM d),
u AS (SELECT count(*) FILTER (quality = 1) AS n_a, count(*) FILTER (quality = 0) AS n_b,
             sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE AS u FROM r)"""
_GUESSES = f"""WITH {LABELLED},
g AS (SELECT quality::VARCHAR AS label, CASE WHEN n_chars > (SELECT quantile_cont(n_chars, 0.5) FROM d) THEN '1' ELSE '0' END AS predicted FROM d)"""
_REPORT = (
    _GUESSES
    + """,
names AS (SELECT label AS class FROM g UNION SELECT predicted FROM g),
per AS (
  SELECT class, count(*) FILTER (label = class) AS support,
    coalesce(count(*) FILTER (label = class AND predicted = class)::DOUBLE / nullif(count(*) FILTER (predicted = class), 0), 0) AS precision,
    coalesce(count(*) FILTER (label = class AND predicted = class)::DOUBLE / nullif(count(*) FILTER (label = class), 0), 0) AS recall,
    2.0::DOUBLE * count(*) FILTER (label = class AND predicted = class) / (count(*) FILTER (predicted = class) + count(*) FILTER (label = class)) AS f1
  FROM names, g GROUP BY class),
acc AS (SELECT avg((label = predicted)::INT) AS a, count(*) AS n FROM g),
rep AS (
  SELECT class, support, precision, recall, f1 FROM per UNION ALL
  SELECT 'accuracy', n, a, a, a FROM acc UNION ALL
  SELECT 'macro avg', sum(support)::BIGINT, avg(precision), avg(recall), avg(f1) FROM per UNION ALL
  SELECT 'weighted avg', sum(support)::BIGINT, sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support) FROM per)"""
)


def _spearman_sql(source: str, x: str, y: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by}, " if by else "PARTITION BY "
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
      SELECT {by + ', ' if by else ''}rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({tie}{x}) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({tie}{y}) - 1) / 2.0::DOUBLE AS ry
      FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {group}"""


_ORDERS = """WITH o AS (
  SELECT o_orderkey AS entity_id, o_orderpriority AS biosynth_class, nullif(count(l_orderkey), 0) AS n_genes,
         sum(l_quantity) AS total_aa_length, avg(l_quantity) AS mean_aa_length
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
)"""

QUERIES = {
    "knn_loo": (
        knn_loo,
        f"WITH {VECTORS}, {loo_sql('v')} SELECT entity_id, round(knn_mean_dist, 6) AS knn_mean_dist, round(knn_kth_dist, 6) AS knn_kth_dist FROM s",
    ),
    "nearest_neighbor": (
        nearest_neighbor,
        _SCORES + " SELECT entity_id, nearest_id, neighbor_class, round(nearest_dist, 6) AS nearest_dist FROM scored",
    ),
    "knn_query": (
        knn_query,
        _QUERY
        + " SELECT entity_id, nearest_id, round(knn_mean_dist, 6) AS knn_mean_dist, round(nearest_dist, 6) AS nearest_dist FROM qs",
    ),
    "novelty_percentile": (
        novelty_percentile,
        _QUERY
        + f""", {loo_sql('r', out='rs')}
        SELECT qs.entity_id, round((SELECT count(*) FROM rs WHERE rs.knn_mean_dist < qs.knn_mean_dist)::DOUBLE / (SELECT count(*) FROM rs), 6) AS novelty
        FROM qs""",
    ),
    "novelty_ranking": (
        novelty_ranking,
        _SCORES + " SELECT entity_id, rank, round(novelty, 6) AS novelty, nearest_id, neighbor_class FROM scored",
    ),
    "class_stats": (
        class_stats,
        _SCORES
        + """ SELECT biosynth_class, count(*) AS count, round(avg(novelty), 6) AS mean, round(quantile_cont(novelty, 0.5), 6) AS median,
        round(stddev_samp(novelty), 6) AS std FROM scored GROUP BY biosynth_class""",
    ),
    "high_novelty_share": (
        high_novelty_share,
        _SCORES
        + """ SELECT biosynth_class, round(avg((novelty >= (SELECT quantile_cont(novelty, 0.9) FROM scored))::INT), 6) AS share
        FROM scored GROUP BY biosynth_class""",
    ),
    "same_class_neighbor_rate": (
        same_class_neighbor_rate,
        _SCORES
        + """ SELECT round(avg((biosynth_class = neighbor_class)::INT), 6) AS rate FROM scored
        WHERE novelty >= (SELECT quantile_cont(novelty, 0.9) FROM scored)""",
    ),
    "size_outliers": (
        size_outliers,
        _ORDERS
        + """, e AS (SELECT *, row_number() OVER (ORDER BY mean_aa_length * n_genes DESC, entity_id) AS rank FROM o WHERE n_genes > 0)
        SELECT count(*) FILTER (n_genes > (SELECT quantile_cont(n_genes, 0.99) FROM e)) AS n_outliers FROM e WHERE rank <= 50""",
    ),
    "exact_quantiles": (
        exact_quantiles,
        "SELECT l_returnflag, "
        + ", ".join(
            f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}"
            for n, p in (("q01", 0.01), ("q50", 0.5), ("q90", 0.9), ("q99", 0.99))
        )
        + " FROM lineitem GROUP BY l_returnflag",
    ),
    "ordinal_rank01": (
        ordinal_rank01,
        """SELECT o_orderkey AS entity_id, round((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS rank01
        FROM orders""",
    ),
    "average_rank": (
        average_rank,
        """SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank
        FROM lineitem""",
    ),
    "strict_ecdf": (
        strict_ecdf,
        """WITH r AS (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT c_custkey, round((SELECT count(*) FROM r WHERE r.c_acctbal < q.c_acctbal)::DOUBLE / (SELECT count(*) FROM r), 6) AS percentile
        FROM customer q WHERE c_mktsegment <> 'BUILDING'""",
    ),
    "spearman_size": (spearman_size, f"{_ORDERS} {_spearman_sql('o', 'n_genes', 'total_aa_length')}"),
    "spearman_by_group": (
        spearman_by_group,
        f"{_ORDERS} {_spearman_sql('o', 'n_genes', 'mean_aa_length', 'biosynth_class')}",
    ),
    "jaccard_top_decile": (
        jaccard_top_decile,
        _HALVES
        + """, k AS (SELECT count(*) AS n, greatest(1, round_even(0.1::DOUBLE * count(*), 0)::BIGINT) AS n_top FROM two),
        f AS (SELECT row_number() OVER (ORDER BY novelty_a DESC, entity_id) <= n_top AS ta,
                     row_number() OVER (ORDER BY novelty_b DESC, entity_id) <= n_top AS tb FROM two, k)
        SELECT (SELECT n FROM k) AS n, count(*) FILTER (ta) AS n_top, count(*) FILTER (ta AND tb) AS n_both,
               round(count(*) FILTER (ta AND tb)::DOUBLE / count(*) FILTER (ta OR tb), 6) AS jaccard FROM f""",
    ),
    "disagreement_by_class": (
        disagreement_by_class,
        _HALVES
        + f""", rho AS ({_spearman_sql('two', 'novelty_a', 'novelty_b', 'biosynth_class')}),
        f AS (SELECT *, row_number() OVER (PARTITION BY biosynth_class ORDER BY novelty_a DESC, entity_id) <= k AS ta,
                     row_number() OVER (PARTITION BY biosynth_class ORDER BY novelty_b DESC, entity_id) <= k AS tb
              FROM (SELECT *, greatest(1, round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY biosynth_class), 0)::BIGINT) AS k FROM two)),
        m AS (SELECT biosynth_class, round(count(*) FILTER (ta AND tb)::DOUBLE / count(*) FILTER (ta OR tb), 6) AS top_jaccard,
                     round(avg(novelty_a), 6) AS mean_novelty_a, round(avg(novelty_b), 6) AS mean_novelty_b FROM f GROUP BY biosynth_class)
        SELECT biosynth_class, n, rho AS spearman, top_jaccard, mean_novelty_a, mean_novelty_b FROM rho JOIN m USING (biosynth_class) WHERE n >= 10""",
    ),
    "contingency": (contingency, f"{_HIGH_DOCS} SELECT * FROM t"),
    "odds_ratio": (
        odds_ratio,
        f"""{_HIGH_DOCS}, x AS (SELECT *, CASE WHEN least(a_hit, a_rest, b_hit, b_rest) = 0 THEN 0.5::DOUBLE ELSE 0 END AS h FROM t),
        y AS (SELECT *, ((a_hit + h) / (a_rest + h)) / ((b_hit + h) / (b_rest + h)) AS ratio,
                     sqrt(1 / (a_hit + h) + 1 / (a_rest + h) + 1 / (b_hit + h) + 1 / (b_rest + h)) AS se FROM x)
        SELECT round(ratio, 6) AS odds_ratio, round(exp(ln(ratio) - 1.959963984540054::DOUBLE * se), 6) AS ci_low,
               round(exp(ln(ratio) + 1.959963984540054::DOUBLE * se), 6) AS ci_high,
               round((a_hit::DOUBLE / (a_hit + a_rest)) / nullif(b_hit::DOUBLE / (b_hit + b_rest), 0), 6) AS enrichment_ratio FROM y""",
    ),
    "enrichment_by_group": (
        enrichment_by_group,
        f"""{_HIGH_ALL}, c AS (SELECT source, count(*) FILTER (is_high) AS n_top, count(*) AS n_total FROM h GROUP BY source)
        SELECT source, n_top, n_total, round((n_top::DOUBLE / (SELECT sum(n_top) FROM c)) / (n_total::DOUBLE / (SELECT sum(n_total) FROM c)), 6) AS enrichment
        FROM c WHERE n_top >= 3 AND n_total >= 5
        ORDER BY (n_top::DOUBLE / (SELECT sum(n_top) FROM c)) / (n_total::DOUBLE / (SELECT sum(n_total) FROM c)) DESC, n_top DESC, source LIMIT 12""",
    ),
    "group_summaries": (
        group_summaries,
        f"""{_HIGH_ALL} SELECT CASE WHEN lang IN ('fr', 'es') THEN 'Romance' WHEN lang IN ('de', 'en') THEN 'Germanic' ELSE 'Other' END AS "group",
        count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(avg(is_high::INT), 6) AS share_high
        FROM h GROUP BY 1""",
    ),
    "cohens_d": (
        cohens_d,
        f"""WITH {LABELLED}, m AS (SELECT quality, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM d GROUP BY quality)
        SELECT a.n AS n_a, b.n AS n_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d
        FROM m a, m b WHERE a.quality = 1 AND b.quality = 0""",
    ),
    "cliffs_delta": (
        cliffs_delta,
        f"{_RANKED_DOCS} SELECT round(2 * u / (n_a * n_b) - 1, 6) AS cliffs_delta FROM u",
    ),
    "mann_whitney_u": (
        mann_whitney_u,
        f"""{_RANKED_DOCS} SELECT n_a, n_b, u, (SELECT sum(t * t * t - t)::DOUBLE FROM (SELECT count(*) AS t FROM d GROUP BY n_chars)) AS ties FROM u""",
    ),
    "value_counts": (value_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "strat_folds": (
        strat_folds,
        """SELECT vec_id AS entity_id, label::VARCHAR AS label,
        ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5)::INT AS fold FROM embeddings""",
    ),
    "class_weights": (
        class_weights,
        """WITH s AS (SELECT label::VARCHAR AS label, count(*) AS class_size FROM embeddings GROUP BY label)
        SELECT label, class_size, round((SELECT sum(class_size) FROM s)::DOUBLE / ((SELECT count(*) FROM s) * class_size), 6) AS weight FROM s""",
    ),
    "common_classes": (
        common_classes,
        "SELECT user_id::VARCHAR AS label, count(*) AS class_size FROM events GROUP BY user_id HAVING count(*) >= 60",
    ),
    "confusion": (confusion, f"{_GUESSES} SELECT label, predicted, count(*) AS n FROM g GROUP BY ALL"),
    "confusion_matrix": (
        confusion_matrix,
        f"{_GUESSES} SELECT label, count(*) FILTER (predicted = '0') AS as_0, count(*) FILTER (predicted = '1') AS as_1 FROM g GROUP BY label",
    ),
    "class_report": (
        class_report,
        f"{_REPORT} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep",
    ),
    "melt_metrics": (
        melt_metrics,
        f"""{_REPORT} SELECT class AS representation, 'macro_f1' AS metric, round(f1, 6) AS f1 FROM rep UNION ALL
        SELECT class, 'weighted_f1', round(recall, 6) FROM rep""",
    ),
    "pool_weighted": (
        pool_weighted,
        """WITH c AS (SELECT label AS entity_id, greatest((vec_id % 7) * 100, 1)::DOUBLE AS w, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT entity_id, dim::INT AS dim, round(((sum(w * x) / sum(w))::FLOAT)::DOUBLE, 5) AS value FROM c GROUP BY ALL""",
    ),
    "pool_mean": (
        pool_mean,
        """WITH c AS (SELECT label AS entity_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT entity_id, dim::INT AS dim, round((avg(x)::FLOAT)::DOUBLE, 5) AS value FROM c GROUP BY ALL""",
    ),
    "scale_pop": (
        scale_pop,
        """WITH c AS (SELECT vec_id AS entity_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT dim, stddev_pop(x) AS sd FROM c GROUP BY dim)
        SELECT entity_id, dim::INT AS dim, round(x / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS scaled FROM c JOIN s USING (dim)""",
    ),
    "scaler_vectors": (
        scaler_vectors,
        """WITH c AS (SELECT vec_id AS entity_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
        s AS (SELECT dim, stddev_pop(x) AS sd, avg(x) AS m FROM c GROUP BY dim)
        SELECT entity_id, dim::INT AS dim, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS scaled FROM c JOIN s USING (dim)""",
    ),
    "frame_limits": (
        frame_limits,
        f"""WITH {VECTORS}, p AS (SELECT entity_id, z[1] AS x, z[2] AS y FROM v),
        q AS (SELECT quantile_cont(x, 0.01) AS xl, quantile_cont(x, 0.99) AS xh, quantile_cont(y, 0.01) AS yl, quantile_cont(y, 0.99) AS yh FROM p),
        l AS (SELECT xl - 0.15 * greatest(xh - xl, 1e-9) AS a, xh + 0.15 * greatest(xh - xl, 1e-9) AS b,
                     yl - 0.15 * greatest(yh - yl, 1e-9) AS c, yh + 0.15 * greatest(yh - yl, 1e-9) AS d FROM q)
        SELECT count(*) FILTER (x < a OR x > b OR y < c OR y > d) AS n_outside, round(any_value(a), 6) AS dim1_low, round(any_value(b), 6) AS dim1_high,
               round(any_value(c), 6) AS dim2_low, round(any_value(d), 6) AS dim2_high FROM p, l""",
    ),
    "union_groups": (
        union_groups,
        f"WITH {LABELLED} SELECT CASE WHEN quality = 1 THEN 'heldout' ELSE 'control' END AS \"group\", count(*) AS n, sum(n_chars)::BIGINT AS chars FROM d GROUP BY 1",
    ),
    "leak_scan": (
        leak_scan,
        """SELECT 'class::' || url AS feature FROM pages WHERE page_id % 3 = 0""",
    ),
}
