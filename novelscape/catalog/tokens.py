"""Token queries on baskets, activity and dialogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from novelscape.catalog.bind import (
    BASKET,
    BASKET_ORDER,
    activity,
    basket,
    documents,
    labelled,
    orders,
    r6,
    table,
    word_lists,
    words,
    WORDS,
)
from novelscape.functions.hashing import bucket
from novelscape.operators import features as X
from novelscape.operators import tokens as T
from novelscape.plans.curate import merge_entities
from novelscape.plans.temporal import is_held_out, train_split

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _ordered(spark, d):
    return T.ordered_tokens(basket(spark, d), BASKET_ORDER)


def token_counts(spark, d):
    return T.token_counts(basket(spark, d))


def token_doc_frequency(spark, d):
    shares = T.document_share(T.token_counts(words(spark, d))).where("n_entities >= 3")
    return shares.select("token", "n_entities", r6("share").alias("share"))


def token_pivot(spark, d):
    tokens = T.present(basket(spark, d)).select("entity_id", "token", F.lit(1).alias("n"))
    wide = T.token_pivot(tokens, orders(spark, d), TYPES)
    return wide.select("entity_id", *[F.col(t).alias(t.lower()) for t in TYPES])


def hash_buckets(spark, d):
    parts = table(spark, d, "part").select("p_name").distinct()
    return parts.select("p_name", bucket(F.col("p_name"), 256).alias("b256"), bucket(F.col("p_name"), 100).alias("b100"))


def hashed_unigrams(spark, d):
    grams = T.gram_buckets(_ordered(spark, d)).where("gram = 'uni'")
    return grams.groupBy("entity_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def hashed_bigrams(spark, d):
    grams = T.gram_buckets(_ordered(spark, d)).where("gram = 'bi'")
    return grams.groupBy("entity_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def arch_hash(spark, d):
    return T.hashed_counts(T.ordered_tokens(words(spark, d)))


def bigram_counts(spark, d):
    return T.bigram_counts(T.ordered_tokens(activity(spark, d)))


def basket_bigrams(spark, d):
    return T.bigram_counts(_ordered(spark, d))


def ordered_sequence(spark, d):
    return _ordered(spark, d).select("entity_id", "pos", "token")


def dialog_sequence(spark, d):
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("entity_id"), F.col("turn").alias("gene_order"), F.xxhash64("role", "text").alias("token_pos"), F.col("role").alias("token")
    )
    return T.bigram_counts(T.ordered_tokens(turns))


def running_gene_order(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return T.running_flag(events, F.col("event_type") == "click", "user_id", ["ts", "event_id"]).select(
        "event_id", "gene_order"
    )


def running_token_number(spark, d):
    events = activity(spark, d)
    return T.ordered_tokens(events).groupBy("entity_id").agg(F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def entity_summary(spark, d):
    meta = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("entity_id"),
        F.col("o_orderpriority").alias("biosynth_class"),
        F.lit(None).cast("string").alias("organism"),
        F.lit(1).alias("n_genes_json"),
    )
    lines = table(spark, d, "lineitem")
    sizes = lines.groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.sum("l_quantity").cast("long").alias("total_aa_length"),
        F.avg("l_quantity").alias("mean_aa_length"),
    )
    counts = T.token_counts(basket(spark, d))
    lists = T.distinct_list(counts, 80).withColumnRenamed("token_list", "types")
    merged = merge_entities(meta, sizes.join(lists, "entity_id", "left"))
    return merged.select(
        "entity_id",
        "biosynth_class",
        "organism",
        "n_genes",
        "total_aa_length",
        r6("mean_aa_length").alias("mean_aa_length"),
        F.array_join("types", ";").alias("types"),
    )


def size_features(spark, d):
    cells = X.size_cells(orders(spark, d))
    return cells.select("entity_id", "feature", r6("value").alias("value"))


def feature_cells(spark, d):
    entities = orders(spark, d).where("n_genes > 0").drop("mean_aa_length")
    cells, counts = X.cells_of(entities, basket(spark, d).drop("l_partkey", "l_suppkey"))
    frequent = T.frequent_tokens(counts).select(F.concat(F.lit("dom::"), "token").alias("feature"))
    keep = cells.where(~F.startswith("feature", F.lit("dom::"))).unionByName(
        cells.join(frequent, "feature", "left_semi")
    )
    return keep.groupBy("feature").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("value").alias("total"))


def first_row_dedup(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return T.first_rows(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


def top_n_per_group(spark, d):
    counts = T.distinct_tokens(word_lists(spark, d))
    shares = T.document_frequency(counts)
    return T.top_per_group(counts.join(shares, "token"), "entity_id", ["n_entities", "token"], 6)


def member_cap(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return T.top_per_group(lines, "l_suppkey", [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"], 80)


def aligned_inner(spark, d):
    left = documents(spark, d).select("entity_id", "lang", "n_chars")
    return left.join(labelled(spark, d).select("entity_id", "quality"), "entity_id")


def semi_members(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"))
    return orders(spark, d).select("entity_id", "biosynth_class").join(lines, "entity_id", "left_semi")


def anti_majors(spark, d):
    minor = ~F.col("biosynth_class").isin("1-URGENT", "2-HIGH")
    return orders(spark, d).where(minor).select("entity_id", "biosynth_class")


def temporal_split(spark, d):
    dated = orders(spark, d).withColumn("date_added", F.when(F.col("status") != "P", F.col("date_added")))
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"))
    return train_split(dated, members, "1997-06-01")


def held_out_flag(spark, d):
    return orders(spark, d).select("entity_id", is_held_out(F.col("date_added"), "1997-06-01").alias("is_held"))


_PARTS = [f"('0x' || substr(md5(p_name), {i}, 8))::BIGINT" for i in (1, 9, 17, 25)]
_FOLDED = f"((({_PARTS[0]} % 100 * 96 + {_PARTS[1]}) % 100 * 96 + {_PARTS[2]}) % 100 * 96 + {_PARTS[3]}) % 100"
_BUCKET = "('0x' || right(md5({0}), 2))::INT"
_GRAMS = f"""
seq AS (
  SELECT entity_id, token, lead(token) OVER (PARTITION BY entity_id ORDER BY gene_order, l_partkey, l_suppkey) AS next_token
  FROM basket
),
uni AS (SELECT entity_id, {_BUCKET.format("'uni::' || token")} AS bucket FROM seq),
bi AS (SELECT entity_id, {_BUCKET.format("'bi::' || token || '::' || next_token")} AS bucket FROM seq WHERE next_token IS NOT NULL)
"""

QUERIES = {
    "token_counts": (
        token_counts,
        f"WITH {BASKET} SELECT entity_id, token, count(*) AS n FROM basket GROUP BY ALL",
    ),
    "token_doc_frequency": (
        token_doc_frequency,
        f"""WITH {WORDS}
        SELECT token, count(DISTINCT entity_id) AS n_entities,
               round(count(DISTINCT entity_id)::DOUBLE / (SELECT count(DISTINCT entity_id) FROM words), 6) AS share
        FROM words GROUP BY token HAVING count(DISTINCT entity_id) >= 3""",
    ),
    "token_pivot": (
        token_pivot,
        f"WITH {BASKET} SELECT o_orderkey AS entity_id, "
        + ", ".join(f"count(*) FILTER (token = '{t}') AS {t.lower()}" for t in TYPES)
        + " FROM orders LEFT JOIN basket ON o_orderkey = entity_id GROUP BY o_orderkey",
    ),
    "hash_buckets": (
        hash_buckets,
        f"""SELECT DISTINCT p_name, ('0x' || right(md5(p_name), 2))::INT AS b256, ({_FOLDED})::INT AS b100 FROM part""",
    ),
    "hashed_unigrams": (
        hashed_unigrams,
        f"WITH {BASKET}, {_GRAMS} SELECT entity_id, bucket, count(*) AS n FROM uni GROUP BY ALL",
    ),
    "hashed_bigrams": (
        hashed_bigrams,
        f"WITH {BASKET}, {_GRAMS} SELECT entity_id, bucket, count(*) AS n FROM bi GROUP BY ALL",
    ),
    "arch_hash": (
        arch_hash,
        f"""WITH {WORDS},
        seq AS (SELECT entity_id, token, lead(token) OVER (PARTITION BY entity_id ORDER BY pos) AS next_token FROM words),
        grams AS (
          SELECT entity_id, {_BUCKET.format("'uni::' || token")} AS bucket FROM seq UNION ALL
          SELECT entity_id, {_BUCKET.format("'bi::' || token || '::' || next_token")} FROM seq WHERE next_token IS NOT NULL)
        SELECT entity_id, bucket, count(*) AS n FROM grams GROUP BY ALL""",
    ),
    "bigram_counts": (
        bigram_counts,
        """WITH seq AS (SELECT event_type AS token, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_token FROM events)
        SELECT token, next_token, count(*) AS n FROM seq WHERE next_token IS NOT NULL GROUP BY ALL""",
    ),
    "basket_bigrams": (
        basket_bigrams,
        f"WITH {BASKET}, {_GRAMS} SELECT token, next_token, count(*) AS n FROM seq WHERE next_token IS NOT NULL GROUP BY ALL",
    ),
    "ordered_sequence": (
        ordered_sequence,
        f"""WITH {BASKET} SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY gene_order, l_partkey, l_suppkey) AS pos, token
        FROM basket""",
    ),
    "dialog_sequence": (
        dialog_sequence,
        """WITH seq AS (SELECT role AS token, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_token FROM conversations)
        SELECT token, next_token, count(*) AS n FROM seq WHERE next_token IS NOT NULL GROUP BY ALL""",
    ),
    "running_gene_order": (
        running_gene_order,
        """SELECT event_id, (sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING))::BIGINT AS gene_order FROM events""",
    ),
    "running_token_number": (
        running_token_number,
        """SELECT user_id AS entity_id, max(rn) AS last_pos, count(*) AS n FROM (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY user_id""",
    ),
    "entity_summary": (
        entity_summary,
        f"""WITH {BASKET},
        meta AS (SELECT o_orderkey AS entity_id, o_orderpriority AS biosynth_class FROM orders),
        sizes AS (SELECT l_orderkey AS entity_id, count(*) AS n_genes, sum(l_quantity)::BIGINT AS total_aa_length,
                         round(avg(l_quantity), 6) AS mean_aa_length FROM lineitem GROUP BY l_orderkey),
        lists AS (SELECT entity_id, string_agg(token, ';' ORDER BY token) AS types FROM (SELECT DISTINCT entity_id, token FROM basket) GROUP BY entity_id)
        SELECT entity_id, coalesce(biosynth_class, 'other') AS biosynth_class, 'unknown' AS organism,
               coalesce(n_genes, 1)::BIGINT AS n_genes, total_aa_length, mean_aa_length, types
        FROM meta FULL JOIN (sizes LEFT JOIN lists USING (entity_id)) USING (entity_id)""",
    ),
    "size_features": (
        size_features,
        """WITH e AS (
          SELECT o_orderkey AS entity_id, count(l_orderkey)::DOUBLE AS n_genes, sum(l_quantity)::DOUBLE AS total, avg(l_quantity)::DOUBLE AS mean
          FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
        c AS (
          SELECT entity_id, 'size::n_genes' AS feature, n_genes AS value FROM e UNION ALL
          SELECT entity_id, 'size::cluster_nt_length', 0 FROM e UNION ALL
          SELECT entity_id, 'size::mean_aa_length', mean FROM e UNION ALL
          SELECT entity_id, 'size::total_aa_length', total FROM e UNION ALL
          SELECT entity_id, 'size::n_domain_annotations', n_genes FROM e UNION ALL
          SELECT entity_id, 'size::n_compounds', 0 FROM e)
        SELECT entity_id, feature, round(coalesce(value, 0.0), 6) AS value FROM c""",
    ),
    "feature_cells": (
        feature_cells,
        f"""WITH {BASKET}, {_GRAMS},
        cnt AS (SELECT entity_id, token, count(*) AS n FROM basket GROUP BY ALL),
        freq AS (SELECT token FROM cnt GROUP BY token HAVING count(*) >= 3),
        h AS (SELECT entity_id, bucket, count(*) AS n FROM (SELECT * FROM uni UNION ALL SELECT * FROM bi) GROUP BY ALL),
        e AS (SELECT l_orderkey AS entity_id, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey),
        c AS (
          SELECT 'dom::' || token AS feature, n::DOUBLE AS value FROM cnt SEMI JOIN freq USING (token) SEMI JOIN e USING (entity_id) UNION ALL
          SELECT 'arch_hash::' || bucket, n::DOUBLE FROM h SEMI JOIN e USING (entity_id) UNION ALL
          SELECT 'size::n_genes', n FROM e UNION ALL SELECT 'size::n_domain_annotations', n FROM e UNION ALL
          SELECT 'size::total_aa_length', total FROM e UNION ALL SELECT 'size::mean_aa_length', 0 FROM e UNION ALL
          SELECT 'size::cluster_nt_length', 0 FROM e UNION ALL SELECT 'size::n_compounds', 0 FROM e)
        SELECT feature, count(*) AS n_entities, sum(value) AS total FROM c GROUP BY feature""",
    ),
    "first_row_dedup": (
        first_row_dedup,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""",
    ),
    "top_n_per_group": (
        top_n_per_group,
        f"""WITH {WORDS}, c AS (SELECT DISTINCT entity_id, token FROM words),
        f AS (SELECT token, count(*) AS n_entities FROM c GROUP BY token)
        SELECT token, entity_id, n_entities FROM c JOIN f USING (token)
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_entities, token) <= 6""",
    ),
    "member_cap": (
        member_cap,
        """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) <= 80""",
    ),
    "aligned_inner": (
        aligned_inner,
        "SELECT doc_id AS entity_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)",
    ),
    "semi_members": (
        semi_members,
        """SELECT o_orderkey AS entity_id, o_orderpriority AS biosynth_class FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    ),
    "anti_majors": (
        anti_majors,
        "SELECT o_orderkey AS entity_id, o_orderpriority AS biosynth_class FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    ),
    "temporal_split": (
        temporal_split,
        """SELECT o_orderkey AS entity_id,
        coalesce(CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END, '9999') < '1997-06-01' AS is_train
        FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    ),
    "held_out_flag": (
        held_out_flag,
        "SELECT o_orderkey AS entity_id, strftime(o_orderdate, '%Y-%m-%d') >= '1997-06-01' AS is_held FROM orders",
    ),
}
