"""Queries of the operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.llm import ann, collocations, common, decontaminate, language, line_dedup, lsh_forest, packing, quality, simhash, suffix_tree, token_ids, toxicity, turn_trie


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    out = common.scratch(spark)
    token_ids.write_ids(common.table(spark, folder, "documents"), out, word_vocabulary())
    return token_ids.read_ids(spark, out, with_ids=False)


def line_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.with_kept_text(docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


LINE_DUPLICATES_SQL = r"""
WITH split AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), flagged AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND doc_id > first AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, folder, "documents"), word_vocabulary())


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = common.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def language_model(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.scored(common.table(spark, folder, "documents"))


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.scored(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    return found.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "offending"
    )


def languages(spark: SparkSession, folder: str) -> DataFrame:
    found = language.predicted(common.table(spark, folder, "documents"))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def site() -> tuple[Column, Column]:
    """Documents have no address: their source is the host, its language section the path."""
    return F.col("source"), F.col("lang")


def document_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    return quality.scored(docs, labels, *site()).drop("same")


def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.findings(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations begin with the first turns of the conversation whose number is theirs rounded down to hundreds."""
    talks = common.table(spark, folder, "conversations")
    turns = common.stored(turn_trie.numbered(talks))
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    members = lengths.select("conv_id", base.alias("base"), h.alias("h"))
    members = members.join(lengths.select(F.col("conv_id").alias("base"), "length"), "base", "left")
    members = common.stored(members.withColumn("taken", F.least("h", F.coalesce("length", F.lit(0).cast("long")))))
    first = turns.where("place <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    first = members.join(first, "base").where("place <= h").select("conv_id", "place", "id", "size")
    own = turns.join(members, "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id", "size")
    return turn_trie.nodes(first.unionByName(own), members)


def alike_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(common.table(spark, folder, "documents"))


#: DuckDB has no crc32: the bits of the number's digits are shifted through.
CONVERSATIONS_SQL = r"""
WITH numbered AS (
  SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, length(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), members AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, max(place) AS length, xor(list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h
  FROM numbered GROUP BY conv_id
), rebuilt AS (
  SELECT m.conv_id, n.place, id, size FROM members AS m JOIN numbered AS n ON n.conv_id = m.base AND n.place <= m.h
  UNION ALL
  SELECT m.conv_id, n.place - m.h + least(m.h, coalesce(b.length, 0)), id, size FROM members AS m JOIN numbered AS n ON n.conv_id = m.conv_id AND n.place > m.h
    LEFT JOIN members AS b ON b.conv_id = m.base
), whole AS (
  SELECT conv_id, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes FROM members LEFT JOIN (
    SELECT conv_id, list(id ORDER BY place) AS ids, list(size ORDER BY place) AS sizes FROM rebuilt GROUP BY conv_id) USING (conv_id)
), nodes AS (
  SELECT ids[1 : d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN sizes[d] ELSE 0 END) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ids) = d), '') AS ends
  FROM whole, range(0, len(ids) + 1) AS r(d) GROUP BY ALL
), children AS (
  SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), sums AS (
  SELECT path[1 : d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM told, range(0, depth + 1) AS r(d) GROUP BY ALL
)
SELECT told.conv_id, told.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, told.n_convs, told.n_children::BIGINT AS n_children, n_leaves,
  saved::BIGINT AS saved_tokens, sha256(told.ends) AS ends_sha256
FROM told JOIN sums USING (path) LEFT JOIN nodes AS above ON above.path = told.path[1 : told.depth - 1] AND told.depth > 0
"""


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(common.table(spark, folder, "documents"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), counted AS (
  SELECT lang, m, w[i : i + m - 1] AS w, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
  FROM split, range(1, 6) AS s(m), range(1, len(w) - m + 2) AS t(i) GROUP BY ALL HAVING count(*) >= 100
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS most
  FROM counted, range(2, m) AS s(j), range(1, m - j + 2) AS t(i) GROUP BY ALL
), kept AS (
  SELECT counted.* FROM counted LEFT JOIN inner_phrases USING (lang, phrase) WHERE m > 1 AND coalesce(100 * most < 100 * a, true)
), cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, x.a AS l, y.a AS r, n, k, ((1000::HUGEINT * kept.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM kept, range(1, m) AS s(k), counted AS x, counted AS y, totals
  WHERE x.lang = kept.lang AND y.lang = kept.lang AND totals.lang = kept.lang AND x.m = k AND y.m = kept.m - k
    AND x.phrase = array_to_string(kept.w[1 : k], ' ') AND y.phrase = array_to_string(kept.w[k + 1 :], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_token_output": (token_output, None),
    "op2_line_dedup": (line_duplicates, LINE_DUPLICATES_SQL),
    "op3_neighbors": (nearest_vectors, None),
    "op4_suffix_tree": (language_model, None),
    "op5_toxicity": (toxic_documents, None),
    "op6_language": (languages, None),
    "op7_packing": (packed_sequences, None),
    "op8_decontaminate": (benchmark_passages, None),
    "op9_simhash": (near_duplicates, None),
    "op10_quality": (document_quality, None),
    "op11_turn_trie": (conversation_trie, CONVERSATIONS_SQL),
    "op12_lsh_forest": (alike_documents, None),
    "op13_collocations": (phrase_collocations, COLLOCATIONS_SQL),
}
