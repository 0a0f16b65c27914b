"""Parsing and clean-up queries; record files are derived from the documents by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from novelscape.catalog.bind import WORDS, documents, r6, table, word_lists
from novelscape.functions import text as S
from novelscape.functions.classes import coarsen_classes, product_class
from novelscape.operators.features import predicted_sizes
from novelscape.operators.tokens import ENTITY, distinct_tokens
from novelscape.plans.enrichment import rarest_tokens
from novelscape.plans.members import prepare_members
from novelscape.plans.novelty import predicted_entities
from novelscape.sources import annotated, genbank, records

# Rules in the form of the token rules, for words that occur in the documents.
WORD_ALIASES = (("the", "NRPS"), ("tion", "PKS"), ("eau", "terpene"), ("sch", "RiPP"), ("and", "other"))
LINE_RULES = (
    (r"the|and", "Determiner"),
    (r"eau|oi", "French"),
    (r"sch|ung", "German"),
    (r"tion", "Noun"),
    (r"[0-9]", "Number"),
)
NAMES = r"(?:tion[a-z]*|eau\s+[a-z]+)"


def _lines(spark, d):
    return documents(spark, d).select("entity_id", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))


def class_coarsen(spark, d):
    found = coarsen_classes(F.split("text", r"\s+"), WORD_ALIASES)
    return documents(spark, d).select("entity_id", found.alias("biosynth_class"))


def product_classes(spark, d):
    kinds = ("NRPS-like", "T1PKS", "Terpene", "lanthipeptide", "saccharide", "unknown")
    first = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6).cast("int"))
    second = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_size") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", product_class(F.array(first, second)).alias("predicted_class"))


def regex_tokens(spark, d):
    hits = S.product_tokens(F.col("line"), LINE_RULES, NAMES)
    rows = _lines(spark, d).select("entity_id", F.explode(hits).alias("token"))
    return rows.groupBy("entity_id", "token").agg(F.count(F.lit(1)).alias("n"))


def label_hits(spark, d):
    labels = F.array(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.col("url"))
    rows = table(spark, d, "pages").select("page_id", F.explode(S.label_tokens(labels, r"(?:[a-z]+tion|page=[0-9]+)")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def json_field_extract(spark, d):
    events = table(spark, d, "events").withColumn("record", F.try_parse_json("props"))
    return events.select(
        "event_id",
        F.try_variant_get("record", "$.k", "bigint").alias("k"),
        F.try_variant_get("record", "$.missing", "string").alias("missing"),
    )


def id_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", S.clean_id(F.col("url")).alias("clean_id"))


def accession(spark, d):
    return table(spark, d, "pages").select("page_id", S.accession(F.col("url"), r"([0-9]+)").alias("accession"))


def genus(spark, d):
    return documents(spark, d).select("entity_id", S.first_word(F.col("text")).alias("genus"))


def number_default(spark, d):
    raw = F.regexp_extract("url", r"page=(\w+)", 1)
    return table(spark, d, "pages").select("page_id", S.number_or(raw, -1.0).alias("value"))


def sequence_clean(spark, d):
    cleaned = S.clean_sequence(F.col("text"))
    return documents(spark, d).select(
        "entity_id", F.length(cleaned).alias("n_letters"), F.md5(S.cut_sequence(cleaned)).alias("digest")
    ).where("n_letters >= 10")


def prepared_members(spark, d):
    members = _lines(spark, d).select("entity_id", F.col("at").alias("member_id"), F.col("line").alias("sequence"))
    return prepare_members(members).select("entity_id", "member_id", "aa_length", F.md5("sequence").alias("digest"))


def representation_names(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("org/esm2_"), "p_name", F.lit("_UR50D")).alias("model"), "p_type")
    return parts.select(S.representation_label(F.col("model"), F.lower("p_type")).alias("label")).distinct()


def predicted_size_features(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.lit("lines").alias("genome"),
        F.col("l_orderkey").alias("bgc_id"),
        F.col("l_returnflag").alias("predicted_class"),
        F.col("l_linenumber").alias("gene_order"),
        F.col("l_linestatus").alias("domain_id"),
        (F.col("l_linenumber") + 1).alias("n_genes"),
    )
    rows = predicted_entities(lines)
    return rows.select("bgc_id", "predicted_class", *predicted_sizes(F.lit(0), F.lit(0)))


def rare_tokens(spark, d):
    ids = documents(spark, d).where("lang = 'fr'").select(ENTITY)
    found = rarest_tokens(distinct_tokens(word_lists(spark, d)), ids, distinct=True)
    return found.select(ENTITY, F.array_join(F.transform("rarest_tokens", lambda x: x["token"]), ";").alias("rarest"))


def _record_documents(spark, d):
    """Every document as the text of a cluster record."""
    lines = F.split("text", "\n")
    date = F.concat(F.lit("20"), F.lpad((F.col("entity_id") % 30).cast("string"), 2, "0"), F.lit("-01-15"))
    body = F.struct(
        F.concat(F.lit("BGC"), F.lpad(F.col("entity_id").cast("string"), 7, "0"), F.lit(".3")).alias("accession"),
        F.struct(
            F.array(F.struct(F.col("lang").alias("class")), F.struct(F.lit("").alias("class"))).alias("classes")
        ).alias("biosynthesis"),
        F.struct(F.col("source").alias("name"), F.col("entity_id").alias("ncbiTaxId")).alias("taxonomy"),
        F.transform(lines, lambda x: F.struct(F.left(x, F.lit(12)).alias("name"))).alias("compounds"),
        F.struct(F.transform(lines, lambda x: F.struct(F.length(x).alias("id"))).alias("annotations")).alias("genes"),
        F.struct(
            F.array(
                F.struct(date.alias("date"), F.array(F.struct(F.lit("2031-02-03").alias("date"))).alias("entries")),
                F.struct(F.lit("no date").alias("date"), F.array().cast("array<struct<date:string>>").alias("entries")),
            ).alias("releases")
        ).alias("changelog"),
    )
    content = F.when(F.col("entity_id") % 50 == 49, "{broken").otherwise(F.to_json(body))
    return documents(spark, d).select(F.concat(F.lit("/x/BGC_"), "entity_id", F.lit(".json")).alias("path"), content.alias("content"))


def record_fields(spark, d):
    rows = records.record_rows(_record_documents(spark, d))
    return rows.select(
        "entity_id",
        F.array_join("biosynth_classes_raw", ";").alias("classes"),
        "biosynth_class",
        "organism",
        "ncbi_tax_id",
        "n_compounds",
        F.array_join("compounds", ";").alias("compounds"),
        "n_genes_json",
        "date_added",
        "date_latest",
    )


def record_rejects(spark, d):
    return records.rejects(_record_documents(spark, d))


def _region_documents(spark, d):
    """Every document as an annotated-region file: a line is a gene, its words are the domains."""
    genes = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.left(x, F.lit(100)).alias("product"), F.split(x, r"\s+").alias("domains")),
    )
    area = F.struct(F.array("lang", "source").alias("products"), genes.alias("cds"))
    bare = F.struct(F.array("lang", "source").alias("products"), F.slice(genes, 1, 0).alias("cds"))
    body = F.struct(F.array(F.struct(F.concat(F.lit("doc "), "entity_id").alias("name"), F.array(area, bare).alias("areas"))).alias("records"))
    return documents(spark, d).select(F.concat(F.lit("/x/g"), "entity_id", F.lit(".json")).alias("path"), F.to_json(body).alias("content"))


def region_tokens(spark, d):
    return annotated.predicted_tokens(_region_documents(spark, d), "docs")


def _genbank_records(spark, d):
    """Every document as a GenBank record: a line is a coding sequence with product and translation."""
    pad = "\n" + " " * 21
    feature = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.lit("     CDS             complement("),
            (i * 300 + 1).cast("string"),
            F.lit(".."),
            (i * 300 + 90).cast("string"),
            F.lit(")" + pad + '/locus_tag="g'),
            i.cast("string"),
            F.lit('"' + pad + '/product="'),
            F.replace(x, F.lit('"'), F.lit('""')),
            F.lit('"'),
            F.when(
                F.length(x) > 40,
                F.concat(F.lit(pad + '/translation="'), F.regexp_replace(S.clean_sequence(x), "(.{58})", "$1" + pad), F.lit('"')),
            ).otherwise(""),
        ),
    )
    name = F.concat(F.lit("DOC"), "entity_id")
    content = F.concat(
        F.lit("LOCUS       "),
        name,
        F.lit(" "),
        F.col("n_chars").cast("string"),
        F.lit(" bp    DNA     linear\nACCESSION   "),
        name,
        F.lit("\nVERSION     "),
        name,
        F.lit(".1\nFEATURES             Location/Qualifiers\n     region          1..9"),
        F.lit(pad + '/product="'),
        "lang",
        F.lit('"\n'),
        F.array_join(feature, "\n"),
        F.lit("\nORIGIN\n        1 "),
        F.lower(S.clean_sequence(F.col("text"))),
        F.lit("\n"),
    )
    return documents(spark, d).select(
        F.concat(F.lit("/x/BGC"), F.lpad(F.col("entity_id").cast("string"), 7, "0"), F.lit(".gbk")).alias("path"),
        F.lit(1).cast("long").alias("record_no"),
        content.alias("content"),
    )


def genbank_summary(spark, d):
    summary, _, _ = genbank.curated_tables(_genbank_records(spark, d))
    return summary.select(
        "entity_id", "n_genes", "cluster_nt_length", r6("mean_aa_length").alias("mean_aa_length"), "total_aa_length"
    )


def genbank_members(spark, d):
    _, _, members = genbank.curated_tables(_genbank_records(spark, d))
    return members.select("entity_id", "gene_order", "locus_tag", "aa_length", F.md5("translation").alias("digest"))


def genbank_products(spark, d):
    _, tokens, _ = genbank.curated_tables(_genbank_records(spark, d))
    rows = tokens.where("feature_type = 'CDS'")
    return rows.select("entity_id", "gene_order", F.md5("product").alias("digest"), F.col("token").alias("token"))


def genbank_predicted(spark, d):
    rows = genbank.predicted_tokens(_genbank_records(spark, d), "docs")
    return rows.select("bgc_id", "gene_order", "domain_id", "n_genes")


_LINES = """lines AS (
  SELECT doc_id, n_chars, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
)"""
_CLEAN = "regexp_replace(upper(replace({0}, 'ß', 'ss')), '[^A-Z]', '', 'g')"
_GENBANK = f"""WITH {_LINES},
genes AS (
  SELECT *, {_CLEAN.format('line')} AS seq, 'BGC' || lpad(doc_id::VARCHAR, 7, '0') AS entity_id,
         CASE WHEN length(line) > 40 THEN length({_CLEAN.format('line')}) ELSE 30 END AS aa
  FROM lines
)"""
_KIND = """CASE WHEN contains(p, 'nrps') THEN 'NRPS' WHEN contains(p, 'pks') THEN 'PKS' WHEN contains(p, 'terpene') THEN 'terpene'
 WHEN contains(p, 'lanthipeptide') THEN 'RiPP' ELSE 'other' END"""
_ALIAS = (
    "CASE "
    + " ".join(f"WHEN contains(lower(token), '{a}') THEN '{b}'" for a, b in WORD_ALIASES)
    + " ELSE 'other' END"
)

QUERIES = {
    "class_coarsen": (
        class_coarsen,
        f"""WITH w AS (SELECT doc_id AS entity_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents),
        c AS (SELECT DISTINCT entity_id, {_ALIAS} AS c FROM w)
        SELECT entity_id, CASE WHEN count(*) = 1 THEN min(c) WHEN count(*) FILTER (c <> 'other') >= 2 THEN 'hybrid'
               ELSE coalesce(min(c) FILTER (c <> 'other'), 'other') END AS biosynth_class FROM c GROUP BY entity_id""",
    ),
    "product_classes": (
        product_classes,
        f"""WITH k AS (SELECT ['nrps-like', 't1pks', 'terpene', 'lanthipeptide', 'saccharide', 'unknown'] AS kinds),
        p AS (SELECT p_partkey, unnest([kinds[p_partkey % 6 + 1], kinds[p_size % 6 + 1]]) AS p FROM part, k),
        c AS (SELECT DISTINCT p_partkey, {_KIND} AS c FROM p)
        SELECT p_partkey, CASE WHEN count(*) = 1 THEN min(c) WHEN count(*) FILTER (c <> 'other') >= 2 THEN 'hybrid'
               ELSE coalesce(min(c) FILTER (c <> 'other'), 'other') END AS predicted_class FROM c GROUP BY p_partkey""",
    ),
    "regex_tokens": (
        regex_tokens,
        f"""WITH {_LINES},
        t AS (
          SELECT doc_id, i, unnest(list_concat(
            list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(line), '{p}') THEN '{t}' END" for p, t in LINE_RULES)}], lambda x: x IS NOT NULL),
            list_transform(regexp_extract_all(line, '(?i){NAMES}'), lambda h: left(regexp_replace(trim(h), '\\s+', '_', 'g'), 48)))) AS token
          FROM lines WHERE line <> ''),
        none AS (SELECT doc_id, 'CDS_other' AS token FROM lines WHERE line <> '' AND (doc_id, i) NOT IN (SELECT doc_id, i FROM t))
        SELECT doc_id AS entity_id, token, count(*) AS n FROM (SELECT doc_id, token FROM t UNION ALL SELECT * FROM none) GROUP BY ALL""",
    ),
    "label_hits": (
        label_hits,
        r"""WITH l AS (SELECT unnest([regexp_extract(html, '<title>([^<]*)</title>', 1), url]) AS label FROM pages),
        t AS (SELECT left(unnest(regexp_extract_all(label, '(?i)(?:[a-z]+tion|page=[0-9]+)')), 64) AS token FROM l)
        SELECT token, count(*) AS n FROM t GROUP BY token""",
    ),
    "json_field_extract": (
        json_field_extract,
        "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    ),
    "id_sanitize": (
        id_sanitize,
        "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 60) AS clean_id FROM pages",
    ),
    "accession": (
        accession,
        "SELECT page_id, coalesce(nullif(regexp_extract(url, '([0-9]+)', 1), ''), url) AS accession FROM pages",
    ),
    "genus": (genus, r"SELECT doc_id AS entity_id, regexp_extract(text, '^\s*(\S+)', 1) AS genus FROM documents"),
    "number_default": (
        number_default,
        r"SELECT page_id, coalesce(try_cast(regexp_extract(url, 'page=(\w+)', 1) AS DOUBLE), -1) AS value FROM pages",
    ),
    "sequence_clean": (
        sequence_clean,
        f"""WITH c AS (SELECT doc_id AS entity_id, {_CLEAN.format('text')} AS seq FROM documents)
        SELECT entity_id, length(seq)::INT AS n_letters, md5(left(seq, 1024)) AS digest FROM c WHERE length(seq) >= 10""",
    ),
    "prepared_members": (
        prepared_members,
        f"""{_GENBANK} SELECT doc_id AS entity_id, (i - 1)::INT AS member_id, length(seq)::INT AS aa_length, md5(left(seq, 1024)) AS digest
        FROM genes WHERE length(seq) >= 10
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(seq) DESC, i) <= 80""",
    ),
    "representation_names": (
        representation_names,
        "SELECT DISTINCT 'esm2-' || p_name || '_' || lower(p_type) AS label FROM part",
    ),
    "predicted_size_features": (
        predicted_size_features,
        """WITH e AS (SELECT l_orderkey AS bgc_id, l_returnflag AS predicted_class, min(l_linenumber) + 1 AS n, count(*) AS t FROM lineitem GROUP BY ALL)
        SELECT bgc_id, predicted_class, n::INT AS n_genes, (n * 1000)::INT AS cluster_nt_length, 350::DOUBLE AS mean_aa_length,
               (n * 350)::INT AS total_aa_length, t AS n_domain_annotations, 0 AS n_compounds FROM e""",
    ),
    "rare_tokens": (
        rare_tokens,
        f"""WITH {WORDS}, c AS (SELECT DISTINCT entity_id, token FROM words), f AS (SELECT token, count(*) AS n FROM c GROUP BY token),
        r AS (SELECT entity_id, token, n, row_number() OVER (PARTITION BY entity_id ORDER BY n, token) AS rn FROM c JOIN f USING (token)
              WHERE entity_id IN (SELECT doc_id FROM documents WHERE lang = 'fr'))
        SELECT entity_id, string_agg(token, ';' ORDER BY rn) AS rarest FROM r WHERE rn <= 6 GROUP BY entity_id""",
    ),
    "record_fields": (
        record_fields,
        """WITH d AS (SELECT *, string_split(text, chr(10)) AS lines, '20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || '-01-15' AS dt
                   FROM documents WHERE doc_id % 50 <> 49)
        SELECT 'BGC' || lpad(doc_id::VARCHAR, 7, '0') AS entity_id, lang AS classes, 'other' AS biosynth_class, source AS organism,
               doc_id AS ncbi_tax_id, len(lines)::INT AS n_compounds,
               array_to_string(list_transform(lines[1:10], lambda x: left(x, 12)), ';') AS compounds, len(lines)::INT AS n_genes_json,
               least(dt, '2031-02-03') AS date_added, greatest(dt, '2031-02-03') AS date_latest FROM d""",
    ),
    "record_rejects": (
        record_rejects,
        "SELECT '/x/BGC_' || doc_id || '.json' AS path FROM documents WHERE doc_id % 50 = 49",
    ),
    "region_tokens": (
        region_tokens,
        r"""WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                 len(string_split(text, chr(10))) AS n FROM documents),
        t AS (
          SELECT doc_id, n, i, 0 AS j, left(line, 100) AS tok FROM l UNION ALL
          SELECT doc_id, n, i, generate_subscripts(string_split_regex(line, '\s+'), 1), unnest(string_split_regex(line, '\s+')) FROM l),
        g AS (
          SELECT 'doc_' || doc_id || '_r1' AS bgc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS gene_order, left(tok, 80) AS domain_id, n
          FROM t WHERE tok <> ''),
        p AS (SELECT 'doc_' || doc_id || '_r2' AS bgc_id, unnest([1, 2]) AS gene_order, unnest([lang, source]) AS domain_id, 2 AS n FROM documents)
        SELECT 'docs' AS genome, bgc_id, 'other' AS predicted_class, gene_order::INT AS gene_order, domain_id, n::INT AS n_genes
        FROM (SELECT * FROM g UNION ALL SELECT * FROM p)""",
    ),
    "genbank_summary": (
        genbank_summary,
        _GENBANK
        + f""", b AS (SELECT doc_id, length({_CLEAN.format('text')}) AS bases FROM documents)
        SELECT entity_id, count(*) AS n_genes, CASE WHEN min(bases) > 0 THEN min(bases) ELSE min(n_chars) END::INT AS cluster_nt_length,
               round(avg(aa), 6) AS mean_aa_length, sum(aa)::BIGINT AS total_aa_length FROM genes JOIN b USING (doc_id) GROUP BY entity_id""",
    ),
    "genbank_members": (
        genbank_members,
        f"""{_GENBANK} SELECT entity_id, i AS gene_order, 'g' || (i - 1) AS locus_tag, length(seq)::INT AS aa_length, md5(seq) AS digest
        FROM genes WHERE length(line) > 40 AND length(seq) >= 10""",
    ),
    "genbank_products": (
        genbank_products,
        f"{_GENBANK} SELECT entity_id, i AS gene_order, md5(line) AS digest, '' AS token FROM genes",
    ),
    "genbank_predicted": (
        genbank_predicted,
        f"""{_GENBANK}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM genes)
        SELECT entity_id AS bgc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS gene_order, left(trim(line), 80) AS domain_id, n::INT AS n_genes
        FROM k WHERE trim(line) <> ''
        UNION ALL SELECT entity_id, 1, 'unknown', count(*)::INT FROM genes GROUP BY entity_id HAVING count(*) FILTER (trim(line) <> '') = 0""",
    ),
}
