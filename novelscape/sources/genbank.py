"""GenBank flat files as DataFrames: records, features, tokens.

The text reader splits files at the record separator, so large files with many
records are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.config import MIN_MEMBER_LENGTH
from novelscape.functions.classes import product_class
from novelscape.functions.text import PREDICTED_LENGTH, accession, clean_id, first_word, label_tokens, product_tokens, strip
from novelscape.operators.ordering import sequence
from novelscape.operators.tokens import top_per_group
from novelscape.session import settle, stored

#: Both kinds of line ends follow it.
RECORD_END = "\n//"
REGION_FILE = r"(?i)\.region\d+\.gbk$"
# Feature types and qualifiers, in the order in which they are looked up.
TOKEN_TYPES = ("CDS", "aSDomain", "PFAM_domain", "misc_feature")
LABEL_KEYS = ("aSDomain", "domain", "note", "product", "PFAM")
REGION_TYPES = ("region", "cluster", "protocluster", "cand_cluster")
DOMAIN_TYPES = ("aSDomain", "PFAM_domain", "CDS_motif", "antismash_domain")
HINT_KEYS = ("sec_met_domain", "sec_met", "gene_functions", "domain")
PREDICTED_SCHEMA = (
    "genome string, bgc_id string, predicted_class string, gene_order int, domain_id string, n_genes int"
)


def read_records(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = (".gbk",)) -> DataFrame:
    """``path, record_no, content``; records are numbered from 1 within each file."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", RECORD_END)
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        # A record begins behind the line end of the last one's mark.
        F.regexp_replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), r"\A\n", "").alias("content"),
    )
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(suffix))
    rows = raw.where(wanted & F.contains(F.col("content"), F.lit("LOCUS")))
    return sequence(rows, ["path"], ["_block", "_line"], "record_no").drop("_block", "_line")


def _section(content: Column, start: str, *stops: str) -> Column:
    """The lines behind the one that begins with ``start``, up to one that begins with one of ``stops``; ``''`` without it.

    Plain searches only: records are long, and regular expressions took most of the time.
    """
    before = F.length(F.substring_index(content, f"\n{start}", 1))
    rest = F.substring(content, before + 2, F.length(content))
    first = F.length(F.substring_index(rest, "\n", 1))
    found = F.substring(rest, first + 1, F.length(rest))
    for stop in stops:
        found = F.substring_index(found, f"\n{stop}", 1)
    return F.substring(found, 2, F.length(found))


def _field(content: Column, name: str) -> Column:
    return F.regexp_extract(content, rf"(?m)^{name} +(\S+)", 1)


def record_heads(records: DataFrame) -> DataFrame:
    """Add ``record_name``, ``record_id`` and ``nt_length``."""
    bases = F.length(F.regexp_replace(_section(F.col("content"), "ORIGIN", "//"), "[^A-Za-z]+", ""))
    stated = F.regexp_extract("content", r"(?m)^LOCUS +\S+ +(\d+) bp", 1).try_cast("int")
    name = _field(F.col("content"), "LOCUS")
    version, acc = _field(F.col("content"), "VERSION"), _field(F.col("content"), "ACCESSION")
    ident = F.when(version != "", version).when(acc != "", acc).otherwise(name)
    return records.select(
        "*",
        name.alias("record_name"),
        ident.alias("record_id"),
        F.when(bases > 0, bases).otherwise(F.coalesce(stated, F.lit(0))).alias("nt_length"),
    )


def _qualifier(part: Column) -> Column:
    key = F.regexp_extract(part, r"^([^=\s]+)", 1)
    value = F.regexp_extract(part, r"(?s)^[^=\s]+=(.*)$", 1)
    joined = F.regexp_replace(value, r"\n *", F.when(key == "translation", "").otherwise(" "))
    bare = F.replace(F.regexp_replace(F.trim(joined), '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.struct(key.alias("key"), bare.alias("value"))


def features(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per feature: the ``keep`` columns, ``pos, type, first, last, qualifiers``.

    ``first`` is 0-based, so ``last - first`` is the span over all parts of the location.
    """
    keep = keep if keep is not None else [c for c in records.columns if c != "content"]
    # The outer form spares a second evaluation of the split by an inferred filter.
    blocks = records.select(*keep, F.posexplode_outer(_blocks(F.col("content"))).alias("pos", "_block"))
    return _parsed(blocks.where("pos > 0"), keep)


def _blocks(content: Column) -> Column:
    """The feature table cut before each feature; the first part is what precedes all of them."""
    table = F.concat(F.lit("\n"), _section(content, "FEATURES", "ORIGIN", "CONTIG", "BASE COUNT", "WGS", "//"))
    return F.split(table, r"\n(?= {5}\S)")


def numbered_features(records: DataFrame, keep: list[str]) -> DataFrame:
    """As ``features``, with ``gene_order``: how many CDS features the record has up to and including each one.

    They are counted within the record's row, so nothing is shuffled.  A row with ``pos`` 0 (null without content) stands for the record.
    """
    cut = records.select(*keep, _blocks(F.col("content")).alias("_blocks"))
    genes = F.filter(
        F.transform("_blocks", lambda b, i: F.when((i > 0) & b.rlike(r"\A *CDS(?!\S)"), i)), lambda i: i.isNotNull()
    )
    cut = cut.withColumn("_runs", F.concat(F.array(F.lit(0)), genes))

    def run(start: Column, number: Column) -> Column:
        stop = F.coalesce(F.get("_runs", number + 1), F.size("_blocks"))
        own = F.slice("_blocks", start + 1, stop - start)
        return F.transform(own, lambda b, i: F.struct(number.cast("long").alias("gene_order"), (start + i).alias("pos"), b.alias("_block")))

    return _parsed(cut.select(*keep, F.inline_outer(F.flatten(F.transform("_runs", run)))), [*keep, "gene_order"])


def _parsed(blocks: DataFrame, keep: list[str]) -> DataFrame:
    split = blocks.withColumn("_parts", F.split("_block", r"\n {21}/"))
    head = F.get("_parts", 0)
    location = F.regexp_replace(F.regexp_extract(head, r"(?s)^ *\S+\s+(.*)$", 1), r"\s", "")
    bounds = F.transform(
        F.regexp_extract_all(F.regexp_replace(location, r"[A-Za-z_][\w.]*:", ""), F.lit(r"\d+"), F.lit(0)),
        lambda x: x.cast("int"),
    )
    return split.select(
        *keep,
        "pos",
        F.regexp_extract(head, r"^ *(\S+)", 1).alias("type"),
        (F.array_min(bounds) - 1).alias("first"),
        F.array_max(bounds).alias("last"),
        F.transform(F.slice("_parts", F.lit(2), F.size("_parts")), _qualifier).alias("qualifiers"),
    )


def values(key: str, qualifiers: Column | str = "qualifiers") -> Column:
    """All values of one qualifier."""
    return F.transform(F.filter(qualifiers, lambda q: q["key"] == key), lambda q: q["value"])


def first_value(*keys: str) -> Column:
    """The first value of the first qualifier present."""
    return F.coalesce(*[F.get(values(k), 0) for k in keys])


def curated_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(summary, tokens, members)`` of the first record of each file.

    The id comes from the file name, else from the record.  CDS rows have an empty token.
    """
    heads = record_heads(records.where("record_no = 1"))
    file_name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(file_name, r"(BGC\d+)", 1)
    named = F.regexp_extract("record_name", r"(BGC\d+)", 1)
    ident = F.when(found != "", found).when(named != "", named).otherwise(accession(F.col("record_id")))
    keyed = heads.withColumn("entity_id", ident)
    rows = numbered_features(keyed, ["path", "entity_id", "nt_length"])
    head = F.coalesce("pos", F.lit(0)) == 0
    numbered = rows.where(head | F.col("type").isin(*TOKEN_TYPES))
    is_cds = ~head & (F.col("type") == "CDS")
    translation = F.coalesce(first_value("translation"), F.lit(""))
    described = numbered.select(
        "path",
        "entity_id",
        "nt_length",
        head.alias("is_head"),
        "pos",
        is_cds.alias("is_cds"),
        "gene_order",
        F.when(is_cds, F.coalesce(first_value("locus_tag", "gene"), F.concat(F.lit("cds_"), F.col("gene_order").cast("string"))))
        .otherwise("")
        .alias("locus_tag"),
        F.when(is_cds, F.coalesce(first_value("product"), F.lit(""))).otherwise("").alias("product"),
        F.when(is_cds, translation).otherwise("").alias("translation"),
        F.when(first_value("translation").isNotNull(), F.length(translation))
        .otherwise(F.greatest(F.lit(0), F.floor((F.col("last") - F.col("first")) / 3)))
        .cast("int")
        .alias("aa_size"),
        F.when(~head & ~is_cds, F.flatten(F.array(*[values(k) for k in LABEL_KEYS]))).alias("_labels"),
    )
    # Parsed once, read several times; tokens are looked for by those who ask for them.
    known = stored(described)
    described = known.where("not is_head").drop("is_head", "nt_length")
    tagged = described.withColumn(
        "_tokens",
        F.when(F.col("is_cds"), F.concat(F.array(F.lit("")), product_tokens(F.col("product")))).otherwise(
            label_tokens(F.col("_labels"))
        ),
    )
    tokens = tagged.select(
        "entity_id",
        "path",
        "gene_order",
        "locus_tag",
        "product",
        "is_cds",
        F.length("translation").alias("_length"),
        "pos",
        F.posexplode("_tokens").alias("_at", "token"),
    ).select(
        "entity_id",
        "path",
        F.when(F.col("is_cds") & (F.col("_at") == 0), "CDS").otherwise("domain").alias("feature_type"),
        "gene_order",
        F.struct("pos", F.col("_at").alias("at")).alias("token_pos"),
        "locus_tag",
        "product",
        "token",
        F.when(F.col("is_cds") & (F.col("_at") == 0), F.col("_length")).otherwise(0).alias("aa_length"),
    )
    members = described.where(F.col("is_cds") & (F.length("translation") >= MIN_MEMBER_LENGTH)).select(
        "entity_id", "path", "gene_order", "locus_tag", "product", "translation", F.length("translation").alias("aa_length")
    )
    sizes = described.where("is_cds").groupBy("path").agg(
        F.count(F.lit(1)).alias("_genes"), F.avg("aa_size").alias("_mean"), F.sum("aa_size").alias("_total")
    )
    hits = tokens.where("token <> ''")
    kinds = hits.groupBy("path", "token").agg(F.count(F.lit(1)).alias("_n"))
    types = top_per_group(kinds.select("path", "token"), "path", ["token"], 80)
    listed = types.groupBy("path").agg(F.array_sort(F.collect_list("token")).alias("_types"))
    counted = kinds.groupBy("path").agg(F.sum("_n").alias("_n"))
    zero = F.lit(0)
    summary = (
        known.where("is_head").select("path", "entity_id", "nt_length")
        .join(sizes, "path", "left")
        .join(counted, "path", "left")
        .join(listed, "path", "left")
        .select(
            "entity_id",
            F.coalesce("_genes", zero).cast("long").alias("n_genes"),
            F.col("nt_length").alias("cluster_nt_length"),
            F.coalesce("_mean", F.lit(0.0)).alias("mean_aa_length"),
            F.coalesce("_total", zero).cast("long").alias("total_aa_length"),
            F.coalesce("_n", zero).cast("long").alias("n_domain_annotations"),
            F.coalesce("_types", F.array().cast("array<string>")).alias("domain_types"),
            F.col("path").alias("gbk_path"),
        )
    )
    return summary, tokens, members


def predicted_tokens(records: DataFrame, genome: str | None = None, label: Column | None = None) -> DataFrame:
    """The six-column token table of annotated region records.

    Tokens are the domain features by start, else CDS products and hints in file order,
    else one ``unknown``.  Records of a file that holds several get a numbered id.
    """
    genome_label = label if label is not None else F.lit(genome)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    many = records.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("_many"))
    ident = F.when(
        F.col("_many") & (F.col("record_no") > 1), F.concat_ws("_", stem, F.col("record_no").cast("string"))
    ).otherwise(stem)
    keyed = records.join(many, "path").select(
        "path", "record_no", genome_label.alias("genome"), clean_id(ident).alias("bgc_id"), "content"
    )
    key = ["path", "record_no", "genome", "bgc_id"]
    rows = features(keyed, key)
    kind = F.col("type")
    products = F.when(
        kind.isin(*REGION_TYPES),
        F.when(F.size(values("product")) > 0, values("product")).otherwise(values("category")),
    )
    first = strip(F.coalesce(first_value("domain", "aSDomain", "description"), F.lit("")))
    named = F.when(first != "", first).otherwise(F.coalesce(first_value("label", "note"), F.lit("domain")))
    hints = F.flatten(F.array(*[values(k) for k in HINT_KEYS]))
    fallback = F.filter(
        F.concat(
            F.array(strip(F.coalesce(first_value("product"), F.lit("hypothetical")))),
            F.transform(hints, lambda x: strip(F.element_at(F.split(x, ":"), -1))),
        ),
        lambda t: t != "",
    )
    is_domain = kind.isin(*DOMAIN_TYPES)
    # Parsed once, read several times.
    marked = settle(rows.select(
        *key,
        "pos",
        "first",
        is_domain.alias("is_domain"),
        (kind == "CDS").alias("is_cds"),
        products.alias("products"),
        F.when(is_domain, F.array(first_word(named))).when(kind == "CDS", fallback).alias("tokens"),
    ))
    # A record has few region features; their product lists make its class.
    regions = marked.where("products is not null").select(*key, "pos", F.posexplode("products").alias("_i", "_product"))
    distinct = regions.select(*key, "_product").distinct()
    classes = distinct.groupBy(*key).agg(product_class(F.collect_set("_product")).alias("predicted_class"))
    facts = marked.groupBy(*key).agg(
        F.count_if("is_domain").alias("_domains"), F.count_if("is_cds").alias("_genes")
    )
    entities = (
        keyed.select(*key)
        .join(facts, key, "left")
        .join(classes, key, "left")
        .select(
            *key,
            F.coalesce("predicted_class", F.lit("other")).alias("predicted_class"),
            F.coalesce("_domains", F.lit(0)).alias("_domains"),
            F.greatest(F.coalesce("_genes", F.lit(0)), F.lit(1)).cast("int").alias("n_genes"),
        )
    )
    exploded = marked.where("tokens is not null").select(
        *key, "is_domain", F.when(F.col("is_domain"), F.col("first")).otherwise(0).alias("_start"), "pos", F.posexplode("tokens").alias("_at", "_token")
    )
    chosen = exploded.join(entities.select(*key, "_domains"), key).where(
        (F.col("_domains") > 0) == F.col("is_domain")
    )
    numbered = sequence(chosen, key, ["_start", "pos", "_at"], "gene_order", often_small=True)
    full = entities.join(numbered.select(*key, "gene_order", "_token"), key, "left")
    return full.select(
        "genome",
        "bgc_id",
        "predicted_class",
        F.coalesce("gene_order", F.lit(1)).cast("int").alias("gene_order"),
        F.left(F.coalesce("_token", F.lit("unknown")), F.lit(PREDICTED_LENGTH)).alias("domain_id"),
        "n_genes",
    )
