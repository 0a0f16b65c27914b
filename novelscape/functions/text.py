"""Token rules and string clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from novelscape.config import MAX_MEMBER_LENGTH

# Names that are tokens wherever they occur, in any case.
NAME_PATTERN = (
    r"(?:PF\d{5}|PKS_[A-Za-z0-9]+|NRPS_[A-Za-z0-9]+|AMP-binding|"
    r"Condensation(?:_[A-Za-z0-9]+)?|Thioesterase|ACP_domain|PCP|"
    r"\bKS\b|\bAT\b|\bDH\b|\bER\b|\bKR\b|\bMT\b|\bTE\b|\bACP\b|"
    r"Terpene_synth|LANC_like|YcaO|DUF\d+|"
    r"polyketide\s+synthase|nonribosomal\s+peptide|"
    r"terpene\s+synthase|lanthipeptide|bacteriocin)"
)
# Fixed values: (pattern on the lower-cased product, token); every hit counts.
PRODUCT_RULES = (
    (r"nonribosomal|nrps|peptide synthetase|adenylation", "NRPS_module"),
    (r"polyketide|pks|ketosynthase|acyltransferase", "PKS_module"),
    (r"terpene|terpenoid|squalene|phytoene", "Terpene_synth"),
    (r"lanthipeptide|lantibiotic", "RiPP_lanthipeptide"),
    (r"bacteriocin|ripp|thiazole|oxazole", "RiPP_other"),
    (r"glycosyltransferase", "Glycosyltransferase"),
    (r"methyltransferase", "Methyltransferase"),
    (r"cytochrome p450|p450", "P450"),
    (r"abc transporter|transporter", "Transporter"),
    (r"transcription|regulator|saras-family|luxr", "Regulator"),
    (r"thioesterase", "Thioesterase"),
    (r"acyl carrier|phosphopantetheine", "ACP"),
    (r"condensation", "Condensation"),
    (r"halogenase", "Halogenase"),
    (r"oxygenase|dehydrogenase|reductase", "Redox"),
    (r"hydrolase|esterase|protease", "Hydrolase"),
    (r"kinase", "Kinase"),
    (r"hypothetical|unknown", "Hypothetical"),
)
FALLBACK_TOKEN = "CDS_other"
PRODUCT_HIT_LENGTH = 48
LABEL_HIT_LENGTH = 64
PREDICTED_LENGTH = 80
ID_LENGTH = 60


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_hits(text: Column, pattern: str = NAME_PATTERN, length: int = PRODUCT_HIT_LENGTH) -> Column:
    """All names in ``text``, case kept, white space as ``_``, cut to ``length``."""
    hits = F.regexp_extract_all(text, F.lit(f"(?iuU){pattern}"), F.lit(0))
    return F.transform(hits, lambda h: F.left(F.regexp_replace(strip(h), r"(?U)\s+", "_"), F.lit(length)))


def product_tokens(
    product: Column,
    rules: Sequence[tuple[str, str]] = PRODUCT_RULES,
    pattern: str = NAME_PATTERN,
    fallback: str = FALLBACK_TOKEN,
) -> Column:
    """The tokens of a product text: every rule that matches, then every name in it."""
    lowered = F.lower(product)
    matched = F.array_compact(F.array(*[F.when(lowered.rlike(p), token) for p, token in rules]))
    tokens = F.concat(matched, name_hits(product, pattern))
    empty = F.array().cast("array<string>")
    return (
        F.when(product.isNull() | (product == ""), empty)
        .when(F.size(tokens) == 0, F.array(F.lit(fallback)))
        .otherwise(tokens)
    )


def label_tokens(labels: Column, pattern: str = NAME_PATTERN) -> Column:
    """All names in an array of feature labels, in label order."""
    return F.flatten(F.transform(labels, lambda x: name_hits(x, pattern, LABEL_HIT_LENGTH)))


def accession(name: Column, pattern: str = r"(BGC\d+)") -> Column:
    """The accession inside ``name``, or ``name`` itself."""
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found).otherwise(name)


def clean_id(name: Column) -> Column:
    """Keep letters, digits, ``_ . -``; at most 60 characters."""
    return F.left(F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_"), F.lit(ID_LENGTH))


def first_word(text: Column) -> Column:
    """The first white-space separated word, ``''`` if there is none."""
    word = F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)
    return F.coalesce(word, F.lit(""))


def clean_sequence(text: Column) -> Column:
    """Upper-case letters A-Z only."""
    return F.regexp_replace(F.upper(text), "[^A-Z]+", "")


def cut_sequence(text: Column, length: int = MAX_MEMBER_LENGTH) -> Column:
    return F.left(text, F.lit(length))


def number_or(value: Column, default: float = 0.0) -> Column:
    """A number, or the default where the value is missing or not a number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(float(default)))


def representation_label(model: Column, pooling: Column) -> Column:
    """Short model name and pooling joined by ``_``."""
    short = F.element_at(F.split(model, "/"), -1)
    short = F.replace(F.replace(short, F.lit("esm2_"), F.lit("esm2-")), F.lit("_UR50D"), F.lit(""))
    return F.concat_ws("_", short, pooling)


def leaks_class(feature: Column) -> Column:
    """Whether a feature name gives away the class label."""
    return F.contains(F.lower(feature), F.lit("biosynth_class")) | F.startswith(feature, F.lit("class::"))
