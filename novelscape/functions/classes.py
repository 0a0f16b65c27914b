"""Coarse class labels from free-form class lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from novelscape.functions.text import strip

# Fixed values: (substring, label), the first hit wins.
CLASS_ALIASES = (
    ("nrps", "NRPS"),
    ("nrp", "NRPS"),
    ("pks", "PKS"),
    ("polyketide", "PKS"),
    ("terpene", "terpene"),
    ("ripp", "RiPP"),
    ("ribosomal", "RiPP"),
    ("alkaloid", "other"),
    ("saccharide", "other"),
    ("other", "other"),
)
# Two of these make a hybrid.
COMBINABLE = ("NRPS", "PKS", "terpene", "RiPP")
# Fixed values: (substrings, label) for predicted product names, the first hit wins.
PRODUCT_ALIASES = (
    (("nrps",), "NRPS"),
    (("pks", "polyketide"), "PKS"),
    (("terpene",), "Terpene"),
    (("ripp", "lantipeptide", "lanthipeptide", "bacteriocin"), "RiPP"),
)
OTHER = "other"
HYBRID = "hybrid"


def first_alias(text: Column, aliases: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """The label of the first alias that occurs in ``text``."""
    default = default if isinstance(default, Column) else F.lit(default)
    if not aliases:
        return default
    head, *rest = aliases
    choice = F.when(F.contains(text, F.lit(head[0])), head[1])
    for pattern, label in rest:
        choice = choice.when(F.contains(text, F.lit(pattern)), label)
    return choice.otherwise(default)


def coarsen_classes(
    names: Column,
    aliases: Sequence[tuple[str, str]] = CLASS_ALIASES,
    combinable: Sequence[str] = COMBINABLE,
) -> Column:
    """One label for an array of class names: its class, ``hybrid`` or ``other``."""
    labels = F.array_distinct(F.transform(names, lambda c: first_alias(F.lower(strip(c)), aliases, OTHER)))
    majors = F.array_intersect(labels, F.array(*[F.lit(c) for c in combinable]))
    return (
        F.when(names.isNull() | (F.size(labels) == 0), OTHER)
        .when(F.size(labels) == 1, F.get(labels, 0))
        .when(F.size(majors) >= 2, HYBRID)
        .when(F.size(majors) == 1, F.get(majors, 0))
        .otherwise(OTHER)
    )


def product_class(products: Column) -> Column:
    """The coarse class of an array of predicted product names."""
    flat = [(pattern, label) for patterns, label in PRODUCT_ALIASES for pattern in patterns]
    return coarsen_classes(F.transform(products, lambda p: first_alias(F.lower(p), flat, p)))
