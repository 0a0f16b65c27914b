"""Fields of polymorphic JSON records, read from ``VARIANT`` columns.

A record is a struct of the fields that are read, each a ``VARIANT``, so that no other part of a document is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
MAX_COMPOUNDS = 10
FIELDS = ("accession", "biosynthesis", "taxonomy", "compounds", "genes", "status", "completeness", "quality", "changelog")


def items(node: Column, path: str) -> Column:
    """The elements of the array at ``path``; empty if there is none."""
    return F.coalesce(
        F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>")
    )


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def names(node: Column, path: str, *keys: str) -> Column:
    """Strings of a mixed array: for objects the first filled key, else the scalar; ``''`` if neither."""

    def name(x: Column) -> Column:
        fields = [_filled(text(x, f"$.{k}")) for k in keys]
        return (
            F.when(_is_object(x), F.coalesce(*fields, F.lit("")))
            .when(_is_array(x), "")
            .otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
        )

    return F.transform(items(node, path), name)


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def _is_array(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>").isNotNull()


def text(node: Column, path: str = "$") -> Column:
    """The scalar at ``path`` as a string, null for objects, arrays and nothing."""
    inner = F.try_variant_get(node, path, "variant")
    return F.when(~(_is_object(inner) | _is_array(inner)), F.try_variant_get(node, path, "string"))


def class_names(record: Column) -> Column:
    """``biosynthesis.classes``: class, else subclass, else the scalar; empty ones dropped."""
    return F.filter(names(record["biosynthesis"], "$.classes", "class", "subclass"), lambda c: c != "")


def compound_names(record: Column) -> Column:
    return names(record["compounds"], "$", "name", "compound")


def organism(record: Column) -> Column:
    return F.coalesce(_filled(text(record["taxonomy"], "$.name")), F.lit("unknown"))


def tax_id(record: Column) -> Column:
    return F.try_variant_get(record["taxonomy"], "$.ncbiTaxId", "bigint")


def gene_count(record: Column) -> Column:
    """Length of ``genes`` if it is a list, else of its ``annotations`` and ``to_add`` lists."""
    listed = F.try_variant_get(record["genes"], "$", "array<variant>")
    return F.coalesce(
        F.size(F.when(listed.isNotNull(), listed)),
        F.size(items(record["genes"], "$.annotations")) + F.size(items(record["genes"], "$.to_add")),
    )


def change_dates(record: Column) -> Column:
    """All ISO dates of the releases and their entries, sorted."""
    releases = items(record["changelog"], "$.releases")
    dates = F.flatten(
        F.transform(
            releases,
            lambda r: F.concat(
                F.array(text(r, "$.date")),
                F.transform(items(r, "$.entries"), lambda e: text(e, "$.date")),
            ),
        )
    )
    return F.array_sort(F.filter(dates, lambda d: d.rlike(ISO_DATE)))


def gene_tokens(gene: Column) -> Column:
    """Tokens of one annotated gene: its texts, then the names in its domain lists."""

    def texts(key: str) -> Column:
        listed = F.try_variant_get(gene, f"$.{key}", "array<variant>")
        return F.when(listed.isNotNull(), F.transform(listed, lambda x: text(x, "$"))).otherwise(
            F.array(text(gene, f"$.{key}"))
        )

    parts = [texts(k) for k in ("product", "gene_function", "function")]
    parts += [names(gene, f"$.{k}", "name", "domain", "id") for k in ("domains", "pfams", "sec_met_domains")]
    return F.filter(F.flatten(F.array(*parts)), lambda t: t.isNotNull() & (t != ""))
