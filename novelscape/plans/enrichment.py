"""Group enrichment of high novelty, and look-ups of single entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.functions.tails import rank_sum_p_value
from novelscape.functions.text import first_word
from novelscape.operators.groups import contingency, enrichment, high_share, odds, two_group_tests
from novelscape.operators.ordering import quantiles
from novelscape.operators.tokens import ENTITY, document_frequency, present, token_counts, top_per_group
from novelscape.plans.report import beside, records
from novelscape.session import settle

# Genus groups of the published comparison.
GENUS_GROUPS = {
    "Myxobacteria": (
        "Sorangium",
        "Chondromyces",
        "Stigmatella",
        "Myxococcus",
        "Corallococcus",
        "Cystobacter",
        "Melittangium",
        "Archangium",
        "Pyxidicoccus",
    ),
    "Streptomyces": ("Streptomyces",),
}
RAREST = 6


def group_label(value: Column, groups: Mapping[str, Sequence[str]] = GENUS_GROUPS, default: str = "Other") -> Column:
    """The first group that lists ``value``."""
    label = None
    for name, members in groups.items():
        hit = value.isin(*members)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else F.coalesce(label.otherwise(default), F.lit(default))


def group_summary(df: DataFrame, value: str, by: str, high: str = "is_high") -> DataFrame:
    """``by, n, mean, median, share_high``."""
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(F.col(high).cast("double")).alias("share_high")
    )
    return base.join(quantiles(df, value, {"median": 0.5}, [by]), by).select(by, "n", "mean", "median", "share_high")


def group_enrichment(
    scores: DataFrame,
    a: str,
    b: str,
    group_col: str = "group",
    by: str = "genus",
    size_max: int | None = None,
    value: str = "novelty",
    size: str = "n_genes",
) -> DataFrame:
    """One row comparing two groups: top-decile odds, effect sizes, rank test, and group and genus tables."""
    rows = scores if size_max is None else scores.where(F.col(size) <= size_max)
    rows = settle(rows.where(F.col(group_col).isNotNull()))
    marked = settle(high_share(rows, value))
    in_a, in_b = F.col(group_col) == a, F.col(group_col) == b
    tests = two_group_tests(marked, value, in_a, in_b)
    return beside(
        odds(contingency(marked, in_a, in_b, F.col("is_high"))),
        tests.select("*", rank_sum_p_value(F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties")).alias("p_value")),
        records(group_summary(marked, value, group_col), group_col, "groups"),
        enrichment(marked, by, F.col("is_high")).agg(
            F.array_sort(F.collect_list(F.struct(F.negative("enrichment").alias("_o"), by, "n_top", "n_total", "enrichment"))).alias(
                "_ranked"
            )
        ).select(
            F.transform(
                "_ranked",
                lambda x: F.struct(x[by].alias(by), x["n_top"].alias("n_top"), x["n_total"].alias("n_total"), x["enrichment"].alias("enrichment")),
            ).alias("top_decile_enrichment")
        ),
    ).withColumn("size_max", F.lit(size_max).cast("int"))


def with_genus(scores: DataFrame, organism: str = "organism") -> DataFrame:
    """Add ``genus`` and its ``group``."""
    genus = first_word(F.col(organism))
    return scores.withColumn("genus", genus).withColumn("group", group_label(F.col("genus")))


def rarest_tokens(tokens: DataFrame, ids: DataFrame, n: int = RAREST, distinct: bool = False) -> DataFrame:
    """Per entity of ``ids``, its ``n`` tokens that fewest entities have, as an array of structs.

    ``distinct`` tells that ``tokens`` has each token of an entity once, as ``distinct_tokens`` gives them.
    """
    once = (lambda rows: present(rows).select(ENTITY, "token")) if distinct else token_counts
    # Only the tokens of the chosen entities are kept by entity; of all others no more than their number is.
    total = present(tokens).select(F.countDistinct(ENTITY)).scalar()
    shares = document_frequency(once(tokens)).withColumn("share", F.col("n_entities") / total)
    chosen = once(tokens.join(ids.select(ENTITY), ENTITY, "left_semi")).select(ENTITY, "token").join(shares, "token")
    kept = top_per_group(chosen, ENTITY, ["n_entities", "token"], n)
    return kept.groupBy(ENTITY).agg(
        F.array_sort(F.collect_list(F.struct("n_entities", "token", "share"))).alias("rarest_tokens")
    )


def case_lookup(
    ids: DataFrame, scores: DataFrame, entities: DataFrame, tokens: DataFrame, other_scores: DataFrame | None = None, distinct: bool = False
) -> DataFrame:
    """Scores, attributes, nearest entity's attributes and rarest tokens of the entities in ``ids``; ``distinct`` as for these."""
    shown = [c for c in ("organism", "biosynth_class", "compounds", "n_genes", "domain_types") if c in entities.columns]
    rows = ids.select(ENTITY).join(
        scores.select(ENTITY, "novelty", "rank", "nearest_id", "neighbor_class"), ENTITY
    ).join(entities.select(ENTITY, *shown), ENTITY)
    near = [c for c in ("compounds", "organism") if c in entities.columns]
    side = entities.select(F.col(ENTITY).alias("nearest_id"), *[F.col(c).alias(f"nearest_{c}") for c in near])
    rows = rows.join(side, "nearest_id", "left").join(rarest_tokens(tokens, ids, distinct=distinct), ENTITY, "left")
    if other_scores is not None:
        other = other_scores.select(ENTITY, F.col("novelty").alias("novelty_other"))
        rows = rows.join(other, ENTITY, "left")
    return rows
