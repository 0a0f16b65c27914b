import hashlib
import itertools
import math

import pytest
from pyspark.sql import functions as F

from novelscape.functions import tails
from novelscape.functions import text as S
from novelscape.functions.classes import coarsen_classes, product_class
from novelscape.functions.hashing import bucket


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (("PKS", "NRPS"), "hybrid"),
        (("Terpene",), "terpene"),
        (("RiPP",), "RiPP"),
        ((" Polyketide ", "saccharide"), "PKS"),
        (("alkaloid", "something"), "other"),
        ((), "other"),
        (("ribosomal peptide",), "RiPP"),
        (("NRP", "nrps-like"), "NRPS"),
    ],
)
def test_coarsen_classes(spark, names, expected):
    assert one(spark, coarsen_classes(strings(*names))) == expected


def test_product_class(spark):
    assert one(spark, product_class(strings("NRPS", "T1PKS"))) == "hybrid"
    assert one(spark, product_class(strings("lantipeptide-class-i"))) == "RiPP"
    assert one(spark, product_class(strings())) == "other"


@pytest.mark.parametrize("width", [256, 100, 64, 7])
def test_bucket_agrees_with_md5(spark, width):
    tokens = ["uni::Condensation", "bi::a::b", "", "é", "日本語", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", bucket(F.col("t"), width).alias("b"))
    for row in rows.collect():
        assert row["b"] == int(hashlib.md5(row["t"].encode()).hexdigest(), 16) % width


def test_product_tokens(spark):
    def tokens(text):
        return one(spark, S.product_tokens(F.lit(text)))

    assert tokens("nonribosomal  peptide synthetase") == ["NRPS_module", "nonribosomal_peptide"]
    assert tokens("Thioesterase") == ["Thioesterase", "Hydrolase", "Thioesterase"]
    assert tokens("thioesterase")[-1] == "thioesterase"
    assert tokens("KS domain, AT") == ["KS", "AT"]
    assert tokens("strange thing") == ["CDS_other"]
    assert tokens("") == []
    assert tokens("lanM homolog") == ["CDS_other"]


def test_clean_up(spark):
    assert one(spark, S.clean_id(F.lit("a b/c:" + "d" * 80))) == "a_b_c_" + "d" * 54
    assert one(spark, S.first_word(F.lit("  Streptomyces sp."))) == "Streptomyces"
    assert one(spark, S.first_word(F.lit("  "))) == ""
    assert one(spark, S.first_word(F.lit(None).cast("string"))) == ""
    assert one(spark, S.accession(F.lit("xBGC0001234.5"))) == "BGC0001234"
    assert one(spark, S.number_or(F.lit("x1"), 3.0)) == 3.0
    assert one(spark, S.representation_label(F.lit("facebook/esm2_t33_650M_UR50D"), F.lit("mean"))) == "esm2-t33_650M_mean"
    assert one(spark, S.clean_sequence(F.lit("mk t*-a1"))) == "MKTA"
    assert one(spark, S.leaks_class(F.lit("class::x")))
    assert not one(spark, S.leaks_class(F.lit("dom::x")))


def test_rank_sum_p_normal():
    assert tails.rank_sum_p(41978, 84, 826, 0.0) == pytest.approx(7.5e-4, rel=0.02)
    assert math.isnan(tails.rank_sum_p(0, 0, 5, 0.0))


def test_rank_sum_p_exact():
    a, b = 3, 4
    ranks = range(1, a + b + 1)
    us = [sum(c) - a * (a + 1) / 2 for c in itertools.combinations(ranks, a)]
    for u in range(a * b + 1):
        expected = sum(x >= u for x in us) / len(us)
        assert tails.rank_sum_p(u, a, b, 0.0, "exact") == pytest.approx(expected)
        assert tails.rank_sum_p(u, b, a, 0.0, "exact") == pytest.approx(expected)


def test_spearman_p():
    # Student's t with one degree of freedom is the Cauchy distribution.
    rho = 0.5
    t = rho / math.sqrt(1 - rho * rho)
    assert tails.spearman_p(rho, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t))
    assert tails.spearman_p(-0.377, 2636) == pytest.approx(1.1e-89, rel=0.5)
    assert tails.spearman_p(1.0, 10) == 0.0
    assert math.isnan(tails.spearman_p(None, 10))
