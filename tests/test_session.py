"""Lineage cuts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from novelscape import session
from novelscape.llm import common


def shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for folder in folders for p in Path(folder).rglob("shuffle_*.data")}


@pytest.mark.parametrize("stored", [session.stored, session.settle, common.stored])
def test_stored_drops_its_shuffles(spark, stored):
    known, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    rows = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 7_001).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = stored(rows)
    assert not shuffle_files(spark) - known
    assert spark.conf.get(name) == before
    # The query itself can be run again.
    assert kept.count() == rows.count() == 7_001
    assert sorted(kept.collect()) == sorted(rows.collect())
