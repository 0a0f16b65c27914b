"""Near copies: candidates by the Gray-order index of SimHash fingerprints, confirmed on full shingle sets.

A text's set holds its distinct shingles; texts with equal sets are one class. A class's fingerprint has 512 bits, each set
if more than half of the set's hashes have it. Sets with a similarity of 0.8 differ in 15 % of the bits; ``DISTANCE`` allows
21 %. Blocks of 14 bits are taken twice from each word, side by side and spread out. Measured on 3,000 pairs of each kind,
0.1 to 0.4 % of those at 0.8 itself are no candidates, and 0.1 % of those at 0.85; such a pair is still in one group if
any chain of other links leads there.

Links are found in two steps. The index of ``simhash`` gives forests of the candidates that hang together, and one link
of each class is confirmed or refuted by the full sets. What the confirmed links leave apart is compared within each block
value: classes of different components whose fingerprints are near have their full sets compared, many against many in
one task. A link counts only if the intersection is ``percent`` of the union, in whole numbers. Tasks return links that
hang classes together, never all pairs.

Texts without words are copies of each other. Texts of fewer words than a shingle have one shingle, the whole text.
Rows with equal ``doc_id`` stand by their own texts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common, lsh_forest, simhash
from novelscape.llm.components import components

SHINGLE, PERCENT = 5, 80
WORDS, DISTANCE = 8, 108
#: Classes compared by fingerprint at once.
TOGETHER = 1024
#: Names the empty set.
EMPTY = bytes(16)


def fingerprint(own: np.ndarray, words: int = WORDS) -> bytes:
    """Bits set in more than half of the hashes of a set, and of further hashes made of them."""
    total, step = np.zeros(64 * words, dtype=np.int64), (1 << 15) // words
    for low in range(0, len(own), step):
        raw = simhash.mixed(own[low : low + step, None], words).astype(">u8").view(np.uint8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(own)).tobytes()


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, same, set, fp`` of each row: the hash of its text, the name of its set and the fingerprint of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                names, codes = [], []
                for own in lsh_forest.sets_of(text.slice(low, high - low), shingle):
                    names.append(lsh_forest.digest(own) if len(own) else EMPTY)
                    codes.append(fingerprint(own))
                part = batch.slice(low, high - low)
                yield pa.record_batch([part.column("doc_id"), part.column("same"), pa.array(names, pa.binary()), pa.array(codes, pa.binary())], names=["doc_id", "same", "set", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, same long, set binary, fp binary")


def open_regions(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``region, set, root`` of classes (``set, fp, root``) near one of another component in their block value."""
    spark = classes.sparkSession
    blocks = {-1: [(b, *own[0]) for b, own in enumerate(simhash.blocks_of(WORDS, distance))]}
    keyed = simhash.dealt(classes, blocks, keep=("set", "root"))
    keyed = common.stored(keyed.select(F.xxhash64("block", "value").alias("region"), "set", "root"))
    sizes = common.stored(lsh_forest.shares(keyed))
    rows = lsh_forest.dealt(keyed, sizes, TOGETHER).join(classes.select("set", "fp"), "set")
    count = sizes.agg(F.coalesce(F.sum(F.col("n_main") + F.col("n_rest")), F.lit(0))).first()[0]
    parts = common.tasks(spark, count, lsh_forest.TASK_ROWS // 4)

    def run(table: pa.Table) -> pa.Table:
        codes = simhash.codes_of(table.column("fp").to_pylist())
        _, root = np.unique(np.array(table.column("root").to_pylist(), dtype="S16"), return_inverse=True)
        found = [np.zeros(0, dtype=np.int64)]
        for cell in lsh_forest.cells_of(table):
            if (root[cell] == root[cell[0]]).all():
                continue
            own, label, near = codes[cell], root[cell], np.zeros(len(cell), dtype=bool)
            for at in range(0, len(cell), 64):
                far = np.bitwise_count(own[at : at + 64, None, :] ^ own[None, :, :]).sum(axis=2, dtype=np.int64)
                near |= ((far <= distance) & (label[at : at + 64, None] != label[None, :])).any(axis=0)
            found.append(cell[near])
        return table.select(["region", "set", "root"]).take(pa.array(np.concatenate(found)))

    task = F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("task")
    return rows.groupBy(task).applyInArrow(run, "region long, set binary, root binary").distinct()


def linked(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``node, root``: the component of each class (``set, fp``) that is not the smallest of one."""
    one = common.stored(classes.groupBy("fp").agg(F.min("set").alias("set")))
    names = one.select(F.col("fp").alias("of"), F.col("set").alias("named"))
    hung = simhash.links(one.select("fp"), DISTANCE, WORDS).distinct()
    hung = hung.join(names, F.col("u") == F.col("of")).select(F.col("named").alias("u"), "v")
    hung = hung.join(names, F.col("v") == F.col("of")).select("u", F.col("named").alias("v"))
    # Classes with equal fingerprints are candidates of the first of them.
    equal = classes.join(names, F.col("fp") == F.col("of")).where("set <> named").select(F.col("set").alias("u"), F.col("named").alias("v"))
    pairs = common.stored(hung.union(equal))
    best = common.stored(pairs.groupBy("u").agg(F.min("v").alias("v")))
    wanted = best.select(F.col("u").alias("set")).union(best.select("v"))
    links = common.stored(lsh_forest.confirmed(best, lsh_forest.full_sets(docs, wanted, shingle), percent))
    roots = components(links)
    # Only candidates that the sets keep apart can still be linked with others.
    loose = components(pairs).select(F.col("node").alias("set"), F.col("root").alias("near"))
    rooted = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    rooted = rooted.join(loose, "set", "left").withColumn("near", F.coalesce("near", "set"))
    rooted = common.stored(rooted)
    mixed = rooted.groupBy("near").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("near")
    left = common.stored(rooted.join(mixed, "near", "left_semi").select("set", "fp", "root"))
    if left.isEmpty():
        return roots
    near = common.stored(open_regions(left))
    if near.isEmpty():
        return roots
    more = lsh_forest.compared(near, common.stored(lsh_forest.full_sets(docs, near, shingle)), percent)
    return components(links.union(common.stored(more)))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, same, set, root`` of each row; rows of one root are near copies."""
    own = common.stored(signed(docs, shingle))
    classes = common.stored(own.where(F.col("set") != F.lit(EMPTY)).groupBy("set").agg(F.first("fp").alias("fp")))
    roots = linked(docs, classes, shingle, percent).withColumnRenamed("node", "set")
    return own.drop("fp").join(roots, "set", "left").select("doc_id", "same", "set", F.coalesce("root", "set").alias("root"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest ``doc_id``, and of the smallest hash of its
    text if the id is there again. Repeated rows are copies. Rows without ``doc_id`` stay, all of them."""
    found = common.stored(near_copies(docs, shingle, percent).where("doc_id is not null"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("first"))
    others = found.join(first, "root").where(F.struct("doc_id", "same") != F.col("first"))
    row, copy, twice = common.fresh(docs, "row", "copy", "twice")
    others = common.stored(others.select(F.struct("doc_id", "same").alias(copy)).distinct())
    again = found.groupBy(F.struct("doc_id", "same").alias(twice)).count().where("count > 1").select(twice)
    again = common.stored(again)
    own = docs.withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same")))
    # The same plan at every size: the others grow with the documents.
    stay = own.join(others.hint("shuffle_hash"), F.col(row) == F.col(copy), "left_anti")
    if again.isEmpty():
        return stay.drop(row)
    once = stay.join(again, F.col(row) == F.col(twice), "left_anti")
    return once.unionByName(stay.join(again, F.col(row) == F.col(twice), "left_semi").dropDuplicates([row])).drop(row)
