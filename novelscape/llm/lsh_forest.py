"""Operator 12: near duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct shingles; documents with equal sets are one class. A class's signature has 128 minimal
hashes. The forest keeps 32 orders of signatures: in each, classes are sorted by a label of eight of the hashes, and those
that agree in the first four are a region. A region with too many classes goes one hash deeper, again and again, so depth
adapts to how crowded a region is. Two sets with a similarity of 0.85 share no region at depth 4 in 1 of 10^10 cases, at
depth 6 in 1 of 10^6 and at depth 8 in 4 of 10^5; regions that are still crowded there are compared part by part.

Links are found in three steps. First each class is compared with its best neighbor in the sorted orders, that with the
longest common prefix. What these confirmed links leave apart is compared within each region: pairs of different
components whose signatures allow the similarity (five deviations below it) are candidates, each in the first region that
the two share. Then each class is compared with the candidate whose signature agrees most, and what is still apart has its
full sets compared, many against many in one task; members of a region's main component meet those of others only. A link
counts only if the sets say so in whole numbers; sets are made again from the texts of the classes in question, found by a
bitmap of fixed size. Tasks return links that hang classes together, never all pairs.

Null and empty texts have an empty set and are linked with nothing. Texts of fewer words than a shingle have one shingle,
the whole text. A null ``doc_id`` belongs to the component of its set, but does not name it; a component of such rows has a
null name, and all of them are kept. Rows with equal ``doc_id`` stand by their own texts. Further columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.llm.components import components
from novelscape.llm.simhash import united
from novelscape.llm.token_ids import texts_of

SHINGLE, PERCENT = 3, 85
HASHES, TREES, DEPTH, DEEPEST = 128, 32, 4, 8
#: Rows of one task, classes of a region before it goes deeper, classes compared by signature and by set at once.
TASK_ROWS, CROWD, SIGNED, WHOLE = 100_000, 4096, 4096, 256
#: Bytes of shingle sets of one task.
TASK_BYTES = 32 << 20
#: Bits of the bitmap of wanted classes, as a power of two.
MARKS = 25
_ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and terms of the hashes, and the hashes of each tree's label."""
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(_ODD))
    draw = np.random.default_rng(12)
    first = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)
    more = [draw.permutation(np.setdiff1d(np.arange(HASHES), own))[: DEEPEST - DEPTH] for own in first]
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:], np.hstack([first, np.array(more)])


FACTORS, TERMS, LABELS = constants()


def sets_of(text: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    codes, distinct, offsets = common.words(text, lower=True)
    known = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    powers = np.array([pow(_ODD, k + 1, 1 << 64) for k in range(shingle)], dtype=np.uint64)
    whole = np.zeros(max(len(known) - shingle + 1, 0), dtype=np.uint64)
    for k in range(shingle):
        whole += known[k : k + len(whole)] * powers[k]
    whole = mixed(whole + np.uint64(shingle))
    for begin, end in zip(offsets, offsets[1:]):
        if end - begin >= shingle:
            yield np.unique(whole[begin : end - shingle + 1])
        else:
            few = known[begin:end]
            yield mixed((few * powers[: len(few)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(few)))[: len(few)]


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set."""
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 256):
        values = own[at : at + 256, None] * FACTORS
        values += TERMS
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def digest(own: np.ndarray) -> bytes:
    return hashlib.md5(own.tobytes()).digest()


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, set, signature`` of each row; ``set`` names the set and is null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                sizes, names, codes = [], [], []
                for own in sets_of(text.slice(low, high - low), shingle):
                    sizes.append(len(own))
                    names.append(digest(own) if len(own) else None)
                    codes.append(signature(own).tobytes() if len(own) else None)
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(codes, pa.binary())], names=["doc_id", "n_shingles", "set", "signature"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, set binary, signature binary")


def matrix(column: list[bytes], kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width)


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    width = values.shape[1] * values.itemsize
    offsets = pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def keys(codes: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """The regions at a depth of a tree, whose number is in the lowest bits."""
    key = np.full(len(codes), tree, dtype=np.uint64)
    for at in LABELS[tree, :depth]:
        key = mixed(key * np.uint64(_ODD) + codes[:, at])
    return (key & ~np.uint64(TREES - 1) | np.uint64(tree)).view(np.int64)


def homes(codes: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Keys by tree: two classes with the same one share a region of that tree. A ``crowded`` region is gone deeper, so
    that the last depth is what is known to be shared."""
    out = np.empty((len(codes), TREES), dtype=np.int64)
    for tree in range(TREES):
        out[:, tree] = keys(codes, tree, DEPTH)
        deep = np.isin(out[:, tree], crowded)
        out[deep, tree] = keys(codes[deep], tree, DEEPEST)
    return out


def labelled(classes: DataFrame) -> DataFrame:
    """``region, label, set`` of each class in each tree; the label is what follows the region's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = matrix(batch.column("signature").to_pylist(), "<u4", HASHES)
            for tree, own in enumerate(LABELS):
                yield pa.record_batch([pa.array(keys(codes, tree, DEPTH)), fixed(codes[:, own[DEPTH:]].astype(">u4")), batch.column("set")], names=["region", "label", "set"])

    return classes.select("set", "signature").mapInArrow(run, "region long, label binary, set binary")


def regions(rows: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with crowded regions gone deeper, hash by hash; ``part`` is set in those that are crowded at the last depth.
    And the regions that are crowded at the first depth, one for each ``crowd`` of its rows at most.

    ``rows`` may be made anew by each of a few readers; those of crowded regions are stored.
    """
    out, part, crowded = [], F.lit(None).cast("long").alias("part"), None
    for _ in range(DEPTH, DEEPEST):
        counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
        heavy = common.stored(counts.where(F.col("n") > crowd))
        if crowded is None:
            crowded = np.asarray(heavy.select("region").toArrow().column("region"), dtype=np.int64)
        if heavy.isEmpty():
            return reduce(DataFrame.unionByName, [*out, rows.select("*", part)]), crowded
        out.append(rows.join(heavy, "region", "left_anti").select("*", part))
        rows = rows.join(heavy, "region", "left_semi")
        tree = F.col("region").bitwiseAND(F.lit(TREES - 1))
        deeper = F.xxhash64("region", F.substring("label", 1, 4)).bitwiseAND(F.lit(-TREES)).bitwiseOR(tree)
        rows = rows.select(deeper.alias("region"), F.expr("substring(label, 5)").alias("label"), "set")
        rows = common.stored(rows)
    counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") > crowd, F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / crowd)))
    return reduce(DataFrame.unionByName, [*out, rows.join(counts, "region").withColumn("part", parts).drop("n")]), crowded


def neighbors(rows: DataFrame, parts: int) -> DataFrame:
    """Sorted orders: ``u, v, prefix``, neighbors in a region with the length of their common prefix; and, with null
    ``v``, the regions ``u`` is in that have more than one class. Parts of a region are sorted each by itself."""

    def run(table: pa.Table) -> pa.Table:
        region = np.asarray(table.column("region"), dtype=np.int64)
        labels = [x.ljust(16, b"\0") for x in table.column("label").to_pylist()]
        label = matrix(labels, ">u4", DEEPEST - DEPTH)
        part = np.asarray(table.column("part").fill_null(-1), dtype=np.int64)
        order = np.lexsort((*label.T[::-1], part, region))
        region, part, label = region[order], part[order], label[order]
        names = table.column("set").combine_chunks().take(pa.array(order))
        same = (region[1:] == region[:-1]) & (part[1:] == part[:-1])
        prefix = np.minimum.accumulate(label[1:] == label[:-1], axis=1).sum(axis=1)[same]
        first = np.flatnonzero(same)
        several = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False) | (part >= 0))
        pairs = pa.table({"u": names.take(pa.array(first)), "v": names.take(pa.array(first + 1)), "prefix": pa.array(prefix, pa.int32()), "region": pa.nulls(len(first), pa.int64())})
        members = pa.table({"u": names.take(pa.array(several)), "v": pa.nulls(len(several), pa.binary()), "prefix": pa.nulls(len(several), pa.int32()), "region": pa.array(region[several])})
        return pa.concat_tables([pairs, members])

    return rows.groupBy(F.pmod(F.xxhash64("region", "part"), F.lit(parts)).alias("task")).applyInArrow(run, "u binary, v binary, prefix int, region long")


def mark(names: list[bytes]) -> np.ndarray:
    return (matrix(names, "<u8", 2)[:, 0] >> np.uint64(64 - MARKS)).astype(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``set, shingles`` of the wanted classes, made from the texts again."""
    bitmap = common.bitmap(wanted.select("set"), lambda batch: mark(batch.column("set").to_pylist()), MARKS)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                out, made = {}, list(sets_of(text.slice(low, high - low), shingle))
                names = [digest(own) for own in made]
                for at in np.flatnonzero(common.in_bitmap(bits, mark(names))).tolist():
                    if len(made[at]) and names[at] not in seen:
                        seen.add(names[at])
                        out[names[at]] = made[at].tobytes()
                yield pa.record_batch([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["set", "shingles"])

    made = texts_of(docs).select("text").mapInArrow(run, "set binary, shingles binary")
    return made.join(wanted.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.first("shingles").alias("shingles"))


def of_marked(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set, signature`` of the wanted classes, and of a few others that share their bits."""
    bitmap = common.bitmap(wanted.select("set"), lambda batch: mark(batch.column("set").to_pylist()), MARKS)
    shared = classes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(common.in_bitmap(shared.value, mark(batch.column("set").to_pylist()))))

    return classes.select("set", "signature").mapInArrow(run, "set binary, signature binary")


def alike(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the intersection is ``percent`` of the union at least."""
    return 100 * inter >= percent * (a + b - inter)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that the full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                n = min(len(x), len(y))
                if 100 * n < percent * max(len(x), len(y)):
                    links.append(False)
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                links.append(bool(alike(np.count_nonzero(x[at] == y), len(x), len(y), percent)))
            yield batch.select(["u", "v"]).filter(pa.array(links, pa.bool_()))

    first = sets.select(F.col("set").alias("u"), F.col("shingles").alias("a"))
    second = sets.select(F.col("set").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(first, "u").join(second, "v").mapInArrow(run, "u binary, v binary")


def shares(members: DataFrame) -> DataFrame:
    """``region, main, n_main, n_rest`` of regions of several components: that of most members, their number, the others'."""
    roots = members.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    found = roots.groupBy("region").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_rest")
    )
    return found.where("n_rest > 0")


def dealt(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``members`` (``region, set, root``) with ``cell``: each two of a region's different components meet in one, of ``2 * most``
    or so at most. The main component's members need to meet the others only, so there are as many cells as those ask for."""
    return celled(members, sizes, most).withColumn("cell", F.explode("cells")).select(*members.columns, "cell")


def celled(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``members`` with ``cells``, those that each is in."""
    rows = members.join(sizes, "region").withColumn("is_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("a", F.ceil(F.col("n_main") / most).cast("int")).withColumn("b", F.ceil(F.col("n_rest") / most).cast("int"))
    is_main, own = F.col("is_main"), F.col("own")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.when(is_main, F.col("a")).otherwise(F.col("b"))).cast("int"))
    across = F.transform(
        F.sequence(F.lit(0), F.when(is_main, F.col("b")).otherwise(F.col("a")) - 1),
        lambda o: F.xxhash64("region", F.when(is_main, own).otherwise(o), F.when(is_main, o).otherwise(own)),
    )
    among = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.xxhash64("region", F.least(own, o), F.greatest(own, o), F.lit(1)))
    cells = F.when(is_main | (F.col("b") == 1), across).otherwise(F.concat(across, among))
    return rows.withColumn("cells", cells).select(*members.columns, "cells")


def allowed(percent: int) -> int:
    """Agreeing hashes from which two sets may be similar enough, five deviations below what is expected."""
    p = percent / 100
    return int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)


def cells_of(table: pa.Table) -> Iterator[np.ndarray]:
    """Rows of each cell."""
    cell = np.asarray(table.column("cell"), dtype=np.int64)
    order = np.argsort(cell, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ()


def others(label: np.ndarray) -> np.ndarray:
    """Rows of any but the most frequent label."""
    return np.flatnonzero(label != np.bincount(label).argmax())


def apart(members: DataFrame, classes: DataFrame, crowded: np.ndarray, least: int) -> DataFrame:
    """``region, set, root, mate, agree`` of members that a signature of another component in their region may be similar to,
    with the one that agrees most; a pair counts in the first tree that has it in one region. Members of several cells repeat."""
    spark = members.sparkSession
    sizes = common.stored(shares(members))
    open_ = members.join(sizes.select("region"), "region", "left_semi")
    rows = dealt(members, sizes, SIGNED).join(of_marked(classes, open_), "set")
    count = sizes.agg(F.coalesce(F.sum(F.col("n_main") + F.col("n_rest")), F.lit(0))).first()[0]
    parts = common.tasks(spark, count, TASK_ROWS // 4)
    shared = spark.sparkContext.broadcast(crowded)

    def run(table: pa.Table) -> pa.Table:
        codes = matrix(table.column("signature").to_pylist(), "<u4", HASHES)
        _, root = np.unique(np.array(table.column("root").to_pylist(), dtype="S16"), return_inverse=True)
        trees = np.asarray(table.column("region"), dtype=np.int64) & (TREES - 1)
        home = homes(codes, shared.value)
        found, mates, most = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for cell in cells_of(table):
            own, before = codes[cell], home[cell, : trees[cell[0]]]
            label = np.unique(root[cell], return_inverse=True)[1]
            rest = others(label)
            best, mate = np.zeros(len(cell), dtype=np.uint8), np.zeros(len(cell), dtype=np.int64)
            for at in range(0, len(rest), 64):
                some = rest[at : at + 64]
                agree = np.zeros((len(some), len(own)), dtype=np.uint8)
                for h in range(HASHES):
                    agree += own[some, h, None] == own[None, :, h]
                agree[(agree < least) | (label[some, None] == label[None, :])] = 0
                x, y = np.nonzero(agree)
                for low in range(0, len(x), 1 << 16):
                    i, j = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
                    known = (before[some[i]] == before[j]).any(axis=1)
                    agree[i[known], j[known]] = 0
                for near, who, which in ((agree.max(axis=0), some[agree.argmax(axis=0)], np.arange(len(cell))), (agree.max(axis=1), agree.argmax(axis=1), some)):
                    more = near > best[which]
                    best[which[more]], mate[which[more]] = near[more], who[more]
            near = np.flatnonzero(best)
            found.append(cell[near])
            mates.append(cell[mate[near]])
            most.append(best[near].astype(np.int64))
        out = table.select(["region", "set", "root"]).take(pa.array(np.concatenate(found)))
        out = out.append_column("mate", table.column("set").take(pa.array(np.concatenate(mates))))
        return out.append_column("agree", pa.array(np.concatenate(most), pa.int32()))

    task = F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("task")
    return rows.groupBy(task).applyInArrow(run, "region long, set binary, root binary, mate binary, agree int")


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links of full sets that join what is apart in a region."""
    shared = common.stored(shares(members))
    rows = dealt(members, shared, WHOLE).join(sets, "set")
    # Weighed before the sets are dealt out to cells.
    copies = celled(members, shared, WHOLE).groupBy("set").agg(F.sum(F.size("cells")).alias("n"))
    weight = copies.join(sets, "set").agg(F.coalesce(F.sum(F.col("n") * (F.length("shingles") + 100)), F.lit(0))).first()[0]
    parts = common.tasks(rows.sparkSession, weight, TASK_BYTES)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, sets, out = rows["set"].tolist(), [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]], []
        _, root = np.unique(rows["root"].to_numpy().astype("S16"), return_inverse=True)
        cell = rows["cell"].to_numpy()
        for number in np.unique(cell):
            own = np.flatnonzero(cell == number)
            place = np.unique(root[own], return_inverse=True)[1]
            rest = others(place)
            if not len(rest):
                continue
            sizes = np.array([len(sets[i]) for i in own])
            _, ids = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
            ends = np.cumsum(sizes)
            starts, held = ends - sizes, np.zeros(ids.max() + 1, dtype=np.int32)
            label = np.arange(place.max() + 1)
            for i in rest.tolist():
                mine = ids[starts[i] : ends[i]]
                held[mine] = 1
                inter = np.add.reduceat(held[ids], starts)
                held[mine] = 0
                hits = np.flatnonzero(alike(inter, sizes[i], sizes, percent) & (label[place] != label[place[i]]))
                for j in hits.tolist():
                    if label[place[i]] != label[place[j]]:
                        out.append((names[own[i]], names[own[j]]))
                        label = united(label, place[i : i + 1], place[j : j + 1])
        return pd.DataFrame(out, columns=["u", "v"])

    return rows.groupBy(F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("task")).applyInPandas(run, "u binary, v binary")


def linked(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, crowd: int = CROWD) -> DataFrame:
    """``node, root``: the component of each class that is not the smallest of one."""
    spark = docs.sparkSession
    parts = common.tasks(spark, TREES * classes.count(), TASK_ROWS)
    path = common.scratch(spark)
    dense, crowded = regions(labelled(classes), crowd)
    found = common.stored(neighbors(dense, parts), path)
    pairs = found.where("v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "prefix")
    best = common.stored(pairs.groupBy("u").agg(F.max_by("v", F.struct("prefix", "v")).alias("v")))
    wanted = best.select(F.col("u").alias("set")).union(best.select("v"))
    roots = components(common.stored(confirmed(best, full_sets(docs, wanted, shingle), percent)))
    members = rooted(found.where("v is null").select("region", F.col("u").alias("set")), roots)
    common.drop(spark, path)
    open_ = common.stored(apart(members, classes, crowded, allowed(percent)))
    if open_.isEmpty():
        return roots
    sets = common.stored(full_sets(docs, open_, shingle))
    best = open_.groupBy("set").agg(F.max_by("mate", F.struct("agree", "mate")).alias("mate"))
    best = common.stored(best.select(F.greatest("set", "mate").alias("u"), F.least("set", "mate").alias("v")).distinct())
    roots = joined(roots, confirmed(best, sets, percent))
    members = rooted(open_.select("region", "set").distinct(), roots)
    open_ = common.stored(apart(members, classes, crowded, allowed(percent)))
    if open_.isEmpty():
        return roots
    return joined(roots, compared(open_.select("region", "set", "root").distinct(), sets, percent))


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``region, set, root`` of members (``region, set``); a class that hangs on no other is its own root."""
    found = members.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    return common.stored(found.select("region", "set", "root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``roots`` and more links."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(common.stored(links)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; a component is named by its smallest ``doc_id``."""
    spark = docs.sparkSession
    path = common.scratch(spark)
    own = common.stored(signed(docs, shingle), path)
    classes = own.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    classes = common.stored(classes)
    # Of the rows only their classes are kept, as signatures are with those.
    own = common.stored(own.drop("signature"))
    common.drop(spark, path)
    roots = linked(docs, classes, shingle, percent)
    rooted = classes.select("set", "least").join(roots, classes["set"] == roots.node, "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("set", "component_id")
    found = own.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
