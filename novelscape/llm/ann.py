"""Operator 3: approximate nearest neighbours by an inverted multi-index.

The two halves of each vector are quantised separately; a pair of centroids is a cell. A query walks the pairs by their
summed distance (here: falling sum of inner products) with a heap until the cells hold ``fraction`` of all vectors, and
at least ``least``. Cells lie in blocks of bounded size; a query goes once to each block in which it walked cells, and
the block reranks the entries of those cells with the original vectors. A cell with too many entries fills several
blocks.

Centroids are fitted on at most ``sample`` vectors; every vector is indexed. Equal vectors are one entry with the
smallest ids that can still be among the nearest: as ties go to the smaller id, no others could be returned.

Vectors that are null or zero, hold null or non-finite components, have no id, or another dimension than most (the
larger one if there are as many) take no part. Rows with equal id and vector count once; a query never returns its own
id. Further columns are not read. Empty tables give empty results. With fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from novelscape.llm import common

K, CENTROIDS, FRACTION, LEAST = 20, 128, 0.4, 2000
#: Vectors that centroids are fitted on at most.
SAMPLE = 16_384
#: Entries of a block, and queries that meet a block in one task.
BLOCK, QUERIES = 8192, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = plain.where(F.col("id").isNotNull() & v.isNotNull() & finite & some)
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("v") == (most.d if most else 0))


def kmeans(x: np.ndarray, n: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[draw.choice(len(distinct), min(n, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> np.ndarray:
    """Which cells a query walks: pairs by falling sum of their scores, until they hold ``need`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = (-first[a]).tolist(), (-second[b]).tolist()
    size = counts.reshape(len(x), len(y))[np.ix_(a, b)].tolist()
    heap, held, walked = [(x[0] + y[0], 0, 0)], 0, []
    while heap and held < need:
        _, i, j = heap[0]
        walked.append((i, j))
        held += size[i][j]
        # The pair's right neighbor takes its place; the first of a row opens the next row.
        if j + 1 < len(y):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    out = np.zeros(len(counts), dtype=bool)
    i, j = np.array(walked).T
    out[a[i] * len(y) + b[j]] = True
    return out


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell; cells lie side by side until a block is full."""
    first, split, block, held = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > BLOCK:
            block += held > 0
            split[cell] = -(-n // BLOCK)
            first[cell], block, held = block, block + split[cell], 0
            continue
        if held + n > BLOCK:
            block, held = block + 1, 0
        first[cell], held = block, held + n
    return first, split


def search(vectors: DataFrame, queries: DataFrame, k: int = K, fraction: float = FRACTION, least: int = LEAST, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` found with the largest inner product."""
    spark = vectors.sparkSession
    rows = common.stored(usable(vectors))
    asked = common.stored(usable(queries).distinct())
    smallest = Window.partitionBy("v").orderBy("id")
    single = rows.withColumn("nth", F.dense_rank().over(smallest)).where(F.col("nth") <= k + 1)
    entries = common.stored(single.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    fitted = common.hash_sample(entries, sample, "v", F.col("ids")[0]).select("v").toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not fitted.num_rows or asked.isEmpty():
        return spark.createDataFrame([], out)
    x = matrix(fitted.column("v"))
    half = x.shape[1] // 2
    books = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            x = matrix(batch.column("v"))
            cell = nearest(x[:, :half], one) * len(two) + nearest(x[:, half:], two) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    index = common.stored(entries.mapInArrow(assign, "v array<double>, ids array<long>, cell int"))
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for row in index.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[row.cell] = row["count"]
    first, split = layout(counts)
    need = max(int(np.ceil(fraction * counts.sum())), least)
    plan = spark.sparkContext.broadcast((counts, first, split))
    groups = -(-asked.count() // QUERIES)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        counts, first, split = plan.value
        for batch in batches:
            x, ids, v = matrix(batch.column("v")), batch.column("id").to_pylist(), batch.column("v")
            rows, blocks, bits = [], [], []
            for r, query in enumerate(x):
                walked = np.flatnonzero(walk(one @ query[:half], two @ query[half:], counts, need) & (counts > 0))
                cells = np.repeat(walked, split[walked])
                block = np.repeat(first[walked], split[walked]) + common.ragged(np.zeros(len(walked), dtype=np.int64), split[walked])
                order = np.argsort(block, kind="stable")
                where, at = np.unique(block[order], return_index=True)
                for b, own in zip(where.tolist(), np.split(cells[order], at[1:])):
                    mask = np.zeros(own[-1] - own[0] + 1, dtype=bool)
                    mask[own - own[0]] = True
                    rows.append(r), blocks.append(b), bits.append(int(own[0]).to_bytes(4, "little") + np.packbits(mask).tobytes())
            yield pa.record_batch(
                [pa.array([ids[r] for r in rows], pa.int64()), v.take(pa.array(rows, pa.int64())), pa.array(blocks, pa.int64()), pa.array(bits, pa.binary())],
                names=["id", "v", "block", "bits"],
            )

    def rerank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "ids", "score"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        entry, cell, asks = matrix(left.column("v")), np.asarray(left.column("cell")), matrix(right.column("v"))
        low, q, e = int(cell.min()), [], []
        width = int(cell.max()) - low + 1
        for begin in range(0, len(asks), 256):
            some = asks[begin : begin + 256]
            open_ = np.zeros((len(some), width), dtype=bool)
            for r, bits in enumerate(right.column("bits").slice(begin, len(some)).to_pylist()):
                mask = np.unpackbits(np.frombuffer(bits[4:], dtype=np.uint8)).astype(bool)
                at = np.flatnonzero(mask) + int.from_bytes(bits[:4], "little") - low
                open_[r, at[(at >= 0) & (at < width)]] = True
            score = np.where(open_[:, cell - low], some @ entry.T, -np.inf)
            # One more than asked for, as the query's own vector is among them; ties at the end are all kept.
            kept = min(k + 1, score.shape[1])
            last = np.partition(score, score.shape[1] - kept, axis=1)[:, score.shape[1] - kept]
            r, c = np.nonzero((score >= last[:, None] - 1e-9) & (score > -np.inf))
            q.append(r + begin), e.append(c)
        q, e = np.concatenate(q), np.concatenate(e)
        exact = np.einsum("ij,ij->i", asks[q], entry[e])
        return pa.table(
            [right.column("id").take(pa.array(q)), left.column("ids").take(pa.array(e)), pa.array(exact, pa.float64())], names=names
        )

    placed = index.mapInArrow(place(plan), "v array<double>, ids array<long>, cell int, block long, split long")
    placed = placed.withColumn("block", F.col("block") + F.pmod(F.xxhash64("ids"), F.col("split"))).drop("split")
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    routed = asked.repartition(common.tasks(spark, groups * QUERIES, 512)).mapInArrow(route, "id long, v array<double>, block long, bits binary")
    routed = routed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    met = placed.groupBy("block", "group").cogroup(routed.groupBy("block", "group"))
    pairs = met.applyInArrow(rerank, "query_id long, ids array<long>, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    best = pairs.withColumn("nth", F.rank().over(near)).where(F.col("nth") <= k + 1)
    ids = best.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    ids = ids.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ids.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def place(plan):
    """Block and number of blocks of each entry's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, split = plan.value
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            yield pa.record_batch([*batch.columns, pa.array(first[cell], pa.int64()), pa.array(split[cell], pa.int64())], names=[*batch.schema.names, "block", "split"])

    return run
