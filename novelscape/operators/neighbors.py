"""Exact k nearest neighbors of vectors.

Identical vectors are collapsed first: a point carries the number of its copies, so
copies cost nothing however many there are.  Points are assigned to the nearest of a
bounded set of pivots.  From the distances to the pivots each cell of query points gets
an upper bound on its k-th neighbor distance, and a reference point is compared only with
cells where a lower bound does not exceed it (triangle inequality and bisecting plane; Lu,
Shen, Chen, Ooi, "Efficient processing of k nearest neighbor joins using MapReduce",
PVLDB 2012).  Cells are cut into blocks of bounded size, and each task compares one query
block with one reference block and keeps the k best per query point.  No candidate is
dropped other than by these bounds, so the result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from novelscape.operators.tokens import ENTITY, top_per_group
from novelscape.session import settle

CELL_POINTS = 2048
MAX_PIVOTS = 2048
# What is read grows with the number of blocks, so blocks are as large as a task can take.
MIN_BLOCK = 1024
MAX_BLOCK = 32_768
BLOCK_PAIRS_PER_CORE = 8
# Cells are used if the bounds rule out at least this share of the comparisons.
WORTHWHILE = 0.3
_SLICE = 256
_PROBE = 512
_PAIRS = 65_536
# Points up to which their ids are broadcast to pick their vectors out of those of all entities.
FEW_POINTS = 1 << 18
# Names a vector by two hashes of 64 bits.
_KEY = ("_key", "_more")


@dataclass(frozen=True)
class Collapsed:
    """Settled: the entities with the names of their vectors, and the distinct vectors ``point, z, last, copies`` with theirs."""

    members: DataFrame
    points: DataFrame


def collapse(vectors: DataFrame) -> Collapsed:
    """Entities and their distinct vectors; ``vectors`` is read twice and need not be settled if it gives the same rows again.

    Vectors are not shuffled, only their hashes, so that copies cost some bytes however wide they are.
    """
    named = vectors.select(ENTITY, "z", F.xxhash64("z").alias(_KEY[0]), F.xxhash64(F.lit(1), "z").alias(_KEY[1]))
    members = settle(named.select(ENTITY, *_KEY))
    groups = settle(
        members.groupBy(*_KEY).agg(F.min(ENTITY).alias("point"), F.max(ENTITY).alias("last"), F.count(F.lit(1)).alias("copies"))
    )
    side = groups.withColumn(ENTITY, F.col("point"))
    if groups.count() <= FEW_POINTS:
        side = F.broadcast(side)
    # A repeated row is one point.
    points = named.join(side, [ENTITY, *_KEY]).dropDuplicates(list(_KEY))
    return Collapsed(members, settle(points.select("point", "z", "last", "copies", *_KEY)))


def distinct_points(vectors: DataFrame) -> DataFrame:
    """``point, z, copies, last``: one row per distinct vector, named by its smallest id."""
    return vectors.groupBy("z").agg(
        F.min(ENTITY).alias("point"), F.max(ENTITY).alias("last"), F.count(F.lit(1)).alias("copies")
    )


@dataclass(frozen=True)
class _Cells:
    """Pivots and what is known of the query cells around them."""

    pivots: np.ndarray
    outer: np.ndarray  # largest distance of a query point to its pivot
    inner: np.ndarray  # smallest distance
    bound: np.ndarray  # upper bound on the k-th neighbor distance, -1 for cells without queries

    @cached_property
    def between(self) -> np.ndarray:
        return _distances(self.pivots, self.pivots)

    def own(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distances = _distances(z, self.pivots)
        cell = distances.argmin(axis=1)
        return cell, distances[np.arange(len(z)), cell]

    def needed(self, z: np.ndarray) -> np.ndarray:
        """Mask (points x cells): where a reference point may be among the k nearest."""
        far = _distances(z, self.pivots)
        own = far.argmin(axis=1)
        return self._needed(far, own, far[np.arange(len(z)), own], np.arange(len(self.pivots)))

    def needed_by(self, cell: int, z: np.ndarray, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Mask of reference points for one cell; their own cells and the distances to those pivots are known."""
        far = _distances(z, self.pivots[cell : cell + 1])
        return self._needed(far, own, near, np.array([cell]))[:, 0]

    def _needed(self, far: np.ndarray, own: np.ndarray, near: np.ndarray, some: np.ndarray) -> np.ndarray:
        outer, bound = self.outer[some], self.bound[some]
        low = np.maximum(far - outer, self.inner[some] - far)
        apart = self.between[own[:, None], some]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (far**2 - near[:, None] ** 2) / (2 * apart)
        low = np.maximum(low, np.where(apart > 0, plane, 0.0))
        slack = 1e-9 * (1.0 + far + outer)
        return (low <= bound + slack) & (bound >= 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(whole), -1)


def _lowest(score: np.ndarray, want: int, chunk: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the finite scores that ``slack`` allows to be among the ``want`` lowest of their row.

    Columns are dealt over chunks of ``chunk``.  The ``want``-th lowest of the chunks' lowest ones bounds that of all, and few
    chunks have any below it, so the others are not looked at again.
    """
    score = score.reshape(len(score), chunk, -1)
    best = score.min(axis=1)
    limit = (np.partition(best, want - 1, axis=1)[:, want - 1] + slack).astype(np.float32)
    rows, chunks = np.nonzero(best <= limit[:, None])
    some = score[rows, :, chunks]
    hits, inside = np.nonzero((some <= limit[rows, None]) & np.isfinite(some))
    return rows[hits], inside * best.shape[1] + chunks[hits]


def _k_best(
    query_ids: np.ndarray, q: np.ndarray, ref_ids: np.ndarray, r: np.ndarray, k: int, skip_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k nearest references per query, ties by reference id."""
    order = np.argsort(ref_ids, kind="stable")
    r = r[order]
    lookup = pd.Index(ref_ids[order]) if skip_self else None
    # Per query |r|^2 - 2 q.r orders the references as the distance does.  Single precision
    # only picks candidates; the slack bounds its rounding error (d terms of size |q||r| and |r|^2).
    # Moving and scaling both sides keeps the order and the numbers in range.
    middle = r.mean(axis=0)
    scale = max(np.abs(r - middle).max(), np.abs(q - middle).max()) or 1.0
    moved = (r - middle) / scale
    r2 = (moved**2).sum(1)
    largest = math.sqrt(r2.max())
    want = min(k, len(r))
    # References are dealt over chunks; those that fill the last ones are infinitely far.
    chunk = -(-len(r) // max(_PROBE, 4 * k))
    fill = -len(r) % chunk
    rhs = np.vstack([-2.0 * moved.T, r2])
    rhs = np.hstack([rhs, np.vstack([np.zeros((r.shape[1], fill)), np.full((1, fill), np.inf)])]).astype(np.float32)
    found_rows, found_cols, found_dist = [], [], []
    for start in range(0, len(q), _SLICE):
        part = q[start : start + _SLICE]
        near = (part - middle) / scale
        score = np.hstack([near, np.ones((len(part), 1))]).astype(np.float32) @ rhs
        if skip_self:
            at = lookup.get_indexer(query_ids[start : start + _SLICE])
            hit = np.nonzero(at >= 0)[0]
            score[hit, at[hit]] = np.inf
        norms = np.sqrt((near**2).sum(1))
        slack = (r.shape[1] + 8) * 2.0**-23 * largest * (2 * norms + largest) + 1e-30
        rows, cols = _lowest(score, want, chunk, 2 * slack)
        dist = np.empty(len(rows))
        for s in range(0, len(rows), _PAIRS):
            cut = slice(s, s + _PAIRS)
            dist[cut] = np.sqrt(((part[rows[cut]] - r[cols[cut]]) ** 2).sum(axis=1))
        sort = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[sort], cols[sort], dist[sort]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        found_rows.append(rows[keep] + start)
        found_cols.append(order[cols[keep]])
        found_dist.append(dist[keep])
    return np.concatenate(found_rows), np.concatenate(found_cols), np.concatenate(found_dist)


def _size(points: DataFrame) -> tuple[int, int]:
    """Number of points and of entities."""
    row = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    return row[0], row[1]


def nearest_points(
    queries: DataFrame, references: DataFrame, k: int, skip_self: bool, n_queries: int, n_references: int
) -> DataFrame:
    """``point, neighbor, dist, copies``: the k nearest reference points per query point.

    Both inputs have ``point, z, copies`` and are read several times; pass settled tables.
    With ``skip_self`` a point is no neighbor of itself.
    """
    query_id, ref_id = (df.schema["point"].dataType for df in (queries, references))
    pivots = _pivots(references, n_references)
    cells, query_sizes, own_sizes = None, np.array([n_queries]), np.array([n_references])
    if len(pivots) > 1:
        bounds, sizes, ref_sizes, dealt_sizes = _bounds(queries, references, pivots, k + 1 if skip_self else k)
        kept = float((sizes * ref_sizes).sum()) / max(1.0, float(n_queries) * n_references)
        if kept <= 1 - WORTHWHILE:
            cells, query_sizes, own_sizes = bounds, sizes, dealt_sizes
    cores = queries.sparkSession.sparkContext.defaultParallelism
    fair = math.sqrt(float(n_queries) * n_references / (BLOCK_PAIRS_PER_CORE * cores))
    block = max(MIN_BLOCK, min(MAX_BLOCK, math.ceil(fair)))
    mine = query_points = _packed(queries, cells, query_sizes, block)
    if references is not queries:
        mine = _packed(references, cells, own_sizes, block)
    left = query_points.select(*[F.col(c).alias(f"q_{c}") for c in _BLOCK])
    right = mine.select(*[F.col(c).alias(f"r_{c}") for c in _BLOCK])
    query_arrow, ref_arrow = to_arrow_type(query_id), to_arrow_type(ref_id)
    names = ["point", "neighbor", "dist", "copies"]

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                query_ids, q, query_cell = (batch.column(f"q_{c}")[row] for c in ("points", "z", "cell"))
                ref_ids, r, ref_cell, copies = (batch.column(f"r_{c}")[row] for c in ("points", "z", "cell", "copies"))
                query_ids, ref_ids, copies = query_ids.values, ref_ids.values, copies.values
                q, r = (np.frombuffer(z.as_buffer(), dtype=np.float64).reshape(n, -1) for z, n in ((q, len(query_ids)), (r, len(ref_ids))))
                query_cell, ref_cell = (c.values.to_numpy(zero_copy_only=False) for c in (query_cell, ref_cell))
                if cells is not None:
                    near = np.sqrt(((r - cells.pivots[ref_cell]) ** 2).sum(axis=1))
                for cell in np.unique(query_cell):
                    own, others = np.flatnonzero(query_cell == cell), slice(None)
                    if cells is not None:
                        others = np.flatnonzero(cells.needed_by(cell, r, ref_cell, near))
                        if not len(others):
                            continue
                    own_ids, other_ids = query_ids.take(pa.array(own)), ref_ids
                    other_copies = copies
                    if cells is not None:
                        other_ids, other_copies = ref_ids.take(pa.array(others)), copies.take(pa.array(others))
                    rows, cols, dist = _k_best(
                        own_ids.to_numpy(zero_copy_only=False), q[own], other_ids.to_numpy(zero_copy_only=False), r[others], k, skip_self
                    )
                    found = [own_ids.take(pa.array(rows)).cast(query_arrow), other_ids.take(pa.array(cols)).cast(ref_arrow), pa.array(dist), other_copies.take(pa.array(cols))]
                    yield pa.RecordBatch.from_arrays(found, names=names)

    # Each task reads one block of either side from its checkpoint.
    found = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(
        compare, f"point {query_id.simpleString()}, neighbor {ref_id.simpleString()}, dist double, copies long"
    )
    return top_per_group(found, "point", ["dist", "neighbor"], k)


_BLOCK = ("points", "z", "copies", "cell")


def _packed(points: DataFrame, cells: _Cells | None, sizes: np.ndarray, most: int) -> DataFrame:
    """``points, z, copies, cell``: a settled table of blocks, one row and one partition each, of about ``most`` points.

    A large cell is dealt over several blocks, and small ones share one.
    """
    first, count, at, filled = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if filled and filled + size > most:
            at, filled = at + 1, 0
        first[cell], count[cell] = at, max(1, math.ceil(size / most))
        at, filled = (at + count[cell], 0) if count[cell] > 1 else (at, filled + size)
    ident = points.schema["point"].dataType
    slot = F.pmod(F.xxhash64("point"), F.lit(2**31 - 1)).alias("slot")

    def place(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cell = np.zeros(part.num_rows, dtype=np.int64) if cells is None else cells.own(_matrix(part["z"]))[0]
                block = first[cell] + part["slot"].to_numpy(zero_copy_only=False) % count[cell]
                columns = [part["point"], part["z"], part["copies"], pa.array(cell, pa.int32()), pa.array(block, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["point", "z", "copies", "cell", "block"])

    def pack(batches):
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        z = pa.array([np.concatenate([_matrix(batch["z"]) for batch in parts]).tobytes()], pa.binary())
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.concat_arrays(rows[c].chunks))
        yield pa.RecordBatch.from_arrays([whole("point"), z, whole("copies"), whole("cell")], names=list(_BLOCK))

    kind = ident.simpleString()
    placed = points.select("point", "z", "copies", slot).mapInArrow(place, f"point {kind}, z array<double>, copies long, cell int, block int")
    dealt = placed.repartitionById(int(at + (filled > 0)) or 1, "block").drop("block")
    return settle(dealt.mapInArrow(pack, f"points array<{kind}>, z binary, copies array<long>, cell array<int>"))


def _pivots(references: DataFrame, size: int) -> np.ndarray:
    """A reproducible sample of points, at most ``MAX_PIVOTS``."""
    wanted = min(MAX_PIVOTS, max(1, math.ceil(size / CELL_POINTS)))
    if wanted == 1:
        return np.zeros((1, 1))
    # A limit takes that many rows of every partition to the driver, so only the small hashes are ordered.
    key = F.xxhash64("z")
    share = min(1.0, (2 * wanted + 64) / size)
    small = references.where(key <= int(-(2**63) + share * (2**64 - 2048)))
    rows = small.orderBy(key, "point").limit(wanted).select("z").collect()
    return np.array([r["z"] for r in rows], dtype=np.float64)


def _bounds(
    queries: DataFrame, references: DataFrame, pivots: np.ndarray, need: int
) -> tuple[_Cells, np.ndarray, np.ndarray, np.ndarray]:
    """Cell bounds, and per cell the query points, the references they are compared with and the references in it.

    What is collected is bounded by the number of pivots.
    """
    empty = np.zeros(len(pivots))
    bare = _Cells(pivots, empty, empty, empty)

    def reach(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                cell, near = bare.own(_matrix(batch.slice(start, 1024)["z"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(near)], names=["cell", "reach"]
                )

    def reaches(df: DataFrame) -> DataFrame:
        return df.select("z").mapInArrow(reach, "cell int, reach double")

    outer, inner = np.zeros(len(pivots)), np.zeros(len(pivots))
    query_sizes, ref_sizes = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64)
    edges = reaches(queries).groupBy("cell").agg(
        F.max("reach").alias("outer"), F.min("reach").alias("inner"), F.count(F.lit(1)).alias("n")
    )
    for row in edges.collect():
        outer[row["cell"]], inner[row["cell"]] = row["outer"], row["inner"]
        query_sizes[row["cell"]] = row["n"]
    closest = top_per_group(reaches(references), "cell", ["reach"], need).toPandas()
    between = bare.between
    bound = np.full(len(pivots), -1.0)
    at, close = closest["cell"].to_numpy(), closest["reach"].to_numpy()
    for cell in np.nonzero(query_sizes)[0]:
        upper = between[cell, at] + close
        bound[cell] = np.partition(upper, need - 1)[need - 1] + outer[cell] if len(upper) >= need else np.inf
    cells = _Cells(pivots, outer, inner, bound)

    def tally(batches):
        total, inside = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                z = _matrix(batch.slice(start, 1024)["z"])
                total += cells.needed(z).sum(axis=0)
                inside += np.bincount(cells.own(z)[0], minlength=len(pivots))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pivots)), pa.int32()), pa.array(total), pa.array(inside)], names=["cell", "n", "own"]
        )

    counts = references.select("z").mapInArrow(tally, "cell int, n long, own long")
    own_sizes = np.zeros(len(pivots), dtype=np.int64)
    for row in counts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect():
        ref_sizes[row["cell"]], own_sizes[row["cell"]] = row["n"], row["own"]
    return cells, query_sizes, ref_sizes, own_sizes


def _summary(points: DataFrame, near: DataFrame, k: int, loo: bool) -> DataFrame:
    """Mean, k-th and nearest distance per query point, counting each neighbor's copies."""
    before = Window.partitionBy("point").orderBy("dist", "neighbor").rowsBetween(Window.unboundedPreceding, -1)
    own = points.select("point", "last", "copies", *_KEY).withColumnRenamed("copies", "_own")
    twins = F.least(F.col("_own") - 1, F.lit(k).cast("long")) if loo else F.lit(0).cast("long")
    filled = near.withColumn("_before", F.coalesce(F.sum("copies").over(before), F.lit(0).cast("long")))
    joined = own.join(filled, "point", "left").withColumn("_twins", twins)
    room = F.greatest(F.lit(0).cast("long"), F.lit(k) - F.col("_twins") - F.col("_before"))
    used = F.least(F.col("copies"), room)
    return (
        joined.withColumn("_used", used)
        .groupBy("point", "last", *_KEY)
        .agg(
            (F.coalesce(F.sum(F.col("_used") * F.col("dist")), F.lit(0.0)) / k).alias("knn_mean_dist"),
            F.coalesce(F.max(F.when(F.col("_used") > 0, F.col("dist"))), F.lit(0.0)).alias("knn_kth_dist"),
            F.min("dist").alias("_dist"),
            F.min_by("neighbor", F.struct("dist", "neighbor")).alias("_neighbor"),
            F.max("_twins").alias("_twins"),
        )
    )


def leave_one_out(vectors: DataFrame, k: int, collapsed: Collapsed | None = None) -> DataFrame:
    """``entity_id, knn_mean_dist, knn_kth_dist, nearest_dist, nearest_id`` of each entity among the others.

    ``vectors`` has ``entity_id, z``.  Ties go to the smallest id; an entity with copies is
    nearest to the smallest of them, and that one to the largest.
    """
    collapsed = collapsed or collapse(vectors)
    points = collapsed.points
    n, total = _size(points)
    k = min(k, max(1, total - 1))
    scored = _summary(points, nearest_points(points, points, k, True, n, n), k, loo=True)
    twin = F.when(F.col(ENTITY) == F.col("point"), F.col("last")).otherwise(F.col("point"))
    return collapsed.members.join(scored, list(_KEY)).select(
        ENTITY,
        "knn_mean_dist",
        "knn_kth_dist",
        F.when(F.col("_twins") > 0, 0.0).otherwise(F.col("_dist")).alias("nearest_dist"),
        F.when(F.col("_twins") > 0, twin).otherwise(F.col("_neighbor")).alias("nearest_id"),
    )


def against_reference(queries: DataFrame, references: DataFrame, k: int, ref_points: DataFrame | None = None) -> DataFrame:
    """The same columns for query entities among the reference entities.

    ``ref_points`` are the settled distinct points of the references, if they are at hand.
    """
    ref_points = collapse(references).points if ref_points is None else ref_points
    asked = collapse(queries)
    n, total = _size(ref_points)
    if total == 0:
        raise ValueError("no reference vectors")
    k = min(k, total)
    near = nearest_points(asked.points, ref_points, k, False, _size(asked.points)[0], n)
    scored = _summary(asked.points, near, k, loo=False)
    return asked.members.join(scored, list(_KEY)).select(
        ENTITY,
        "knn_mean_dist",
        "knn_kth_dist",
        F.col("_dist").alias("nearest_dist"),
        F.col("_neighbor").alias("nearest_id"),
    )
