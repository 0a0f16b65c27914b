"""Operator 9: near duplicates by SimHash, joined with a hierarchical index in Gray order.

A fingerprint bit is set if more than half of the hashes of a text's word shingles have it. Fingerprints that differ in
at most ``distance`` bits are linked; linked texts are a group. Each distinct fingerprint is dealt by blocks of its
bits. A task sorts the fingerprints of a block value by Gray rank and puts upper nodes over runs of them, each with the
pattern of bits that all below it share. Pairs of nodes are walked from the top: the differences in newly shared bits
are added to those known above, and whole groups are left out once they exceed the distance, or once both are known to
hang together. Tasks return a spanning forest of their links, never all pairs; components are joined up by stars. Block
values with too many fingerprints are dealt once more by the blocks of the remaining bits, and what is then still too
large is compared part by part.

With one 64-bit word there is a block more than ``distance``, so two linked fingerprints agree in one and no link is
lost. Texts whose shingle sets have a similarity of 0.8 differ in some 15 % of the bits, too many for that: ``near_copies``
takes several words of independent bits of the same hashes and blocks of 16 bits, and confirms what they bring together.

Null and empty texts have fingerprint zero and are copies of each other. Texts of fewer words than a shingle have one
shingle, the whole text. A null ``doc_id`` is in the group of its fingerprint, but does not name it; a group of such
rows only has a null name. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

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
from novelscape.llm.token_ids import texts_of

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Bits of a block of a fingerprint of several words.
WIDE_BLOCK = 14
#: Rows of one task, and fingerprints with one block value that a task takes at most.
TASK_ROWS, LARGE = 60_000, 20_000
#: Children of an index node, and pairs of nodes expanded at once.
FAN, AT_ONCE = 8, 1 << 14


def fingerprint(text: bytes, shingle: int, words: int = 1) -> bytes:
    """The bits, most significant first."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8 * words)
    size = min(shingle, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(tokens) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    total, n, step = np.zeros(64 * words, dtype=np.int64), len(starts), (1 << 15) // words
    for low in range(0, n, step):
        some = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + step], stops[low : low + step])])
        raw = np.frombuffer(some, dtype=np.uint8).reshape(-1, 8)
        if words > 1:
            raw = mixed(raw.view(">u8").astype(np.uint64), words).astype(">u8").view(np.uint8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > n).tobytes()


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash and further ones made of it, side by side."""
    more = hashes + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        more = (more ^ more >> np.uint64(shift)) * np.uint64(factor)
    more ^= more >> np.uint64(31)
    more[:, 0] = hashes[:, 0]
    return more


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """``doc_id, fp`` of each row; ``fp`` has 8 bytes for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, words) for x in batch.column("text").cast(pa.binary())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp binary")


def blocks_of(words: int, distance: int) -> list[list[tuple[int, int]]]:
    """Blocks as (word, mask), and for each the finer blocks of the other bits of its word."""
    if words == 1:
        masks = share_out(list(range(64)), distance + 1)
        finer = [share_out([b for b in range(64) if not m >> b & 1], distance + 1) for m in masks]
        return [[(0, m), *((0, m | x) for x in more)] for m, more in zip(masks, finer)]
    # Side by side and spread out, so that most bits are in two blocks.
    n, used = 64 // WIDE_BLOCK, 64 // WIDE_BLOCK * WIDE_BLOCK
    masks = share_out(list(range(used)), n) + share_out([b for k in range(n) for b in range(63 - k, -1, -n)][:used], n)
    return [[(w, m)] for w in range(words) for m in masks]


def share_out(bits: list[int], n: int) -> list[int]:
    """``n`` masks that share out the given bit numbers evenly."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def dealt(fps: DataFrame, blocks: dict[int, list[tuple[int, int, int]]], by: str | None = None, keep: tuple[str, ...] = ("fp",)) -> DataFrame:
    """The binary columns ``keep``, ``block, value`` of each fingerprint in each block.

    ``blocks`` has lists of (number, word, mask); with ``by``, the list of the number in that column is taken, else that of -1.
    Spark takes the result to be as small as ``fps``, so it is not to be joined with what could have been kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(batch.column("fp").to_pylist())
            mine = np.asarray(batch.column(by)) if by else np.full(len(codes), -1)
            for number, own in blocks.items():
                rows = np.flatnonzero(mine == number)
                for block, word, mask in own if len(rows) else ():
                    value = (codes[rows, word] & np.uint64(mask)).view(np.int64)
                    own_rows = [batch.column(c).take(pa.array(rows)) for c in keep]
                    yield pa.record_batch([*own_rows, pa.array(np.full(len(rows), block), pa.int32()), pa.array(value)], names=[*keep, "block", "value"])

    columns = dict.fromkeys(["fp", *keep, *[by] * bool(by)])
    return fps.select(*columns).mapInArrow(run, f"{''.join(f'{c} binary, ' for c in keep)}block int, value long")


def codes_of(fps: list[bytes]) -> np.ndarray:
    if not len(fps):
        return np.zeros((0, 1), dtype=np.uint64)
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(len(fps), -1)


def links(fps: DataFrame, distance: int = DISTANCE, words: int = 1, large: int = LARGE) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp`` that make the components of all that the blocks bring together."""
    spark = fps.sparkSession
    plan = blocks_of(words, distance)
    parts = common.tasks(spark, len(plan) * fps.count(), TASK_ROWS)
    keyed = dealt(fps, {-1: [(b, *own[0]) for b, own in enumerate(plan)]})
    heavy = over(keyed, large)
    if heavy.isEmpty():
        return joined(keyed, parts, distance)
    out = [joined(keyed.join(heavy, ["block", "value"], "left_anti"), parts, distance)]
    left = common.stored(keyed.join(heavy, ["block", "value"], "left_semi").select("fp", "block", "value"))
    if words == 1:
        finer = {b: [(len(plan) + b * len(plan) + i, *x) for i, x in enumerate(own[1:])] for b, own in enumerate(plan)}
        left = common.stored(dealt(left, finer, "block"))
        heavy = over(left, large)
        out.append(joined(left.join(heavy, ["block", "value"], "left_anti"), parts, distance))
    rows = left.join(heavy, ["block", "value"]).withColumn("m", F.ceil(F.col("n") / large).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.select("fp", "block", "value", F.explode(cells).alias("cell"))
    out.append(joined(rows, common.tasks(spark, rows.count(), TASK_ROWS), distance, "cell.i", "cell.j"))
    return reduce(DataFrame.union, out)


def over(keyed: DataFrame, large: int) -> DataFrame:
    """Block values with too many fingerprints."""
    counts = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    return common.stored(counts)


def joined(rows: DataFrame, parts: int, distance: int, *cell: str) -> DataFrame:
    """Links within each block value, or cell of it; a task takes many of them."""
    same = F.xxhash64("block", "value", *cell)
    flat = rows.select(F.pmod(same, F.lit(parts)).alias("task"), same.alias("cell"), "fp")
    return flat.groupBy("task").applyInPandas(in_task(distance), "u binary, v binary")


def in_task(distance: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = codes_of(rows["fp"].tolist())
        distinct, place = np.unique(codes, axis=0, return_inverse=True) if codes.shape[1] > 1 else np.unique(codes, return_inverse=True)
        distinct, place = distinct.reshape(len(distinct), -1), place.ravel()
        label = forest(distinct, place, rows["cell"].to_numpy(), distance)
        hung = np.flatnonzero(label != np.arange(len(label)))
        names = [row.tobytes() for row in distinct.astype(">u8")]
        return pd.DataFrame({"u": [names[i] for i in hung], "v": [names[i] for i in label[hung]]})

    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def index(codes: np.ndarray, cell: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of nodes over sorted codes, the lowest first: cell, first child and number of children, pattern, shared bits."""
    levels = [{"cell": cell, "pattern": codes, "shared": np.full(codes.shape, ~np.uint64(0))}]
    while True:
        low = levels[-1]
        begins = np.flatnonzero(np.diff(low["cell"], prepend=~low["cell"][:1]))
        sizes = np.diff(np.append(begins, len(low["cell"])))
        if (sizes == 1).all():
            return levels
        within = common.ragged(np.zeros(len(sizes), dtype=np.int64), sizes)
        first = np.flatnonzero(within % FAN == 0)
        count = np.diff(np.append(first, len(within)))
        head = np.repeat(low["pattern"][first], count, axis=0)
        differs = (low["pattern"] ^ head) | ~low["shared"]
        shared = ~np.bitwise_or.reduceat(differs, first, axis=0)
        levels.append({"cell": low["cell"][first], "first": first, "count": count, "pattern": low["pattern"][first], "shared": shared})


def forest(codes: np.ndarray, place: np.ndarray, cell: np.ndarray, distance: int) -> np.ndarray:
    """For each distinct code the smallest one that it hangs together with, by links within a cell."""
    label = np.arange(len(codes))
    if not len(codes):
        return label
    order = np.lexsort((*gray_rank(codes[place]).T[::-1], cell))
    place, levels = place[order], index(codes[place][order], cell[order])
    top = np.arange(len(levels[-1]["cell"]))
    stack = [(len(levels) - 1, top, top, np.zeros(len(top), dtype=np.int64), np.zeros((len(top), codes.shape[1]), dtype=np.uint64))]
    while stack:
        height, a, b, far, known = stack.pop()
        if len(a) > AT_ONCE:
            half = len(a) // 2
            stack.append((height, a[half:], b[half:], far[half:], known[half:]))
            stack.append((height, a[:half], b[:half], far[:half], known[:half]))
            continue
        level = levels[height]
        new = level["shared"][a] & level["shared"][b] & ~known
        far = far + np.bitwise_count((level["pattern"][a] ^ level["pattern"][b]) & new).sum(axis=1, dtype=np.int64)
        near = far <= distance
        a, b, far, known = a[near], b[near], far[near], (known | new)[near]
        if height == 0:
            label = united(label, place[a], place[b])
            continue
        open_ = a == b
        if not open_.all():
            low, high = label[place], label[place]
            for up in levels[1 : height + 1]:
                low, high = np.minimum.reduceat(low, up["first"]), np.maximum.reduceat(high, up["first"])
            open_ |= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b, far, known = a[open_], b[open_], far[open_], known[open_]
        if not len(a):
            continue
        pairs = level["count"][a] * level["count"][b]
        at, nth = np.repeat(np.arange(len(a)), pairs), common.ragged(np.zeros(len(a), dtype=np.int64), pairs)
        x = level["first"][a][at] + nth // level["count"][b][at]
        y = level["first"][b][at] + nth % level["count"][b][at]
        once = x <= y if height > 1 else x < y
        # Nodes with themselves are taken first, so that dense groups hang together before they are compared.
        for part in (once & (x != y), once & (x == y)):
            if part.any():
                stack.append((height - 1, x[part], y[part], far[at[part]], known[at[part]]))
    return label


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, words: int = 1) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; a component is named by its smallest ``doc_id``."""
    own = common.stored(fingerprints(docs, shingle, words))
    classes = common.stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), distance, words))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")
