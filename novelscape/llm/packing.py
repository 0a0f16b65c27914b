"""Operator 7: best-fit packing of tokenized documents into sequences, improved by swaps.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt into groups of bounded size by
a hash. Each group is packed best-fit, longest first, and then improved by local search: from its emptiest bin pieces
are moved into other underfull bins, exchanged one for one, or one for two, whenever the other bin gets fuller (the sum
of squared fills rises), until the bin is empty or nothing helps. What lies in underfull bins of all groups then goes
through the same again in fewer groups, until one group is left or it stops shrinking. Every group is bounded, whatever
the number of documents.

Null texts are empty; an empty text is a piece of one token (its end). Each row is packed by itself, so equal rows and
equal or null ``doc_id``s are kept. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.llm.token_ids import END, encoder, texts_of

CAPACITY = 4096
#: Pieces that one group packs.
GROUP = 8192
#: Bins filled up to this share are not opened again.
FULL = 0.998
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin that has room."""
    out, rooms = np.zeros(len(sizes), dtype=np.int64), []
    bins = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, own = rooms.pop(at)
        else:
            room, own, bins = capacity, bins, bins + 1
        out[item] = own
        if room > size:
            insort(rooms, (room - size, own))
    return out


def exchange(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, source: int, capacity: int) -> bool:
    """One move or exchange that takes the most out of bin ``source``; False if none makes another bin fuller."""
    mine = np.flatnonzero(bins == source)
    room = capacity - fill
    room[source] = 0
    others = np.flatnonzero((room > 0) & (fill > 0))
    best = (0, (), ())
    # A move: a piece of mine fits as it is.
    if len(others):
        fits = [(int(sizes[i]), (i,), (), int(others[np.argmin(np.where(room[others] >= sizes[i], room[others], capacity + 1))])) for i in mine if (room[others] >= sizes[i]).any()]
        if fits:
            gain, give, _, to = max(fits)
            bins[list(give)] = to
            fill[to] += gain
            fill[source] -= gain
            return True
    theirs = np.flatnonzero((room[bins] > 0) & (bins != source))
    if not len(theirs) or not len(mine):
        return False
    # One for one: mine is longer, by no more than the room of their bin.
    order = theirs[np.argsort(sizes[theirs], kind="stable")]
    for i in mine.tolist():
        gain = sizes[i] - sizes[theirs]
        gain = np.where((gain > 0) & (gain <= room[bins[theirs]]), gain, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (int(gain[k]), (i,), (int(theirs[k]),))
    # Two of mine for one of theirs.
    pairs = [(int(sizes[i] + sizes[j]), i, j) for x, i in enumerate(mine[:64].tolist()) for j in mine[x + 1 : 64].tolist()]
    for both, i, j in pairs:
        gain = both - sizes[theirs]
        gain = np.where((gain > 0) & (gain <= room[bins[theirs]]), gain, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (int(gain[k]), (i, j), (int(theirs[k]),))
    # One of mine for two of theirs that lie in one bin.
    grouped = order[np.argsort(bins[order], kind="stable")]
    same = np.flatnonzero(bins[grouped[1:]] == bins[grouped[:-1]])
    a, b = grouped[same], grouped[same + 1]
    for i in mine.tolist():
        gain = sizes[i] - sizes[a] - sizes[b]
        gain = np.where((gain > 0) & (gain <= room[bins[a]]), gain, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(np.argmax(gain))
            best = (int(gain[k]), (i,), (int(a[k]), int(b[k])))
    if not best[0]:
        return False
    gain, give, take = best
    to = int(bins[take[0]])
    bins[list(give)], bins[list(take)] = to, source
    fill[to] += gain
    fill[source] -= gain
    return True


def improved(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the emptiest bin by moves and exchanges, again and again, while the total could do with fewer bins."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    while (fill > 0).sum() > least:
        source = int(np.argmin(np.where(fill > 0, fill, capacity + 1)))
        # Each step takes from the emptiest bin, so the sum of squared fills rises and the steps end.
        while fill[source] > 0 and exchange(sizes, bins, fill, source, capacity):
            pass
        if fill[source] > 0:
            # Emptier than before, but still there; a later round has more bins to put the rest in.
            break
    return bins


def packed(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    return improved(sizes, best_fit(sizes, capacity), capacity)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of each row's ids."""
    get = encoder(docs.sparkSession, vocabulary, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                ids, starts = own.encode(text.slice(low, high - low))
                raw = memoryview(ids.astype("<u4")).cast("B")
                size = np.diff(starts)
                count = -(-size // capacity)
                row = np.repeat(np.arange(high - low), count)
                piece = common.ragged(np.zeros(len(count), dtype=np.int64), count)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip((starts[row] + start).tolist(), length.tolist())]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts_of(docs).mapInArrow(run, PIECE)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` of each piece in its sequence."""
    spark = pieces.sparkSession
    names = [x.split()[0] for x in PIECE.split(", ")]
    table = common.stored(pieces)
    whole = F.col("length") >= capacity
    done = [table.where(whole).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, round_ = table.where(~whole), 0
    n = left.count()
    while n:
        groups = -(-n // group)
        out = common.stored(one_round(left, groups, round_, capacity))
        last = groups == 1
        settled = F.col("fill") >= (0 if last else int(FULL * capacity))
        rest = out.where(~settled)
        m = 0 if last else rest.count()
        if not last and m > 0.7 * n:
            settled, m = F.lit(True), 0
        done.append(out.where(settled).select(*names, "sequence_id", "offset"))
        left, n, round_ = rest.select(*names), m, round_ + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def one_round(left: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    hashed = F.pmod(F.xxhash64(F.lit(round_), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return left.withColumn("group", hashed).groupBy("group").applyInPandas(in_group(round_, capacity), f"{PIECE}, fill long, sequence_id long, offset long")


def in_group(round_: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32", "length"], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins = packed(sizes, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.zeros(len(bins), dtype=np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        # Fixed layout of the number: round, group, bin.
        number = (round_ << 54) + (rows["group"].to_numpy() << 14) + bins
        return rows.assign(fill=fill[bins], sequence_id=number, offset=offset).drop(columns="group")

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(pieces(docs, vocabulary, capacity), capacity)
