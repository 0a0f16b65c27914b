"""Operator 4: language-model scores by a probabilistic suffix tree.

Symbols are words and the end of a text. A context is a run of up to ``depth`` words that training texts hold ``LEAST``
times or more. Its next-symbol distribution gives a symbol its count after the context, and ``n ** BETA`` occurrences
more (``n``: those of the context) that are dealt like the distribution of the longest proper suffix; the empty context
has the add-one frequencies of the base, with one unknown symbol. So each distribution sums to one.

The tree keeps a context if its distribution diverges from that of its suffix: summed over its training occurrences,
each left out of the counts that predict it, the log likelihood must gain more than ``GAIN``; a slice's part of a gain is
sent with 17 significant bits. A symbol is scored in the
longest kept context before it.

Contexts and transitions are rows of blobs, dealt by hash. Texts are cut into slices; a slice asks for each of its
distinct grams once, with its own training count, and the bucket of the gram answers with the count of the corpus. In
the same way slices send the gains of their contexts and are told which ones the tree keeps. A very frequent gram is
one number of each slice, and a bucket holds about ``BUCKET`` numbers whatever the size of the corpus. Only the numbers
of tokens and of distinct symbols reach the driver and all tasks. Least counts and tests do not depend on the size of
the corpus. Words are told apart by 64 bits of hash, longer grams by 38 bits within their bucket, where about three in
a million collide with another one; both then count as one gram.

Null and empty texts have the end only. Rows with equal ``doc_id`` are scored each by itself and all count; a null
``doc_id`` is the empty text in crc32. Without training texts all scores are 0. Further columns are not read. An empty
table gives an empty result. A text longer than a slice is a slice by itself.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.llm.token_ids import texts_of

DEPTH = 3
#: Occurrences of a context at least; the log likelihood that it must gain.
LEAST, GAIN = 2, 1.0
#: Power of a context's occurrences that is left to its suffix.
BETA = 0.7
#: Bytes of text in a slice, grams of one length in a bucket.
SLICE, BUCKET = 8 << 20, 1 << 20
#: Bits of a long gram within its bucket; bits that number the buckets, at most.
OWN_BITS, MOST_BITS = 38, 26
#: Stands for the end among the words; no word holds a blank.
END = b" "


def held_out() -> Column:
    return common.crc_mod("doc_id", 7) == 2


def packed(values: np.ndarray, width: int = 8) -> bytes:
    """Numbers as compressed planes of their ``width`` last bytes."""
    raw = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(width, -1)
    raw = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    raw[:, 8 - width :] = planes.T
    return raw.view(">u8").ravel().astype(np.uint64)


def coded_slices(docs: DataFrame) -> DataFrame:
    """One row for each slice of ``docs`` (``doc_id, text, held_out``): its ids, where each text's symbols end, its
    symbols as places among its distinct words, and the hashes of these; the end is word 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text, SLICE):
                codes, distinct, offsets = common.words(text.slice(low, high - low), lower=True)
                # Frequent words get small numbers.
                order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
                codes = np.argsort(order)[codes]
                names = distinct.take(pa.array(order)).cast(pa.binary()).to_pylist()
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, [END, *names]), np.uint64, len(distinct) + 1)
                part = batch.slice(low, high - low)
                yield pa.record_batch(
                    [pa.array([uuid.uuid4().int >> 65]), pa.array([len(codes) + high - low], pa.int64()),
                     pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                     pa.array([packed(offsets[1:] + np.arange(1, high - low + 1))], pa.binary()),
                     pa.array([packed(np.insert(codes + 1, offsets[1:], 0), 4)], pa.binary()), pa.array([packed(hashes)], pa.binary())],
                    names=["part", "n_tokens", "docs", "held_out", "ends", "symbols", "hashes"],
                )

    return docs.mapInArrow(run, "part long, n_tokens long, docs array<long>, held_out array<boolean>, ends binary, symbols binary, hashes binary")


def mixed(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a gram from that of the gram without its last symbol, and that symbol's."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + symbol
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read(row: dict, depth: int, bits: int) -> SimpleNamespace:
    """A slice: its offsets, each symbol's place in its text, whether it is for training, and for each length the sorted
    distinct grams and the place among them of the gram that ends at each symbol, -1 if it began before the text."""
    ends, symbols, hashes = unpacked(row["ends"]).astype(np.int64), unpacked(row["symbols"], 4).astype(np.int64), unpacked(row["hashes"])
    offsets = np.concatenate([[0], ends])
    sizes = np.diff(offsets)
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], sizes)
    training = np.repeat(~np.array(row["held_out"], dtype=bool), sizes)
    keys, places, own = [], [], hashes[symbols]
    gram = own
    for length in range(1, depth + 2):
        if length > 1:
            gram = np.concatenate([own[:1], mixed(gram[:-1], own[1:])])
        whole = place >= length - 1
        short = gram if length == 1 else gram >> np.uint64(MOST_BITS - bits)
        found, at = np.unique(short[whole], return_inverse=True)
        every = np.full(len(symbols), -1)
        every[whole] = at
        keys.append(found)
        places.append(every)
    return SimpleNamespace(offsets=offsets, place=place, training=training, keys=keys, places=places)


def asked(part: int, length: int, keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple]:
    """``part, bucket, keys, values`` for each bucket of sorted grams of one length; buckets of all lengths are apart."""
    bucket = (keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), dtype=np.uint64)) if length == 1 else keys >> np.uint64(OWN_BITS)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        # Sorted numbers take less room as steps.
        own = keys[low:high] if length == 1 else keys[low:high] & np.uint64((1 << OWN_BITS) - 1)
        yield part, (length << bits) + int(bucket[low]), packed(np.diff(own, prepend=np.uint64(0))), packed(values[low:high])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "bucket", "keys", "numbers"])


ASKED = "part long, bucket long, keys binary, numbers binary"


def count_asked(slices: DataFrame, depth: int, bits: int) -> DataFrame:
    """The grams of each slice with their training counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = read(row, depth, bits)
                for length, (keys, at) in enumerate(zip(own.keys, own.places), 1):
                    n = np.bincount(at[(at >= 0) & own.training], minlength=len(keys))
                    yield as_batch(list(asked(row["part"], length, keys, n, bits)))

    return slices.select("part", "held_out", "ends", "symbols", "hashes").mapInArrow(run, ASKED)


def summed(table: pa.Table, number) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Of the rows of a bucket, by part: the parts, the place of each key among the distinct ones, and these keys' sums."""
    rows = sorted(table.to_pylist(), key=lambda row: row["part"])
    keys = [np.cumsum(unpacked(row["keys"])) for row in rows]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([number(row["numbers"]) for row in rows]), minlength=len(found))
    return [row["part"] for row in rows], np.split(at, np.cumsum([len(k) for k in keys])[:-1]), sums


def counted(asks: DataFrame, bits: int) -> DataFrame:
    """``part, bucket, count, kinds, tokens``: the counts of what was asked for; a row of each bucket of single symbols
    has its numbers of training symbols, distinct and all."""

    def run(table: pa.Table) -> pa.Table:
        parts, places, total = summed(table, lambda blob: unpacked(blob).astype(np.float64))
        bucket = table.column("bucket")[0].as_py()
        first = np.arange(len(parts)) == 0
        single = first & (bucket >> bits == 1)
        return pa.table({
            "part": pa.array(parts, pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int64()),
            "answer": pa.array([packed(total[at]) for at in places], pa.binary()),
            "kinds": pa.array(single * int((total > 0).sum()), pa.int64()), "tokens": pa.array(single * int(total.sum()), pa.int64()),
        })

    return asks.groupBy("bucket").applyInArrow(run, "part long, bucket long, answer binary, kinds long, tokens long")


def kept(asks: DataFrame) -> DataFrame:
    """``part, bucket, answer``: which of the contexts asked for gain more than ``GAIN`` over all slices."""

    def run(table: pa.Table) -> pa.Table:
        parts, places, gain = summed(table, gains_of)
        bucket = table.column("bucket")[0].as_py()
        told = [packed((gain > GAIN)[at], 1) for at in places]
        return pa.table({"part": pa.array(parts, pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int64()), "answer": pa.array(told, pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, "part long, bucket long, answer binary")


def rounded(gain: np.ndarray) -> np.ndarray:
    """Gains in three bytes: the first ones of the nearest numbers in single precision."""
    return (gain.astype(np.float32).view(np.uint32) + np.uint32(0x80)) >> np.uint32(8)


def gains_of(blob: bytes) -> np.ndarray:
    return (unpacked(blob).astype(np.uint32) << np.uint32(8)).view(np.float32).astype(np.float64)


def with_counts(own: SimpleNamespace, answers: list[dict]) -> None:
    """Add the corpus counts of the slice's grams, ``total``, and of the gram that ends at each symbol, ``count``."""
    every = np.concatenate([unpacked(row["answer"]) for row in sorted(answers, key=lambda row: row["bucket"])]).astype(np.int64)
    own.total = np.split(every, np.cumsum([len(k) for k in own.keys])[:-1])
    # Place -1 is the 0 at the end.
    own.count = [np.append(total, 0)[at] for total, at in zip(own.total, own.places)]


def before(own: SimpleNamespace, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that stand after a context of this length, and the places of these contexts among the grams."""
    at = np.flatnonzero(own.place >= length)
    context = own.places[length - 1][at - 1]
    often = own.total[length - 1][context] >= LEAST
    return at[often], context[often]


def chain(own: SimpleNamespace, tokens: int, kinds: int, left_out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the empty context and each length: the symbols after a context, the contexts' places, and the probabilities of
    these symbols in them and in their suffixes. ``left_out`` occurrences of each symbol are not counted."""
    p = (own.count[0] - left_out + 1) / (tokens - left_out + kinds + 1)
    every = np.arange(len(p))
    yield every, every, p, p
    for length in range(1, len(own.keys)):
        at, context = before(own, length)
        n = own.total[length - 1][context] - left_out[at]
        rest = n**BETA
        longer = (own.count[length][at] - left_out[at] + rest * p[at]) / (n + rest)
        yield at, context, longer, p[at]
        p = p.copy()
        p[at] = longer


def contexts_of(own: SimpleNamespace, length: int, context: np.ndarray) -> np.ndarray:
    """The places of the slice's distinct contexts of a length, in order."""
    return np.flatnonzero(np.bincount(context, minlength=len(own.keys[length - 1])))


def gains_asked(both, depth: int, bits: int, tokens: int, kinds: int) -> DataFrame:
    """The contexts of each slice with what they gain over their suffixes in its training texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            own = read(row, depth, bits)
            with_counts(own, right.to_pylist())
            for length, (at, context, longer, shorter) in enumerate(chain(own, tokens, kinds, own.training.astype(np.float64))):
                if length:
                    gain = np.where(own.training[at], np.log(longer / shorter), 0)
                    gain = np.bincount(context, weights=gain, minlength=len(own.keys[length - 1]))
                    asks = contexts_of(own, length, context)
                    rows += asked(row["part"], length, own.keys[length - 1][asks], rounded(gain[asks]), bits)
        return pa.Table.from_batches([as_batch(rows)])

    return both.applyInArrow(run, ASKED)


def scoring(depth: int, bits: int, tokens: int, kinds: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], right.to_pylist()
        for row in left.to_pylist():
            own = read(row, depth, bits)
            with_counts(own, [a for a in answers if a["round"] == 1])
            told = sorted((a for a in answers if a["round"] == 2), key=lambda a: a["bucket"])
            states = np.concatenate([np.zeros(0, dtype=bool), *(unpacked(a["answer"], 1) > 0 for a in told)])
            base = score = np.zeros(len(own.place))
            for length, (at, context, p, _) in enumerate(chain(own, tokens, kinds, np.zeros(len(own.place))) if tokens else ()):
                if not length:
                    base, score = np.log10(p), np.log10(p)
                    continue
                asks = contexts_of(own, length, context)
                state = np.zeros(len(own.keys[length - 1]), dtype=bool)
                state[asks], states = states[: len(asks)], states[len(asks) :]
                score[at[state[context]]] = np.log10(p[state[context]])
            low = own.offsets[:-1]
            out.append(pa.table({
                "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(np.diff(own.offsets), pa.int64()),
                "n_known": pa.array(np.add.reduceat((own.count[0] > 0).astype(np.int64), low), pa.int64()), "train_tokens": pa.array(np.full(len(low), tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, low)), "score": pa.array(np.add.reduceat(score, low)),
            }))
        return pa.concat_tables(out)

    return run


def given_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row."""
    spark = docs.sparkSession
    slices = common.stored(coded_slices(texts_of(docs).withColumn("held_out", held_out())))
    size = slices.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(0, -(-size // BUCKET) - 1).bit_length())
    counts = common.stored(counted(count_asked(slices, depth, bits), bits))
    given_back(spark)
    row = counts.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    own = slices.drop("n_tokens").groupBy("part")
    answers = counts.select(F.lit(1).alias("round"), "part", "bucket", "answer")
    gains = gains_asked(own.cogroup(answers.groupBy("part")), depth, bits, row.tokens, row.kinds)
    states = common.stored(kept(gains))
    given_back(spark)
    both = answers.union(states.select(F.lit(2), "part", "bucket", "answer"))
    names = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.cogroup(both.groupBy("part")).applyInArrow(scoring(depth, bits, row.tokens, row.kinds), names)
