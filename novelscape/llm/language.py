"""Operator 6: language identification by averaged hashed subword embeddings with a linear softmax.

A word's features are the hashed runs of 3 and 4 bytes of ``<word>``; a text is the mean of their embeddings. Embeddings
and softmax are trained by stochastic gradient descent; a temperature fitted on a part of the sample that is not
trained on calibrates the probabilities, and a text is rejected if its best one is below ``reject``, the least
probability at which the accepted texts of that part reach the wanted accuracy.

Training takes at most ``bound`` rows with a language, in order of a hash of ``doc_id``, whose crc32 modulo 3 is not 1.
A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if no row has a language.
Rows with equal ``doc_id`` are predicted each by itself; a null ``doc_id`` counts as empty text in crc32. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common

#: Rows that are trained on at most.
BOUND = 5_000
BUCKETS, WIDTH = 1 << 16, 12
RUNS = (3, 4)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of the words, and where each word's begin."""
    framed = pc.binary_join_element_wise(pa.scalar("<"), words, pa.scalar(">"), pa.scalar("")).cast(pa.large_binary())
    lengths = np.asarray(pc.binary_length(framed), dtype=np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(framed.to_pylist()), dtype=np.uint8).astype(np.uint32)
    buckets, owners = [], []
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    for n in RUNS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ raw[k : k + len(h)]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        inside = np.arange(len(h)) + n <= ends[word_of[: len(h)]]
        buckets.append((h[inside] % BUCKETS).astype(np.int64)), owners.append(word_of[: len(h)][inside])
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(len(lengths) + 1, dtype=np.int64)
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(lengths)))])


def letters_only(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts, without case and without those that have no letter."""
    codes, distinct, offsets = common.words(text)
    distinct = pc.utf8_lower(pc.utf8_trim(distinct, ".,;:!?\"'()[]{}<>|%$&*#«»„“”…-0123456789"))
    real = np.asarray(pc.match_substring_regex(distinct, r"\p{L}"))
    use = real[codes]
    return codes[use], distinct, np.concatenate([[0], np.cumsum(use)])[offsets]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: pa.Array, languages: list[str], rounds: int = 3, rate: float = 0.5, size: int = 32, seed: int = 1):
    """``names, table, temperature, reject``: the table has each bucket's share of each language's log odds."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    codes, distinct, offsets = letters_only(texts)
    buckets, starts = subwords(distinct)
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), dtype=np.float32)
    order = draw.permutation(np.flatnonzero(np.diff(offsets) > 0))
    apart = order[: len(order) // 5] if len(order) >= 50 else order
    trained = order[len(order) // 5 :] if len(order) >= 50 else order

    def bags(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = codes[common.ragged(offsets[rows], offsets[rows + 1] - offsets[rows])]
        sizes = (starts[words + 1] - starts[words])
        flat = buckets[common.ragged(starts[words], sizes)]
        per_row = common.run_sums(sizes.astype(np.float64), np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])).astype(np.int64)
        return flat, per_row

    steps = max(1, rounds * -(-len(trained) // size))
    for step in range(steps):
        rows = trained[np.arange(step * size, (step + 1) * size) % max(len(trained), 1)] if len(trained) else trained
        flat, per_row = bags(rows)
        if not len(flat):
            continue
        own = np.repeat(np.arange(len(rows)), per_row)
        weight = np.zeros((len(rows), 1), dtype=np.float32)
        weight[:, 0] = 1 / np.maximum(per_row, 1)
        used, place = np.unique(flat, return_inverse=True)
        counts = np.bincount(own * len(used) + place, minlength=len(rows) * len(used)).reshape(len(rows), -1).astype(np.float32) * weight
        mean = counts @ embed[used]
        p = softmax(mean @ out)
        p[np.arange(len(rows)), y[rows]] -= 1
        pace = rate * (1 - step / steps)
        grad = p @ out.T
        out -= pace * 10 * (mean.T @ p) / len(rows)
        embed[used] -= pace * 20 * (counts.T @ grad)
    table = embed @ out
    z = np.concatenate([mean_scores(table, *bags(np.array([r]))) for r in apart]) if len(apart) else np.zeros((0, len(names)))
    truth = y[apart]
    heat = np.geomspace(0.1, 20, 60)
    loss = [-np.log(np.maximum(softmax(z * t)[np.arange(len(z)), truth], 1e-12)).mean() if len(z) else 0.0 for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    best = softmax(z * temperature).max(axis=1) if len(z) else np.zeros(0)
    return names, table, temperature, rejection(best, z.argmax(axis=1) == truth if len(z) else np.zeros(0, dtype=bool))


def rejection(best: np.ndarray, right: np.ndarray, wanted: float = 0.995) -> float:
    """The least probability at which texts with at least that are right often enough."""
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= wanted)
    return float(best[order[good[-1]]]) if len(good) else 0.0


def mean_scores(table: np.ndarray, flat: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    sums = common.run_sums(table[flat], np.concatenate([[0], np.cumsum(per_row)]))
    return sums / np.maximum(per_row, 1)[:, None]


def fit(docs: DataFrame, bound: int = BOUND):
    """The model, or None if no row has a language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & (common.crc_mod("doc_id", 3) != 1))
    chosen = common.stored(common.hash_sample(known.select("doc_id").distinct(), bound, "doc_id", "doc_id"))
    sample = known.where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "lang", "text").limit(bound).select("text", "lang").toArrow()
    if not sample.num_rows:
        return None
    return train(sample.column("text").combine_chunks(), sample.column("lang").to_pylist())


def predicted(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                codes, distinct, offsets = letters_only(text.slice(low, high - low))
                lettered = np.diff(offsets) > 0
                if shared.value is None or not len(distinct):
                    said, score, rejected = ["und"] * (high - low), np.zeros(high - low), np.ones(high - low, dtype=bool)
                else:
                    names, table, temperature, reject = shared.value
                    buckets, starts = subwords(distinct)
                    of_word = common.run_sums(table[buckets], starts)
                    sizes = np.diff(starts)
                    z = np.column_stack([common.run_sums(of_word[codes, k], offsets) for k in range(len(names))])
                    p = softmax(temperature * z / np.maximum(common.run_sums(sizes[codes].astype(np.float64), offsets), 1)[:, None])
                    best = p.argmax(axis=1)
                    said = [names[b] if there else "und" for b, there in zip(best.tolist(), lettered.tolist())]
                    score = np.where(lettered, p.max(axis=1), 0.0)
                    rejected = ~lettered | (score < reject)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return common.crc_mod("doc_id", 3) == 1
