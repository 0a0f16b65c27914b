"""Operator 5: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its distinct words and their first letters,
hashed; a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Weights are trained by gradient descent on
document labels alone, so that sentences are told apart without labels of their own; a document's offending sentences
are those of at least ``threshold``.

Training takes at most ``bound`` labelled rows, in order of a hash of ``doc_id``, whose crc32 modulo 5 is not 0. Null
and empty texts are one empty sentence and have the probability of a sentence without words. Rows with equal ``doc_id``
are scored each by itself, and each counts with each of its labels; null labels do not count. Without labels of both
kinds all scores are the share of positive labels, or 0. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.llm.token_ids import texts_of

#: Labelled rows that are trained on at most.
BOUND = 10_000
BUCKETS = 1 << 20
#: First letters of a word that are features beside the word.
PREFIXES = (4, 5, 6)
#: Training sentences that a feature needs.
LEAST = 4
MARKS = ".,;:!?\"'()[]{}<>|%$&*#«»„“”…-"


class Sentences:
    """Words of texts by sentence; hashed features of each distinct word are worked out once."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[np.ndarray, bool]] = {}

    def word(self, word: str) -> tuple[np.ndarray, bool]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 150_000:
                self.known.clear()
            bare = word.strip(MARKS).lower()
            parts = [bare, *(f"{bare[:n]}~" for n in PREFIXES if len(bare) >= n)] if bare else []
            end = word.rstrip("\"')]}»”*#$%&")[-1:] in (".", "!", "?")
            found = self.known[word] = np.array([xxhash.xxh32_intdigest(p) % BUCKETS for p in parts], dtype=np.int64), end
        return found

    def split(self, text: pa.Array):
        """Distinct words of each sentence as (sentence, word) pairs, features of the words, and each text's first sentence."""
        codes, distinct, offsets = common.words(text, lines=True)
        looked = [self.word(w) for w in distinct.to_pylist()]
        ends = np.array([e for _, e in looked], dtype=bool)
        sizes = np.array([len(f) for f, _ in looked], dtype=np.int64)
        flat = np.concatenate([f for f, _ in looked]) if looked else np.zeros(0, dtype=np.int64)
        # A sentence begins after an end or a line break, and with each text; the breaks themselves go.
        line = pc.index(distinct, pa.scalar(common.LINE, distinct.type)).as_py()
        ends, real = ends[codes], codes != line
        ends[:-1] |= ~real[1:]
        codes, ends, offsets = codes[real], ends[real], np.concatenate([[0], np.cumsum(real)])[offsets]
        starts = np.zeros(len(codes) + 1, dtype=np.int64)
        starts[1:] = ends
        starts[offsets[:-1]] = 1
        starts[len(codes)] = 0
        number = np.cumsum(starts[:-1]) if len(codes) else np.zeros(0, dtype=np.int64)
        # Empty texts have a sentence too.
        empty = np.cumsum(np.diff(offsets) == 0)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        number = number - 1 + (empty[row] if len(row) else 0)
        first = np.zeros(len(offsets), dtype=np.int64)
        counted = np.concatenate([[0], np.cumsum(starts[:-1])])
        first[:-1] = counted[offsets[:-1]] + np.concatenate([[0], empty[:-1]]) if len(empty) else 0
        first[-1] = counted[-1] + (empty[-1] if len(empty) else 0)
        pairs = np.unique(number * max(len(distinct), 1) + codes)
        sentence, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
        return sentence, word, sizes, flat, first


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 160, rate: float = 0.08, sparse: float = 1.5) -> tuple[np.ndarray, float]:
    """Weights of features and the intercept, by Adam on the noisy-or likelihood."""
    docs, own, parts, first, n_words = len(labels), Sentences(), [], [np.zeros(1, dtype=np.int64)], 0
    for low, high in common.slices(texts):
        sentence, word, sizes, flat, begins = own.split(texts.slice(low, high - low))
        parts.append(((sentence + first[-1][-1]).astype(np.int32), (word + n_words).astype(np.int32), sizes, flat.astype(np.int32)))
        first.append(begins[1:] + first[-1][-1])
        n_words += len(sizes)
    sentence, word, sizes, flat = (np.concatenate(x) for x in zip(*parts))
    del parts, own
    first = np.concatenate(first)
    n = int(first[-1])
    owner = np.repeat(np.arange(docs, dtype=np.int32), np.diff(first))
    # Features of words in too few sentences stay at 0.
    word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    df = np.bincount(flat, weights=np.bincount(word, minlength=len(sizes))[word_of], minlength=BUCKETS)
    used = df >= LEAST
    active = used[flat]
    columns = np.flatnonzero(used)
    number = np.zeros(BUCKETS, dtype=np.int32)
    number[columns] = np.arange(len(columns))
    word_of, place = word_of[active], number[flat[active]]
    del flat, active
    mean = labels.mean()
    bias = np.log(max(-np.log1p(-mean) / max(n / docs, 1), 1e-9))
    w, moments = np.zeros(len(columns) + 1), np.zeros((2, len(columns) + 1))
    w[-1] = bias
    for step in range(1, rounds + 1):
        v = np.bincount(word_of, weights=w[:-1][place], minlength=len(sizes))
        z = np.clip(w[-1] + np.bincount(sentence, weights=v[word], minlength=n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(owner, weights=-np.logaddexp(0, z), minlength=docs)
        whole = -np.expm1(none)
        # d/dz of the log likelihood: p * (1 - whole) / whole for positive documents, -p for the others.
        pull = np.where(labels > 0.5, np.exp(none) / np.maximum(whole, 1e-12), -1.0)
        g = p * pull[owner]
        gv = np.bincount(word, weights=g[sentence], minlength=len(sizes))
        grad = np.append(np.bincount(place, weights=gv[word_of], minlength=len(columns)), g.sum()) / docs
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        pace = rate / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6)
        w += pace * moments[0] / (1 - 0.9**step)
        # A weight stays at 0 unless it explains more than ``sparse`` documents.
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - (pace * sparse / docs)[:-1], 0)
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[columns] = w[:-1]
    return out, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND):
    """The model, or the share of positive labels if there are not both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (common.crc_mod("doc_id", 5) != 0))
    chosen = common.stored(common.hash_sample(known, bound, "doc_id", "doc_id", "y"))
    sample = texts_of(docs).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "y", "text").limit(bound).select("text", "y").toArrow()
    y = np.asarray(sample.column("y"), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return train(pa.concat_arrays(sample.column("text").chunks), y)


def sentence_scores(model, own: Sentences, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of each sentence, and each text's first."""
    sentence, word, sizes, flat, first = own.split(text)
    weights, bias = model
    v = common.run_sums(weights[flat], np.concatenate([[0], np.cumsum(sizes)]))
    return np.clip(bias + np.bincount(sentence, weights=v[word], minlength=int(first[-1])), -30, 30), first


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, score, n_offending, offending``: probability, and the numbers of offending sentences from 0."""
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sentences()
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                if isinstance(shared.value, float):
                    score, lists = np.full(high - low, shared.value), [[]] * (high - low)
                else:
                    z, first = sentence_scores(shared.value, own, text.slice(low, high - low))
                    score = np.clip(-np.expm1(common.run_sums(-np.logaddexp(0, z), first)), 0.0, 1.0)
                    bad = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
                    row = np.searchsorted(first, bad, side="right") - 1
                    lists = [x.tolist() for x in np.split(bad - first[row], np.searchsorted(row, np.arange(1, high - low)))]
                count = [len(x) for x in lists]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low), pa.array(score, pa.float64()), pa.array(count, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                    names=["doc_id", "score", "n_offending", "offending"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, n_offending int, offending array<int>")


def held_out() -> Column:
    return common.crc_mod("doc_id", 5) == 0
