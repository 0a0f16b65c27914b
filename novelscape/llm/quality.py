"""Operator 10: document quality by hierarchical empirical Bayes over sites.

A logistic classifier on the look of a text (lengths, repetition, case, marks, digits) gives each document's evidence.
Evidence is summed by host and by path. Beta-binomial priors are fitted by moments: hosts shrink toward the global
mean, paths toward their host, the more the fewer documents they have. A document's score is its own log odds plus
those of its path, without its own share, against the global mean.

The classifier is fitted on at most ``bound`` labelled rows in order of a hash of ``doc_id``; all else covers all
documents. Null and empty texts are scored like any other. Null hosts and paths are a host and a path. Rows with equal
``doc_id`` are scored each by itself; labels of such ids count for each, labels that are null do not count. Without
labels of both kinds every document has even odds and is kept. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelscape.llm import common

#: Labelled rows that the classifier is fitted on at most.
BOUND = 20_000
THRESHOLD = 0.5
FEATURES = 17


def word_looks(words: pa.Array) -> np.ndarray:
    """Of each distinct word: length, capitals only, capital first, digits, odd marks, exclamation, no letter, sentence end."""
    length = np.asarray(pc.utf8_length(words), dtype=np.float64)
    flags = [
        (length > 1) & np.asarray(pc.utf8_is_upper(words)),
        np.asarray(pc.match_substring_regex(words, r"^\p{Lu}")),
        np.asarray(pc.match_substring_regex(words, r"\p{N}")),
        np.asarray(pc.match_substring_regex(words, r"[^\p{L}\p{N}.,;:!?'\"()-]")),
        np.asarray(pc.match_substring_regex(words, r"!")),
        ~np.asarray(pc.match_substring_regex(words, r"\p{L}")),
        np.asarray(pc.match_substring_regex(words, r"[.?]$")),
    ]
    return np.column_stack([length, *flags]).astype(np.float64)


def looks(text: pa.Array) -> np.ndarray:
    """The features of each text."""
    codes, distinct, offsets = common.words(text)
    n = np.diff(offsets)
    many = np.maximum(n, 1)
    looks_of = word_looks(distinct)
    means = np.column_stack([common.run_sums(looks_of[codes, k], offsets) for k in range(looks_of.shape[1])]) / many[:, None]
    row = np.repeat(np.arange(len(n)), n)
    pairs, counts = np.unique(row * max(len(distinct), 1) + codes, return_counts=True)
    owner = pairs // max(len(distinct), 1)
    kinds = np.bincount(owner, minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, owner, counts)
    again = np.zeros(len(codes))
    if len(codes):
        again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    again = common.run_sums(again, offsets)
    # The share of the most frequent words falls with length; its logarithm against length does not.
    shape = [np.log1p(n), kinds / many, top / many, again / many, np.log1p(top) - np.log1p(n) / 2, np.log1p(kinds) - np.log1p(n)]
    squares = [means[:, 0] ** 2, np.sqrt(means[:, 4]), np.sqrt(means[:, 1])]
    return np.column_stack([means, *shape, *squares]).astype(np.float32)


def features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """``doc_id, same, host, path, x`` of each row; ``same`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                x = looks(text.slice(low, high - low))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.record_batch([*(batch.column(c).slice(low, high - low) for c in ("doc_id", "same", "host", "path")), lists], names=["doc_id", "same", "host", "path", "x"])

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), host.cast("string").alias("host"),
        path.cast("string").alias("path"), F.col("text").cast("string").alias("text"),
    )
    return plain.mapInArrow(run, "doc_id long, same long, host string, path string, x array<float>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the intercept) by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(found: DataFrame, labels: DataFrame, bound: int = BOUND):
    """The classifier, or None without labels of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null")
    sample = common.hash_sample(found.select("doc_id", "x").join(known, "doc_id"), bound, "doc_id", "doc_id").toPandas()
    y = sample["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return logistic(np.stack(sample["x"].to_numpy()).astype(np.float64), y)


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, bound: int = BOUND, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, same, evidence, host_posterior, path_posterior, score, keep`` of each row."""
    found = common.stored(features(docs, host, path))
    model = fit(found, labels, bound)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            logit = np.zeros(len(x))
            if model is not None and len(x):
                mean, scale, w = model
                # No single look decides beyond measure.
                logit = np.clip(np.clip((x - mean) / scale, -12, 12) @ w[:-1] + w[-1], -12, 12)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "same", "host", "path")), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "same", "host", "path", "p"])

    evidence = common.stored(found.mapInArrow(apply, "doc_id long, same long, host string, path string, p double"))
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    paths = common.stored(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = min(max(whole.s / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    host_weight = prior_weight(hosts, F.col("host_s"), F.col("host_n"), F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("host_s") + host_weight * mean) / (F.col("host_n") + host_weight))
    sites = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    path_weight = prior_weight(sites, F.col("s"), F.col("n"), F.col("host_posterior"))
    e, s = evidence.alias("e"), sites.alias("s")
    both = e.join(s, F.col("e.host").eqNullSafe(F.col("s.host")) & F.col("e.path").eqNullSafe(F.col("s.path")))
    prior = F.col("s.host_posterior") * path_weight
    rest = (F.col("s.s") - F.col("e.p") + prior) / (F.col("s.n") - 1 + path_weight)
    total = odds(F.col("e.p")) + odds(rest) - odds(F.lit(mean))
    score = 1 / (1 + F.exp(-total))
    return both.select(
        F.col("e.doc_id").alias("doc_id"), F.col("e.same").alias("same"), F.col("e.p").alias("evidence"),
        F.col("s.host_posterior").alias("host_posterior"), ((F.col("s.s") + prior) / (F.col("s.n") + path_weight)).alias("path_posterior"),
        score.alias("score"), (score >= threshold).alias("keep"),
    )


def odds(p: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(inside / (1 - inside))


def prior_weight(groups: DataFrame, s: Column, n: Column, center: Column) -> float:
    """Documents that a prior counts for, by moments: how far group means lie from their centers beyond chance."""
    row = groups.agg(
        F.sum(n).alias("n"), F.sum(n * F.pow(s / n - center, F.lit(2))).alias("far"), F.sum(center * (1 - center)).alias("chance"),
        F.sum(n * center * (1 - center)).alias("spread"),
    ).first()
    if not row.n or not row.spread:
        return 1.0
    between = max((row.far - row.chance) / row.n, 1e-6)
    return float(min(max(row.spread / row.n / between - 1, 1.0), 1e5))


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """``docs`` without the rejected rows."""
    out = common.stored(scored(docs, labels, host, path, **options).where(~F.col("keep")).select("doc_id", "same").distinct())
    row, rejected = common.fresh(docs, "row", "rejected")
    out = out.select(F.struct("doc_id", "same").alias(rejected))
    own = docs.withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same")))
    same = F.col(f"{row}.doc_id").eqNullSafe(F.col(f"{rejected}.doc_id")) & (F.col(f"{row}.same") == F.col(f"{rejected}.same"))
    # The same plan at every size: what is rejected grows with the documents.
    return own.join(out.hint("shuffle_hash"), same, "left_anti").drop(row)
