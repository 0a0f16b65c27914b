import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from novelscape.llm import ann, common, language, quality, suffix_tree, toxicity
from tests.llm import edge

DRAW = random.Random(11)
LANGUAGES = {"en": ["th", "er", "on", "an", "he"], "de": ["sch", "ein", "ung", "ß", "ch"], "fr": ["eau", "é", "que", "oi", "tre"]}
BAD = ["idiot", "clown", "loweikr", "loweihr", "loweilo", "loweizu"]


def sentence(language="en", n=12):
    return " ".join("".join(DRAW.choice(LANGUAGES[language]) for _ in range(DRAW.randint(1, 4))) for _ in range(n)).capitalize() + "."


def text(language="en", bad=None):
    parts = [sentence(language, DRAW.randint(3, 15)) for _ in range(DRAW.randint(2, 12))]
    if bad:
        at = DRAW.randrange(len(parts))
        parts[at] = parts[at][:-1] + " " + bad + "."
    return DRAW.choice([" ", "\n"]).join(parts)


def test_mod(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(40), -5, None]], "doc_id long")
    for r in ids.withColumn("m", common.crc_mod("doc_id", 7)).collect():
        assert r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7


@pytest.fixture(scope="module")
def labelled():
    out = []
    for i in range(900):
        bad = DRAW.choice(BAD) if i % 5 == 0 else None
        junk = i % 7 == 0
        body = text("de" if i % 2 else "en", bad)
        body = DRAW.choice([body.upper().replace(" ", "!! "), " | ".join(body.split()), (body.split()[0] + " ") * 60]) if junk and not bad else body
        out.append((i, body, "en", f"s{i % 3}", int(not junk or bad is not None), int(bad is not None)))
    return out


def tables(spark, labelled):
    docs = edge.frame(spark, [r[:4] for r in labelled] + edge.rows()[-5:])
    labels = spark.createDataFrame([(r[0], r[4], r[5], 9) for r in labelled] + [(0, None, None, 9), (None, 1, 1, 9), (123456, 0, 1, 9)], "doc_id long, quality int, toxic int, score int")
    return docs, labels


def test_toxicity(spark, labelled):
    docs, labels = tables(spark, labelled)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).withColumn("held_out", toxicity.held_out()).collect()}
    held = [r for r in labelled if got[r[0]].held_out]
    assert len(held) > 100 and sum((got[r[0]].score >= 0.5) == bool(r[5]) for r in held) >= 0.97 * len(held)
    for r in held:
        if r[5] and got[r[0]].score >= 0.5:
            where = [k for k, s in enumerate(x for x in r[1].replace("\n", " ").split(".") if x.strip()) if any(b in s for b in BAD)]
            assert set(got[r[0]].offending) <= set(where)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_both_kinds(spark):
    docs = edge.frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(docs, none).count() == len(edge.rows())
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, one).collect()} == {1.0}
    assert toxicity.scored(edge.frame(spark, []), one).collect() == []


def test_sentences():
    own = toxicity.Sentences()
    sentence, word, sizes, flat, first = own.split(pa.array(["A b. C\nd e", None, "", "x.", "y y y! z"]))
    assert first.tolist() == [0, 3, 4, 5, 6, 8]  # a line break is an end too
    assert np.bincount(sentence, minlength=9).tolist()[:2] == [2, 1]
    assert all(len(a.split(pa.array([], pa.string()))[4]) == 1 for a in [own])


def test_language(spark):
    rows = [(i, text(code), code if i % 10 else None, None) for i, code in enumerate(DRAW.choice(["en", "de", "fr"]) for _ in range(600))]
    truth = {i: ("de" if "sch" in t or "ung" in t else "fr" if "eau" in t or "que" in t else "en") for i, t, *_ in rows}
    odd = [(1000, None, "en", None), (1001, "12 %% !!", "en", None), (1002, "", "de", None), (None, text("fr"), "fr", None)]
    got = {r.doc_id: r for r in language.predicted(edge.frame(spark, rows + odd)).collect()}
    assert sum(got[i].lang_pred == truth[i] for i in truth) >= 0.98 * len(truth)
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    assert language.predicted(edge.frame(spark)).count() == len(edge.rows())
    assert language.predicted(edge.frame(spark, [])).collect() == []
    none = edge.frame(spark, [(1, "some text", None, None)])
    assert [(r.lang_pred, r.score) for r in language.predicted(none).collect()] == [("und", 0.0)]


def test_quality(spark, labelled):
    docs, labels = tables(spark, labelled)
    site = F.col("source"), F.col("lang")
    got = {r.doc_id: r for r in quality.scored(docs, labels, *site).collect()}
    assert sum(got[r[0]].keep == bool(r[4]) for r in labelled) >= 0.97 * len(labelled)
    kept = quality.kept(docs, labels, *site)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id,) for r in kept.select("doc_id").collect()), key=edge.order) == sorted(
        ((r.doc_id,) for r in quality.scored(docs, labels, *site).collect() if r.keep), key=edge.order
    )


def test_quality_shrinks(spark):
    """A site of many poor documents lowers the score of its undecided ones; a sparse site stays near its host."""
    rows = [(i, text() if i % 2 else " | ".join(text().split()), "bad" if i % 2 == 0 else "good", "h") for i in range(400)]
    rows += [(400, text(), "rare", "h")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(edge.frame(spark, rows), labels, F.col("source"), F.col("lang")).collect()}
    assert got[0].path_posterior < 0.1 < 0.9 < got[1].path_posterior
    assert got[0].path_posterior < got[400].path_posterior < got[1].path_posterior


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    site = F.col("source"), F.col("lang")
    assert {(r.evidence, r.keep) for r in quality.scored(edge.frame(spark), none, *site).collect()} == {(0.5, True)}
    assert quality.kept(edge.frame(spark), none, *site).count() == len(edge.rows())
    assert quality.scored(edge.frame(spark, []), none, *site).collect() == []


def plain_base(rows):
    held = {id(r): zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows}
    tokens = {id(r): [*edge.words(r[1]), None] for r in rows}
    count = Counter(t for r in rows if not held[id(r)] for t in tokens[id(r)])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens[id(r)]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        yield r[0], held[id(r)], len(own), sum(count[t] > 0 for t in own), n, round(base, 6)


def test_base_scores(spark):
    rows = [tuple(r) for r in map(list, edge.rows())]
    got = suffix_tree.scored(edge.frame(spark)).collect()
    found = [(*r[:5], round(r.base_score, 6)) for r in got]
    assert sorted(found, key=edge.order) == sorted(plain_base(rows), key=edge.order)
    assert all(r.score < 0 for r in got)


class PlainTree:
    """The suffix tree of ``suffix_tree`` by plain dictionaries."""

    def __init__(self, texts, depth=suffix_tree.DEPTH):
        self.depth, self.texts = depth, [[*edge.words(t), None] for t in texts]
        self.count = Counter(tuple(t[i : i + k]) for t in self.texts for k in range(1, depth + 2) for i in range(len(t) - k + 1))
        self.kinds = len({w for t in self.texts for w in t})
        self.n = sum(map(len, self.texts))
        gain = Counter()
        for t in self.texts:
            for i in range(len(t)):
                for k in range(1, min(i, depth) + 1):
                    context = tuple(t[i - k : i])
                    if self.count[context] >= 2:
                        gain[context] += math.log(self.p(context, t[i], 1) / self.p(context[1:], t[i], 1))
        self.states = {c for c, g in gain.items() if g > suffix_tree.GAIN}

    def p(self, context, symbol, out=0):
        if not context:
            return (self.count[symbol,] - out + 1) / (self.n - out + self.kinds + 1)
        n = self.count[context] - out
        rest = n**suffix_tree.BETA
        return (self.count[(*context, symbol)] - out + rest * self.p(context[1:], symbol, out)) / (n + rest)

    def context(self, past):
        return next((c for k in range(self.depth, 0, -1) if len(past) >= k and (c := tuple(past[-k:])) in self.states), ())

    def score(self, text):
        own = [*edge.words(text), None]
        return sum(math.log10(self.p(self.context(own[:i]), w)) for i, w in enumerate(own))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def repetitive(n=120):
    phrases = [sentence("en", 6) for _ in range(8)]
    rows = [(i, " ".join(DRAW.choice(phrases) for _ in range(8)) + " " + sentence("de", 3), None, None) for i in range(n)]
    twice = sentence("fr", 40)
    return [*rows, (n, twice, None, None), (n + 1, twice, None, None), (n + 2, None, None, None), (n + 3, "", None, None)]


@pytest.mark.parametrize("bucket, size", [(suffix_tree.BUCKET, suffix_tree.SLICE), (300, 2000)])
def test_scores_equal_a_plain_suffix_tree(spark, monkeypatch, bucket, size):
    monkeypatch.setattr(suffix_tree, "BUCKET", bucket)
    monkeypatch.setattr(suffix_tree, "SLICE", size)
    rows = repetitive()
    tree = PlainTree([t for i, t, *_ in rows if not held(i)])
    assert {len(c) for c in tree.states} == {1, 2, 3}
    got = suffix_tree.scored(edge.frame(spark, rows)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: tree.score(t) for i, t, *_ in rows}, rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def test_distributions_sum_to_one():
    tree = PlainTree([t for _, t, *_ in repetitive(60)])
    symbols = [*{w for t in tree.texts for w in t}, "never seen"]
    for context in sorted(tree.states)[::40]:
        assert sum(tree.p(context, w) for w in symbols) == pytest.approx(1)


def test_text_that_occurs_twice_is_told_apart(spark):
    ids = [i for i in range(400) if not held(i)][:300]
    once = [(i, " ".join(sentence("en", 8) for _ in range(4)), None, None) for i in ids]
    rows = [*once[:-1], (ids[-1], once[0][1], None, None)]
    got = {r.doc_id: r.score / r.base_score for r in suffix_tree.scored(edge.frame(spark, rows)).collect()}
    assert max(got[ids[0]], got[ids[-1]]) < 0.5 * min(got[i] for i in ids[1:-1])


def test_packed_numbers():
    draw = np.random.default_rng(2)
    for width in (1, 4, 5, 8):
        for n in (0, 1, 1000):
            values = draw.integers(0, 2 ** (8 * width), n, dtype=np.uint64, endpoint=False) if width < 8 else draw.integers(0, 2**63, n).astype(np.uint64)
            assert (suffix_tree.unpacked(suffix_tree.packed(values, width), width) == values).all()


def test_scores_edges(spark):
    assert suffix_tree.scored(edge.frame(spark, [])).collect() == []
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = suffix_tree.scored(edge.frame(spark, [(held, "some words", None, None)])).collect()
    assert [tuple(r) for r in alone] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def brute(rows, queries, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q, x in sorted((i, v) for i, v in good if queries(i)):
        best = {}
        for i, v in good:
            if i != q:
                best[i] = max(best.get(i, -9e9), sum(a * b for a, b in zip(x, v)))
        yield from ((q, r, i) for r, (i, _) in enumerate(sorted(best.items(), key=lambda z: (-round(z[1], 9), z[0]))[:k], 1))


def vectors(n, copies=0):
    draw = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(copies)]
    return rows


def test_neighbors_exact_when_all_is_walked(spark):
    rows = vectors(300, 60) + [(900, None), (901, [0.0] * 8), (902, [1.0, None] * 4), (903, [float("nan")] * 8), (904, [1.0, float("inf")] * 4), (905, [1.0, 2.0]), (None, [1.0] * 8), (20, vectors(30)[20][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(brute(rows, lambda i: i % 20 == 0, 20))


def test_neighbors_blocks_and_recall(spark, monkeypatch):
    rows = vectors(3000, 900)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 40)
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20, centroids=16, least=10).collect()
    wanted = {(q, i) for q, _, i in brute(rows, lambda i: i % 20 == 0, 20)}
    assert len(got) == len(wanted)
    assert len(wanted & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(wanted)


def test_neighbors_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>")
    assert ann.search(empty, empty).collect() == [] == ann.search(some, empty).collect() == ann.search(empty, some).collect()
    assert len(ann.search(some, some).collect()) == 6


def test_layout_splits_large_cells(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    first, split = ann.layout(np.array([4, 4, 4, 25, 0, 3, 9]))
    assert split.tolist() == [1, 1, 1, 3, 1, 1, 1]
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6]


def test_walk_is_in_order():
    draw = np.random.default_rng(1)
    a, b, counts = draw.normal(size=9), draw.normal(size=7), draw.integers(0, 3, 63)
    total = (a[:, None] + b[None, :]).ravel()
    for need in (1, 10, 30, counts.sum(), 10**6):
        walked = ann.walk(a, b, counts, need)
        order = np.argsort(-total)
        n = int(walked.sum())
        assert set(np.flatnonzero(walked)) == set(order[:n].tolist())
        assert counts[walked].sum() >= min(need, counts.sum()) and (n == 63 or counts[order[: n - 1]].sum() < need)


def test_gains_are_sent_in_three_bytes():
    gain = np.concatenate([np.random.default_rng(4).normal(0, 3, 5_000), [0.0, 1.0, -1.0, 1e-6, 700.0]])
    sent = suffix_tree.rounded(gain)
    assert sent.max() < 1 << 24
    got = suffix_tree.gains_of(suffix_tree.packed(sent))
    assert np.abs(got - gain).max() <= np.abs(gain).max() * 2.0**-17 and (np.abs(got - gain) <= np.abs(gain) * 2.0**-16).all()
    assert got[-5:-2].tolist() == [0.0, 1.0, -1.0]
