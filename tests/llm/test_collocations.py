import random
import re
from collections import Counter

import numpy as np

from novelscape.llm import collocations
from tests.llm import edge


def plain(rows, least, longest=5, top=2000):
    totals, counts = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", edge.lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang or "und", *w[i : i + m]) for i in range(len(w) - m + 1))
    often = {p: n for p, n in counts.items() if n >= least}
    out = []
    for (lang, *w), a in often.items():
        longer = [b for (other, *x), b in often.items() if other == lang and len(x) > len(w) and f" {' '.join(w)} " in f" {' '.join(x)} "]
        if len(w) < 2 or any(100 * b >= 100 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = often[(lang, *w[:k])], often[(lang, *w[k:])]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), a, l, r, totals[lang], score))
    out.sort()
    rank, found = Counter(), []
    for lang, _, _, phrase, a, l, r, n, score in out:
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), a, l, r, n, score))
    return found


def got(spark, rows, **options):
    return sorted(tuple(r) for r in collocations.collocations(edge.frame(spark, rows), **options).collect())


def prose(seed, n):
    draw = random.Random(seed)
    word = lambda: f"{draw.choice('AabcÉ')}{draw.choice(['', 'x', 'yÉ'])}"
    gap = lambda: draw.choices([" ", "  ", "\t", ", ", "\n", "\r\n", "! "], [20, 2, 2, 1, 1, 1, 1])[0]
    texts = ["".join(word() + gap() for _ in range(draw.randint(0, 60))) for _ in range(n)]
    return [(i, t, draw.choice(["en", "de", None, "und"]), "s") for i, t in enumerate(texts)]


def test_like_a_plain_count(spark):
    rows = prose(1, 80) + [(900 + i, "never seen before and again never seen before, of course" + " seen" * (i % 3), "en", "s") for i in range(30)]
    for least in (5, 12):
        assert got(spark, rows, least=least) == sorted(plain(rows, least))


def test_edges(spark):
    rows = edge.rows()
    assert got(spark, rows, least=2) == sorted(plain(rows, 2))
    assert got(spark, rows, least=2, longest=2, top=3) == sorted(plain(rows, 2, 2, 3))


def test_hot_phrase_and_repeats(spark):
    rows = [(i % 7, "a b c d e f", "en", "s") for i in range(400)] + [(i, "a b", "en", "s") for i in range(300)]
    assert got(spark, rows, least=100) == sorted(plain(rows, 100))


def test_nothing_frequent(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, None, None), (2, ", . !", "en", "s"), (3, "one two", "en", "s")], least=2) == []


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TEXT", 300)
    monkeypatch.setattr(collocations, "SLICE", 100)
    monkeypatch.setattr(collocations, "OPEN", 150)
    rows = prose(2, 60)
    assert got(spark, rows, least=4) == sorted(plain(rows, 4))


def test_tiles():
    draw = np.random.default_rng(0)
    codes = draw.integers(0, 3000, 60_000) << collocations.LOW | draw.integers(0, 900, 60_000) ** 2 // 900
    for dense in (1, 800, 10**9):
        code, n = collocations.tile_counts(codes, dense)
        order = np.argsort(code)
        assert [x.tolist() for x in np.unique(codes, return_counts=True)] == [code[order].tolist(), n[order].tolist()]


def test_large_products(spark):
    rows = [(1, "x y", "en", "s")]
    wide = collocations.collocations(edge.frame(spark, rows * 3), least=3)
    assert [tuple(r) for r in wide.collect()] == [("en", 1, "x y", 3, 3, 3, 6, 2000)]
