import os
import random

import numpy as np
import pyarrow as pa

from novelscape.llm import common, lsh_forest
from tests.llm import edge


def shingles(text, size=3):
    w = edge.words(text)
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in enumerate(sets):
        inter = {}
        for x in own:
            for j in holders[x]:
                inter[j] = inter.get(j, 0) + 1
        for j, n in inter.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    names = [d if not own else least.get(top(i)) for i, ((d, *_), own) in enumerate(zip(rows, sets))]
    return sorted([(d, len(own), c, d == c) for (d, *_), own, c in zip(rows, sets, names)], key=edge.order)


def got(spark, rows):
    return sorted([tuple(r) for r in lsh_forest.near_duplicates(edge.frame(spark, rows)).collect()], key=edge.order)


def prose(draw, n):
    return [f"w{draw.randrange(3000)}" for _ in range(n)]


def changed(draw, words, n):
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"new{draw.randrange(10**6)}"
    return out


def copies(seed, groups, each):
    """Groups of texts that differ in a few words each, with similarities around 0.85."""
    draw = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = prose(draw, draw.randint(60, 300))
        texts += [" ".join(changed(draw, base, draw.randint(0, len(base) // 30))) for _ in range(each)]
    draw.shuffle(texts)
    return [(7 * i, t, "en", "s") for i, t in enumerate(texts)]


def test_edges(spark):
    rows = edge.rows()
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_near_copies(spark):
    rows = copies(1, 120, 3) + copies(2, 4, 60)
    assert got(spark, rows) == plain(rows)


def test_crowded_regions(spark, monkeypatch):
    """Regions go deeper, are sorted in parts and compared part by part."""
    rows = copies(3, 3, 80) + copies(4, 60, 2)
    expected = plain(rows)
    monkeypatch.setattr(lsh_forest.linked, "__defaults__", (9,))
    monkeypatch.setattr(lsh_forest, "SIGNED", 10)
    monkeypatch.setattr(lsh_forest, "WHOLE", 6)
    assert got(spark, rows) == expected


def test_just_similar_enough(spark):
    """Sets of 1..200 and a window of them: the similarity is 85 % or one shingle less."""
    words = [f"x{i}" for i in range(202)]
    at, below = words[: 170 + 2], words[: 169 + 2]
    rows = [(1, " ".join(words), None, None), (2, " ".join(at), None, None), (5, " ".join([*words[20:], "y"]), None, None)]
    assert [r[2] for r in got(spark, rows)] == [r[2] for r in plain(rows)]
    assert plain([rows[0], (9, " ".join(at), None, None)])[1][2] == 1 and plain([rows[0], (9, " ".join(below), None, None)])[1][2] == 9
    assert [r[2] for r in got(spark, [rows[0], (9, " ".join(at), None, None)])] == [1, 1]
    assert [r[2] for r in got(spark, [rows[0], (9, " ".join(below), None, None)])] == [1, 9]


def test_hot_copies(spark):
    rows = [(i, "the same text in very many rows of it", "en", "s") for i in range(2000)] + [(9000 + i, f"own text {i} of its own words {i * i} here", "en", "s") for i in range(50)]
    assert got(spark, rows) == plain(rows)


def test_signatures():
    draw = random.Random(6)
    errors = []
    for _ in range(150):
        base = prose(draw, 400)
        a, b = (" ".join(changed(draw, base, 8)) for _ in range(2))
        x, y = lsh_forest.sets_of(pa.array([a, b]))
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        errors.append(np.mean(lsh_forest.signature(x) == lsh_forest.signature(y)) - true)
        assert len(x) == len(shingles(a))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_labels_use_every_hash_once_at_the_first_depth():
    first = lsh_forest.LABELS[:, : lsh_forest.DEPTH]
    assert sorted(first.ravel()) == list(range(lsh_forest.HASHES))
    assert all(len(set(own)) == lsh_forest.DEEPEST for own in lsh_forest.LABELS.tolist())


def test_regions_deal_few_rows_for_one_large_component(spark):
    """Members of the main component meet all others, but not each other; no two of the others are missed."""
    main, rest = 400, 25
    rows = [(1, f"m{i}".encode(), b"main") for i in range(main)] + [(1, f"r{i}".encode(), f"r{i % 20}".encode()) for i in range(rest)]
    rows += [(2, f"q{i}".encode(), b"main") for i in range(30)]
    members = spark.createDataFrame(rows, "region long, set binary, root binary")
    got = lsh_forest.dealt(members, lsh_forest.shares(members), 40).collect()
    assert len(got) <= 2 * main
    cells = {}
    for r in got:
        cells.setdefault(r.cell, []).append(bytes(r.set))
    met = {frozenset((a, b)) for own in cells.values() for a in own for b in own}
    root = {s: r for _, s, r in rows if not s.startswith(b"q")}
    assert all(frozenset((a, b)) in met for a in root for b in root if root[a] != root[b])
    again = lsh_forest.dealt(members, lsh_forest.shares(members), 8).collect()
    cells = {}
    for r in again:
        cells.setdefault(r.cell, []).append(bytes(r.set))
    met = {frozenset((a, b)) for own in cells.values() for a in own for b in own}
    assert all(frozenset((a, b)) in met for a in root for b in root if root[a] != root[b])


def test_tables_are_dropped_after_use(spark, monkeypatch):
    """Labels are not stored, and of the tables of signatures and of neighbors none is left that nothing reads any more."""
    known, original = [], common.stored

    def stored(df, path=None):
        path = path or common.scratch(df.sparkSession)
        known.append((path, set(df.columns)))
        return original(df, path)

    monkeypatch.setattr(common, "stored", stored)
    docs = spark.createDataFrame([(i, f"{i // 3} " + " ".join(f"w{i // 3}x{j}" for j in range(60)) + f" {i % 3}") for i in range(30)], "doc_id long, text string")
    out = lsh_forest.near_duplicates(docs).collect()
    assert sorted(r["component_id"] for r in out) == [i // 3 * 3 for i in range(30)]
    left = [columns for path, columns in known if os.path.exists(path.removeprefix("file:"))]
    assert not any("label" in columns or "prefix" in columns for columns in left)
    assert sum("signature" in columns for columns in left) == 1


def test_candidates_are_compared_in_one_region(spark, monkeypatch):
    """Sets somewhat less similar than asked for share most trees, but are sent to few regions for their full comparison."""
    draw = random.Random(8)
    base = prose(draw, 200)
    rows = [(i, " ".join(changed(draw, base, 4)), "en", "s") for i in range(30)]
    sent, original = [], lsh_forest.compared

    def compared(members, sets, percent):
        sent.append((members.count(), members.select("set").distinct().count()))
        return original(members, sets, percent)

    monkeypatch.setattr(lsh_forest, "compared", compared)
    assert got(spark, rows) == plain(rows)
    ((members, classes),) = sent
    assert classes > 20 and members <= 10 * classes


def test_homes():
    """Two classes with one home of a tree share its region; below a crowded one they do so at the last depth."""
    codes = np.random.default_rng(1).integers(0, 3, (400, lsh_forest.HASHES), dtype=np.uint32)
    none = np.zeros(0, dtype=np.int64)
    crowded = lsh_forest.keys(codes[:9], 5, lsh_forest.DEPTH)
    for full in (none, crowded):
        home = lsh_forest.homes(codes, full)
        for tree in (0, 5, 31):
            label = codes[:, lsh_forest.LABELS[tree]]
            same = (label[:, None, : lsh_forest.DEPTH] == label[None, :, : lsh_forest.DEPTH]).all(axis=2)
            deep = np.isin(lsh_forest.keys(codes, tree, lsh_forest.DEPTH), full)
            same &= ~deep[:, None] | (label[:, None] == label[None, :]).all(axis=2)
            assert ((home[:, None, tree] == home[None, :, tree]) == same).all()
