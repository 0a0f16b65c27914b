import hashlib

import numpy as np
import xxhash

from novelscape.llm import components, line_dedup, near_copies, simhash
from tests.llm import edge

STRIP = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    keyed = [(d, t, [(edge.lower(x.strip(STRIP)), x) for x in (t or "").split("\n")]) for d, t, *_ in rows]
    first = {}
    for d, _, lines in keyed:
        for k, _ in lines:
            if len(k) >= 10:
                first[k] = min(first.get(k, (d is not None, d)), (d is not None, d), key=lambda x: (x[0], x[1] or 0))
    for d, t, lines in keyed:
        kept = [x for k, x in lines if len(k) < 10 or first[k] == (d is not None, d)]
        yield d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_lines(spark):
    got = line_dedup.with_kept_text(edge.frame(spark)).collect()
    found = [(r.doc_id, *r[-3:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in got]
    assert sorted(found, key=edge.order) == sorted(plain_lines(edge.rows()), key=edge.order)


def test_hot_line(spark):
    rows = [(i, f"line number {i} of all\nthis line is in every text\n{'x' * (i % 20)}", None, None) for i in range(3000)]
    got = line_dedup.with_kept_text(edge.frame(spark, rows)).collect()
    found = [(r.doc_id, *r[-3:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in got]
    assert sorted(found) == sorted(plain_lines(rows))


def test_keep_runs(spark):
    rows = [(1, "first line of it\nsecond line of it\nthird line of it", None, None), (2, "first line of it\nown line of two\nsecond line of it\nthird line of it\nend", None, None)]
    maps = line_dedup.keep_bitmaps(edge.frame(spark, rows)).collect()
    assert [(r.doc, r.n_dropped, r.keep_runs) for r in maps] == [(2, 3, [0, 1, 1, 2])]


def test_deduplicated_keeps_columns(spark):
    docs = edge.frame(spark)
    assert line_dedup.deduplicated(docs).schema == docs.schema
    assert line_dedup.deduplicated(edge.frame(spark, [])).collect() == []


def plain_fingerprint(text, shingle=4):
    w = edge.words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(codes, distance):
    label = list(range(len(codes)))
    changed = True
    near = [[j for j in range(len(codes)) if (codes[i] ^ codes[j]).bit_count() <= distance] for i in range(len(codes))]
    while changed:
        new = [min(label[j] for j in near[i]) for i in range(len(codes))]
        changed, label = new != label, new
    return label


def test_groups(spark):
    rows = edge.rows()
    codes = [plain_fingerprint(t) for _, t, *_ in rows]
    label = plain_groups(codes, 4)
    least = {}
    for (d, *_), x in zip(rows, label):
        least[x] = d if least.get(x) is None else least[x] if d is None else min(d, least[x])
    wanted = [(d, f"{c:016x}", least[x]) for (d, *_), c, x in zip(rows, codes, label)]
    got = simhash.near_duplicates(edge.frame(spark)).collect()
    assert sorted(((r.doc_id, r.fp.hex(), r.component_id) for r in got), key=edge.order) == sorted(wanted, key=edge.order)


def chained(seed, n):
    draw = np.random.default_rng(seed)
    out = [int(x) for x in draw.integers(0, 2**64, 30, dtype=np.uint64)]
    while len(out) < n:
        x = out[draw.integers(max(0, len(out) - 40), len(out))]
        for b in draw.choice(64, draw.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def test_links_of_dense_groups(spark):
    codes = chained(5, 700)
    label = plain_groups(codes, 4)
    for large in (20_000, 40, 8):  # the last ones deal again, and in parts
        fps = spark.createDataFrame([(bytearray(c.to_bytes(8, "big")),) for c in codes], "fp binary")
        found = components.components(simhash.links(fps, large=large)).collect()
        root = {bytes(r.node): bytes(r.root) for r in found}
        names = [c.to_bytes(8, "big") for c in codes]
        groups = [root.get(x, x) for x in names]
        assert len(set(zip(groups, label))) == len(set(groups)) == len(set(label))


def test_components_of_long_chains(spark):
    n = 600
    pairs = [(i, i + 1) for i in range(n) if i % 100 != 99] + [(5, 3), (7, 7), (3, 5)]
    got = components.components(spark.createDataFrame(pairs, "u int, v int")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, i // 100 * 100) for i in range(n + 1) if i % 100]
    assert components.components(spark.createDataFrame([], "u int, v int")).collect() == []


def shingles(text, size=5):
    w = edge.words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_roots(rows, percent=80):
    """The first row of each row's group; all texts without words are one."""
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def got_roots(spark, rows):
    """As ``plain_roots``, for rows that differ in id."""
    at = {d: i for i, (d, *_) in enumerate(rows)}
    groups = {}
    for r in near_copies.near_copies(edge.frame(spark, rows)).collect():
        groups.setdefault(bytes(r.root), []).append(at[r.doc_id])
    first = {i: min(own) for own in groups.values() for i in own}
    return [first[i] for i in range(len(rows))]


def around(draw, size, share):
    """Two texts of distinct words; the second has a tail that leaves a similarity of ``share`` or just more."""
    words = [f"w{x}" for x in draw.choice(10**9, size + 200, replace=False)]
    n = size - 4  # shingles of the first, all in the second
    return " ".join(words[:size]), " ".join(words[: size + int(n / share) - n])


def test_near_copies_on_both_sides(spark):
    draw = np.random.default_rng(2)
    for share, linked in ((0.8, True), (0.85, True), (0.79, False), (0.7, False)):
        rows = []
        for k in range(150):
            a, b = around(draw, 104 + k % 3 * 100, share)
            assert (len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8) == linked
            rows += [(2 * k, a, None, None), (2 * k + 1, b, None, None)]
        label = got_roots(spark, rows)
        found = sum(label[2 * k] == label[2 * k + 1] for k in range(150))
        assert found >= 146 if linked else found == 0
        assert all(x // 2 == i // 2 for i, x in enumerate(label))


def test_near_copies_of_crowds(spark):
    """Groups of texts changed again and again, so that chains reach from one text to quite another."""
    draw, rows = np.random.default_rng(7), []
    for group in range(6):
        family = [[f"g{group}w{x}" for x in draw.integers(0, 400, 160)]]
        for _ in range(30):
            own = list(family[draw.integers(len(family))])
            for at in draw.integers(0, 160, draw.integers(1, 6)):
                own[at] = f"n{draw.integers(10**9)}"
            family.append(own)
        rows += [" ".join(x) for x in family]
    draw.shuffle(rows)
    rows = [(5 * i, t, None, None) for i, t in enumerate(rows)]
    wanted = plain_roots(rows)
    got = got_roots(spark, rows)
    assert all(wanted[x] == wanted[i] for i, x in enumerate(got))
    assert sum(a != b for a, b in zip(got, wanted)) <= 2
    stay = near_copies.first_of_each(edge.frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in stay) == sorted({5 * x for x in got})


def test_dealt_classes_are_not_joined(spark, monkeypatch):
    """A class is dealt to 64 blocks; Spark takes that for one row and sends the side of a join to the driver and all tasks."""
    draw, plans = np.random.default_rng(5), []
    codes = [draw.bytes(64) for _ in range(40)]
    codes += [bytes([c[0] ^ 1, *c[1:]]) for c in codes[:20]]
    rows = [(f"{i:016d}".encode(), c, f"{i // 2 if 20 <= i < 40 else i:016d}".encode()) for i, c in enumerate(codes)]
    stored = near_copies.common.stored
    monkeypatch.setattr(near_copies.common, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, *a))
    found = near_copies.open_regions(spark.createDataFrame(rows, "set binary, fp binary, root binary")).collect()
    assert {int(bytes(r.set)) for r in found} == {*range(20), *range(40, 60)}
    assert {bytes(r.set): bytes(r.root) for r in found} == {s: root for s, _, root in rows if int(s) < 20 or int(s) >= 40}
    assert "MapInArrow" in plans[0] and "Join" not in plans[0]


def test_repeated_words_are_no_copies(spark):
    """Texts that are for the most part one shingle, again and again, differ in their sets."""
    rows = [(i, "x " * 400 + " ".join(f"t{i}-{k}" for k in range(60)), None, None) for i in range(6)]
    assert got_roots(spark, rows) == list(range(6))


def test_first_of_each_keeps_unique_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, a, None, None), (5, a, None, None), (5, b, None, None), (5, b, None, None), (9, b.upper(), None, None), (None, a, None, None), (None, b, None, None)]
    stay = near_copies.first_of_each(edge.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in stay), key=edge.order) == [(None, a), (None, b), (1, a), (5, b)]


def test_first_of_each_edges(spark):
    rows = edge.rows()
    docs = edge.frame(spark, rows)
    stay = near_copies.first_of_each(docs)
    assert stay.schema == docs.schema
    label, first = plain_roots(rows), {}
    for (d, t, *_), x in zip(rows, label):
        if d is not None:
            first[x] = min(first.get(x, d), d)
    got = [(r.doc_id, r.text) for r in stay.collect()]
    root = {(d, t): x for (d, t, *_), x in zip(rows, label)}
    assert sorted(d for d, _ in got if d is not None) == sorted(first.values())
    assert {root[x] for x in got if x[0] is not None} == set(first) and [d for d, _ in got].count(None) == 2
    assert near_copies.first_of_each(edge.frame(spark, [])).collect() == []
