import random

import pyarrow as pa
import pytest

from novelscape.llm import decontaminate
from tests.llm import edge

DRAW = random.Random(5)
VOCABULARY = ["".join(DRAW.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]


def prose(n):
    return " ".join(DRAW.choice(VOCABULARY) for _ in range(n))


ITEMS = [
    (1, prose(30)),
    (2, "how many apples does Anna have after 3 days when she buys 12 kg of fruit every 5 days and eats 3 of them"),
    (3, prose(6)),
    (4, None),
    (5, ""),
    (6, "one two three"),
    (7, "12 13 14 15 16 17 18 19 20 21"),
    (8, "a train leaves the town of Berlin at 9 and reaches Paris at 17 after 8 hours of travel"),
]


def docs():
    swapped = ITEMS[1][1].replace("Anna", "Peter").replace("3", "4").replace("12 kg", "90 miles").replace("5", "7")
    broken = ITEMS[1][1].replace("after 3 days", "after 4 days")
    texts = [
        prose(50) + ". " + ITEMS[0][1] + ". " + prose(40),
        prose(20) + "\n" + ITEMS[1][1] + "\n" + prose(5),
        prose(20) + ".\n" + swapped + ". " + prose(5),
        prose(20) + "\n" + broken,
        ITEMS[2][1].upper() + "!!",
        prose(300),
        ITEMS[6][1],
        "one two three",
        "%%% ".join(ITEMS[0][1].split()),
        ITEMS[0][1] + " " + prose(8000) + " " + ITEMS[7][1],
    ]
    return [(i, t, None, None) for i, t in enumerate(texts)] + [(None, ITEMS[0][1], None, None), (11, None, None, None), (12, "", None, None), (5, ITEMS[7][1], None, None)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, pos int, hash int")


@pytest.mark.parametrize("block", [4_000_000, 10])
def test_findings(spark, items, block):
    got = decontaminate.findings(edge.frame(spark, docs()), items, block=block).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {
        (0, 1, "exact"), (1, 2, "exact"), (2, 2, "reparameterised"), (4, 3, "exact"), (8, 1, "exact"), (9, 1, "exact"), (9, 8, "exact"), (None, 1, "exact"), (5, 8, "exact"),
        # Windows of the changed text that do not hold the inconsistent number.
        *{(r.doc_id, r.item_id, r.kind) for r in got if r.doc_id == 3},
    }
    first = {(r.doc_id, r.item_id): (r.n_windows, r.first_word) for r in got}
    assert first[0, 1] == (23, 50) and first[9, 8][1] == 8030


def test_against_plain_windows(spark, items):
    """Plain windows of eight words, compared one by one."""
    rows = [(i, t, None, None) for i, t in enumerate([prose(40) + " " + ITEMS[0][1][: 60 + 5 * i] + " " + prose(10) for i in range(12)])]
    wanted = set()
    bench = [w.split() for i, w in ITEMS[:1]][0]
    grams = {tuple(bench[k : k + 8]) for k in range(len(bench) - 7)}
    for i, t, *_ in rows:
        w = t.split()
        n = sum(tuple(w[k : k + 8]) in grams for k in range(len(w) - 7))
        if n:
            wanted.add((i, 1, n))
    got = decontaminate.findings(edge.frame(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id, r.n_windows) for r in got} == wanted and len(wanted) > 5


def test_clean(spark, items):
    frame = edge.frame(spark, docs())
    kept = decontaminate.clean(frame, items)
    assert kept.schema == frame.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id not in (3,)) == [6, 7, 11, 12]
    assert decontaminate.clean(edge.frame(spark, []), items).collect() == []
    assert decontaminate.clean(edge.frame(spark), items.limit(0)).count() == len(edge.rows())
    assert decontaminate.clean(edge.frame(spark), items).count() == len(edge.rows())


def test_clean_keeps_rows_without_id(spark, items):
    """Rows without id go only for their own text; rows with equal ids go together."""
    held = ITEMS[0][1]
    rows = [(None, held, "en", None), (None, prose(40), "en", None), (None, None, None, None), (None, "", None, None), (8, prose(30), "de", "a"), (9, held, "en", "a")]
    kept = decontaminate.clean(edge.frame(spark, rows), items).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((d, t) for d, t, *_ in rows if t != held), key=str)


def test_template_words():
    text = pa.array(["We paid Anna 12 kg. Then m won 3.5 km", None, "x\nNew line Bob"])
    hashes, kinds, part, begins = (own := decontaminate.Templates()).stream(text)
    words = [own.surfaces[p] for p in part]
    assert list(zip(words, kinds.tolist())) == [
        ("We", 0), ("paid", 0), ("Anna", 3), ("12", 1), ("kg", 2), ("Then", 0), ("m", 0), ("won", 0), ("3.5", 1), ("km", 2), ("x", 0), ("New", 0), ("line", 0), ("Bob", 3),
    ]
    assert begins.tolist() == [0, 10, 10, 14]


def test_copies_in_any_case_and_place(spark):
    """Copies whose capitals make other templates, and copies of few plain words."""
    rows = [(1, "What is the capital city of France?"), (2, "Anna paid Berlin 12 kg and Peter paid Rome 9 kg in May 2019"), (3, "Die Katze der Nachbarin frisst heute den Fisch aus Bremen")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = ["Q: What is the capital city of France?", "1) What is the capital city of France", "WHAT IS THE CAPITAL CITY OF FRANCE?", "so what is the capital city of france",
             "as: " + rows[1][1], rows[1][1].lower(), rows[2][1].upper(), "x " + rows[2][1].lower(), prose(40)]
    got = decontaminate.findings(edge.frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), items).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(i, k, "exact") for k, own in ((1, range(4)), (2, (4, 5)), (3, (6, 7))) for i in own}


def test_copy_with_one_slot_changed(spark):
    """One of two occurrences of a name changes: the windows without it are a copy, and those with it no finding."""
    before, between, after = prose(60), prose(80), prose(60)
    item = f"{before} Anna {between} Anna {after}"
    items = spark.createDataFrame([(1, item), (2, "we gave Anna ten of them and then Anna gave two of those to us")], "item_id long, text string")
    texts = [f"{before} Anna {between} Maria {after}", "we gave Berta ten of them and then Carla gave two of those to us", "we gave Berta ten of them and then Berta gave two of those to us"]
    docs = edge.frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.item_id, r.kind, r.n_windows) for r in decontaminate.findings(docs, items).collect()}
    # In the second text Anna is two people, in the third one.
    assert got == {(0, 1, "exact", 202 - 7 - 8), (2, 2, "reparameterised", 8)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [1]


def test_clean_keeps_chance_templates(spark):
    """One template of capitalised words in a long item drops no document; most of an item or a long run of it does."""
    names = lambda: ["".join(DRAW.choice("abcdefgh") for _ in range(7)).capitalize() for _ in range(60)]
    words, own, other = [DRAW.choice(VOCABULARY) for _ in range(600)], names(), names()
    long = lambda some, n: " ".join(f"{w} {some[i // 5]}" if i % 5 == 4 else w for i, w in enumerate(words[:n]))
    items = [(1, prose(30) + " in der Katze und in der Sonne " + prose(30)), (2, long(own, 300)), (3, "wir fahren heute mit dem Zug nach Bremen und dann mit dem Rad nach Hause")]
    texts = [
        prose(20) + " in der Schule und in der Kirche " + prose(20),
        prose(20) + " und in der Stadt und in der Nacht " + prose(20),
        prose(9) + " " + long(other, 60) + " " + prose(9),
        "wir fahren heute mit dem Bus nach Berlin und dann mit dem Schiff nach Polen",
        prose(9) + " " + long(own, 8),
    ]
    items[0] = (1, items[0][1].replace("in der Katze und in der Sonne", "der Vogel in der Katze und in der Sonne"))
    texts[0] = texts[0].replace("in der Schule", "der Hund in der Schule")
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = edge.frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    kinds = {(r.doc_id, r.item_id): r.kind for r in decontaminate.findings(docs, bench).collect()}
    assert kinds == {(0, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "reparameterised", (4, 2): "exact"}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [0, 1]
