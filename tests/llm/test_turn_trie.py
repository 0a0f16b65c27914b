import hashlib
import random
from collections import defaultdict

from novelscape.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, block long, key int, start int, name string, place int, size int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def step(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), len(text)


def plain(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append(((turn is not None, turn or 0), *step(role, text)))
    paths = {conv: [x[1:] for x in sorted(steps)] for conv, steps in talks.items()}
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            node = tuple(path[:d])
            members[node].append(conv)
            for up in range(d + 1):
                below[node[:up]].add(node)
        ends[tuple(path)].append(conv)
    out = []
    for node, convs in members.items():
        children = [x for x in below[node] if len(x) == len(node) + 1]
        leaves = [x for x in below[node] if not any(len(y) > len(x) for y in below[x])]
        saved = sum((len(members[x]) - 1) * x[-1][1] for x in below[node] if x)
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves), saved, sha))
    return sorted(out, key=str)


def got(spark, rows, **options):
    turns = turn_trie.numbered(frame(spark, rows))
    found = turn_trie.nodes(turns, turns.select("conv_id").distinct(), **options).collect()
    return sorted([tuple(r[c] for c in turn_trie.RESULT) for r in found], key=str)


def talks(seed, n, kinds=3, longest=9):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]) if draw.random() < 0.1 else "user", f"text {draw.randrange(kinds)}") for c in range(n) for t in range(draw.randint(1, longest))]


def small_tasks(monkeypatch):
    monkeypatch.setattr(turn_trie, "TASK_KEYS", 7)
    monkeypatch.setattr(turn_trie, "FAN", 2)
    monkeypatch.setattr(turn_trie, "CHUNK", 2)


def test_whole_keys(spark, monkeypatch):
    rows = talks(1, 120)
    assert got(spark, rows) == plain(rows)
    small_tasks(monkeypatch)
    assert got(spark, rows) == plain(rows)


def test_blocks(spark, monkeypatch):
    rows = talks(2, 60, kinds=2, longest=11)
    assert got(spark, rows, size=3) == plain(rows)
    small_tasks(monkeypatch)
    assert got(spark, rows, size=1) == plain(rows)


def test_hot_copies(spark, monkeypatch):
    small_tasks(monkeypatch)
    rows = [(c, t, "user", f"same {t}") for c in range(-40, 60) for t in range(4)] + [(100 + c, t, "user", f"same {t}") for c in range(5) for t in range(c)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, size=2) == plain(rows)


def test_edges(spark):
    rows = [
        (5, None, None, None), (5, 1, "", ""), (5, 1, "user", "ß" * 30_000), (5, 1, "user", "ß" * 30_000), (7, 2, "user", "b"), (7, None, "user", "a"),
        (7, 2, "user", "a"), (None, 1, "user", "x"), (-3, 9, None, None), (2**60, 1, "1:", "x"), (2**60 + 1, 1, "1", ":x"), (9, 1, "user", "a"), (9, 2, "user", "b"),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_without_turns(spark):
    turns = turn_trie.numbered(frame(spark, [(1, 1, "user", "x")]))
    members = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    found = sorted(tuple(r[c] for c in turn_trie.RESULT) for r in turn_trie.nodes(turns, members).collect())
    sha = [hashlib.sha256(x).hexdigest() for x in (b"2,3", b"1")]
    assert found == [(1, 0, None, 3, 1, 1, 0, sha[0]), (1, 1, 1, 1, 0, 1, 0, sha[1])]


def walk(node, before=b""):
    here = before + node.path
    for number in node.ends:
        yield here, number
    for byte, child in node.branches.items() if node.branches else ():
        yield from walk(child, here + bytes([byte]))


def test_radix_tree():
    draw = random.Random(4)
    words = [bytes(draw.choice([1, 2, *range(256)][: draw.choice([2, 6, 20, 256])]) for _ in range(draw.randint(0, 6))) for _ in range(3000)]
    words += [b"long path " * 40 + w for w in words[:300]]
    root = turn_trie.Node(b"", [])
    for number, word in enumerate(words):
        turn_trie.insert(root, word, number)
    found = list(walk(root))
    assert [w for w, _ in found] == sorted(words) and sorted(found) == sorted((w, i) for i, w in enumerate(words))
    assert all(words[number] == word for word, number in found)


def test_layouts_grow():
    node, seen = turn_trie.Node(b"", []), []
    for n, byte in enumerate(random.Random(5).sample(range(256), 256), 1):
        node.put(byte, turn_trie.Node(b"", [byte]))
        kind = node.branches
        seen.append((type(kind).__name__, getattr(kind, "limit", None)))
        assert [b for b, _ in kind.items()] == sorted(b for b, _ in kind.items()) and len(kind.items()) == n
        assert kind.find(byte).ends == [byte]
    assert [seen[i] for i in (3, 4, 15, 16, 47, 48)] == [("Sorted", 4), ("Sorted", 16), ("Sorted", 16), ("Indexed", None), ("Indexed", None), ("Direct", None)]
