"""Operator 11: prefix trie of conversations, from adaptive radix trees over turn ids.

A turn's id has 16 bytes, the md5 of its role and text. A conversation's key is its ids one after the other, so the order
of keys is that of a trie in which each turn is a step. Keys are sorted over all tasks; each task puts its run of keys
into an adaptive radix tree: nodes of 4, 16, 48 or 256 branches that grow as they fill, with compressed paths. Walking
the tree, only byte depths that end a turn give nodes of the trie. Those that hold the first or the last key of a task
may go on in its neighbors; they stay open and are merged along the sorted tasks, many fragments to a task and round after
round, so a prefix that all conversations share is no group of its own anywhere.

A conversation longer than ``block`` turns has a key for each block of them, below the name of the prefix before it. What
such blocks add to the nodes above them is worked out first, each block's trie counted with its smallest member. So no
conversation is ever gathered in one place, and no task holds more than its share of keys. The ids of the conversations
that end in a node are hashed as a stream, with one hash state at a time; SHA-256 has no parallel form.

Nodes: the root is the empty prefix, also of conversations without turns; a depth-d node is a distinct sequence of d
turns. Turns of one conversation are ordered by ``turn`` (null first), equal ones by their id; a repeated row is a
further turn. Null role and text are empty. Rows without ``conv_id`` are left out. Further columns are not read. An empty
table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.operators.ordering import sequence

WIDTH = 16
#: Turns of a block; keys of a task, and bytes of its keys; fragments that are merged at once; ids hashed at once.
BLOCK, TASK_KEYS, TASK_BYTES, FAN, CHUNK = 1024, 20_000, 8 << 20, 64, 1 << 15
#: Before the first turn of a conversation.
TOP = bytes(WIDTH)
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Layouts of a node's branches: up to 4 and up to 16 sorted bytes, an index of 256 into up to 48, and all 256.


class Sorted:
    """Up to ``limit`` branches, by their bytes in order."""

    __slots__ = ("limit", "bytes", "nodes")

    def __init__(self, limit: int = 4) -> None:
        self.limit, self.bytes, self.nodes = limit, bytearray(), []

    def find(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.limit:
            grown = Sorted(16) if self.limit == 4 else Indexed()
            for b, child in self.items():
                grown.put(b, child)
            return grown.put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> list[tuple[int, Node]]:
        return list(zip(self.bytes, self.nodes))


class Indexed:
    """Up to 48 branches behind an index of all bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self) -> None:
        self.index, self.nodes = bytearray(256), []

    def find(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == 48:
            grown = Direct()
            for b, child in self.items():
                grown.put(b, child)
            return grown.put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def items(self) -> list[tuple[int, Node]]:
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at]


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self) -> list[tuple[int, Node]]:
        return [(b, node) for b, node in enumerate(self.nodes) if node is not None]


class Node:
    """The compressed path behind a branch, the branches after it, and the numbers of the keys that end there."""

    __slots__ = ("path", "branches", "ends")

    def __init__(self, path: bytes, ends: list[int]) -> None:
        self.path, self.branches, self.ends = path, None, ends

    def put(self, byte: int, node: Node) -> None:
        self.branches = (self.branches or Sorted()).put(byte, node)


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax())


def insert(root: Node, key: bytes, number: int) -> None:
    node, at = root, 0
    while True:
        same = agreeing(node.path, key[at : at + len(node.path)])
        if same < len(node.path):
            lower = Node(node.path[same + 1 :], node.ends)
            lower.branches = node.branches
            byte, node.path, node.branches, node.ends = node.path[same], node.path[:same], None, []
            node.put(byte, lower)
        at += same
        if at == len(key):
            node.ends.append(number)
            return
        below = node.branches.find(key[at]) if node.branches else None
        if below is None:
            node.put(key[at], Node(key[at + 1 :], [number]))
            return
        node, at = below, at + 1


# A trie node that is being put together: its depth in its block, its smallest conversation, how many go through it, its
# closed children, leaves and saved tokens below, and the code points of its last turn.
LEAST, COUNT, CHILDREN, LEAVES, SAVED, SIZE = range(6)
FIGURES = ("least", "count", "children", "leaves", "saved", "size")
KINDS = {
    "kind": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "parent": pa.binary(), "name": pa.binary(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
    "fragment": pa.int32(), "key": pa.binary(), "block": pa.int64(), "start": pa.int32(), **{f: pa.list_(pa.int64()) for f in FIGURES}, "ids": pa.binary(),
}
CLOSED, OPEN, ENDS = range(3)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
SCHEMA = ", ".join(f"{name} {_NAMES[kind]}" for name, kind in KINDS.items())


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(name) for r in rows], kind) for name, kind in KINDS.items()], names=list(KINDS))


def names_of(key: bytes) -> list[bytes]:
    """The name of the prefix at each depth of a key."""
    top, h = key[:WIDTH], hashlib.md5()
    out = [hashlib.md5(top + h.digest()).digest()]
    for at in range(WIDTH, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(hashlib.md5(top + h.digest()).digest())
    return out


def closed(depth: int, block: int, size: int, figures: list[int], **more) -> dict:
    """The finished row of a node."""
    least, count, children, leaves, saved, text = figures
    if not children and depth < size:
        leaves += 1
    return {
        "kind": CLOSED, "start": depth, "conv_id": least, "depth": block * size + depth, "n_convs": count, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved + (count - 1) * text, **more,
    }


def spine(fragment: int, key: bytes, block: int, start: int, figures: list[list[int]]) -> dict:
    return {"kind": OPEN, "fragment": fragment, "key": key, "block": block, "start": start, **dict(zip(FIGURES, map(list, zip(*figures))))}


def fragment_of(number: int, rows: list[dict], size: int) -> Iterator[dict]:
    """The nodes of sorted keys: closed ones, the open ones along the first and the last key, and ends of open ones."""
    root = Node(b"", [])
    for at, row in enumerate(rows):
        insert(root, row["key"], at)
    first, last = rows[0]["key"], rows[-1]["key"]
    named = {True: names_of(first), False: names_of(last)}
    spines = {True: [], False: []}
    # Frames: node, its first byte, whether it holds the first and the last key, branches left, figures of what is below, and
    # rows whose parent is not closed yet.
    stack = [(root, 0, True, True, iter(root.branches.items() if root.branches else ()), [None, 0, 0, 0, 0], [])]
    while stack:
        node, begin, left, right, branches, below, waiting = stack[-1]
        end = begin + len(node.path)
        after = next(branches, None)
        if after is not None:
            byte, child = after
            on = [flag and len(key) > end and key[end] == byte for flag, key in ((left, first), (right, last))]
            stack.append((child, end + 1, *on, iter(child.branches.items() if child.branches else ()), [None, 0, 0, 0, 0], []))
            continue
        stack.pop()
        for at in node.ends:
            row = rows[at]
            below[LEAST] = row["conv_id"] if below[LEAST] is None else min(below[LEAST], row["conv_id"])
            below[COUNT] += 1
            below[LEAVES] += row["below_leaves"]
            below[SAVED] += row["below_saved"]
        ended = [rows[at]["conv_id"] for at in node.ends if rows[at]["ends"]]
        # Keys below share the path, so any of them tells the texts' sizes and the block.
        some = rows[node.ends[0]] if node.ends else waiting[0]["some"] if waiting else None
        if some is None:
            some = rows[0] if left else rows[-1]
        for depth in range(end // WIDTH - 1, -1, -1):
            stop = WIDTH * (depth + 1)
            if stop < begin:
                break
            figures = [*below, some["sizes"][depth - 1] if depth else 0]
            # Keys end where a turn does, so these belong to the deepest node of the path.
            here, ended = ended, []
            if left or right:
                name = named[left][depth]
                spines[left].append(figures)
                for row in waiting:
                    row["parent"] = name
                for at in range(0, len(here), CHUNK):
                    yield {"kind": ENDS, "name": name, "fragment": number, "start": at // CHUNK, "ids": ",".join(map(str, here[at : at + CHUNK])).encode()}
                yield from map(finished, waiting)
                below, waiting = [below[LEAST], below[COUNT], 0, 0, 0], []
                continue
            for row in waiting:
                row["parent_conv_id"] = below[LEAST]
            yield from map(finished, waiting)
            row = closed(depth, some["block"], size, figures, some=some)
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, here)).encode()).hexdigest() if here else NO_ENDS
            if depth == 0 or depth == size:
                row["name"] = some["key"][:WIDTH] if depth == 0 else names_of(some["key"][:stop])[-1]
            waiting, below = [row], [below[LEAST], below[COUNT], 1, row["n_leaves"], row["saved_tokens"]]
        if stack:
            up, more = stack[-1][5], stack[-1][6]
            more.extend(waiting)
            if below[LEAST] is not None:
                up[LEAST] = below[LEAST] if up[LEAST] is None else min(up[LEAST], below[LEAST])
            for what in (COUNT, CHILDREN, LEAVES, SAVED):
                up[what] += below[what]
        else:
            yield from map(finished, waiting)
    yield spine(number, first, rows[0]["block"], 0, spines[True][::-1])
    if spines[False]:
        # The nodes that hold the first key, too, are with that.
        yield spine(number, last, rows[-1]["block"], len(last) // WIDTH - len(spines[False]), spines[False][::-1])


def finished(row: dict) -> dict:
    row.pop("some", None)
    return row


def merged(number: int, spines: list[dict], size: int, final: bool) -> Iterator[dict]:
    """Nodes that close between neighboring fragments, and the open ones along the first and the last key of them all.

    ``spines`` are sorted by fragment, that of the first key before that of the last.
    """
    path, key, names, block = [], b"", [], 0
    left, left_key, left_block = [], spines[0]["key"], spines[0]["block"]

    def close(depth: int) -> dict:
        name = names[depth]
        row = closed(depth, block, size, path[depth], name=name)
        if depth == 0:
            row["key"] = key[:WIDTH]
        else:
            row["parent"] = names[depth - 1]
            up = path[depth - 1]
            up[CHILDREN] += 1
            up[LEAVES] += row["n_leaves"]
            up[SAVED] += row["saved_tokens"]
        return row

    def leave(shared: int) -> Iterator[dict]:
        """Close what the next key is not below of; what the first key is below of stays open unless this is the last round."""
        while len(path) > shared:
            depth = len(path) - 1
            if final or not (depth < len(left) and path[depth] is left[depth]):
                yield close(depth)
            path.pop()

    for one in spines:
        figures = [list(x) for x in zip(*(one[f] for f in FIGURES))]
        yield from leave(agreeing(key, one["key"]) // WIDTH)
        key, block = one["key"], one["block"]
        names = names_of(key)
        for depth, figure in enumerate(figures, one["start"]):
            if depth < len(path):
                known = path[depth]
                known[LEAST] = min(known[LEAST], figure[LEAST])
                for what in (COUNT, CHILDREN, LEAVES, SAVED):
                    known[what] += figure[what]
            else:
                path.append(figure)
        if one is spines[0]:
            left = list(path)
    if final:
        yield from leave(0)
        return
    yield spine(number, left_key, left_block, 0, left)
    start = next((d for d, node in enumerate(path) if not (d < len(left) and node is left[d])), len(path))
    if start < len(path):
        yield spine(number, key, block, start, path[start:])


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, id, size`` of each turn: its place from 1, its id as hex, and its text's code points."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    known = conversations.where("conv_id is not null")
    turns = known.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.length(text).cast("long").alias("size"),
    )
    return sequence(turns, ["conv_id"], ["turn", "id"], "place").drop("turn")


def keys(turns: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``conv_id, block, key, sizes, ends``: a row for each started block of a conversation's turns."""
    block = F.expr(f"(place - 1) div {size}")
    cells = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "size"))).alias("x"))
    ids = F.unhex(F.array_join(F.col("x.id"), ""))
    own = common.stored(cells.select("conv_id", "block", ids.alias("ids"), F.col("x.size").alias("sizes")))
    full = F.size("sizes") == size
    counts = own.groupBy("conv_id").agg(F.max("block").alias("last"), F.max(F.when(full, F.col("block"))).alias("whole"))
    bare = members.select("conv_id").join(counts, "conv_id", "left").where("last is null or last = whole")
    nothing = F.array().cast("array<long>")
    bare = bare.select("conv_id", (F.coalesce("last", F.lit(-1)) + 1).alias("block"), F.lit(b"").alias("ids"), nothing.alias("sizes"), F.lit(True).alias("ends"))
    rows = own.withColumn("ends", ~full).unionByName(bare)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, blocks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "blocks"))):
                top = TOP
                for x in blocks:
                    top = hashlib.md5(top + bytes.fromhex(x["digest"])).digest()
                    out.append((conv, x["block"] + 1, top))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[], [], []], (pa.int64(), pa.int64(), pa.binary()))], names=["conv_id", "block", "top"])

    digests = own.where(full).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", F.md5("ids").alias("digest")))).alias("blocks"))
    tops = digests.mapInArrow(chain, "conv_id long, block long, top binary")
    key = F.concat(F.coalesce("top", F.lit(TOP)), "ids")
    return rows.join(tops, ["conv_id", "block"], "left").select("conv_id", "block", key.alias("key"), "sizes", "ends")


def trie(rows: DataFrame, size: int) -> DataFrame:
    """The nodes of the tries of all blocks: ``RESULT``, ``start``, a node's depth in its block, and ``name``.

    The name of a block's first node is that of the prefix before the block; at ``size`` turns it is that of the next block.
    """
    spark = rows.sparkSession
    weight = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("bytes")).first()
    parts = common.tasks(spark, max(weight.n / TASK_KEYS, weight.bytes / TASK_BYTES), 1)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.to_pylist()]
        if held:
            yield from in_batches(fragment_of(held[0]["fragment"], held, size))

    dealt = rows.repartitionByRange(parts, "key", "conv_id").withColumn("fragment", F.spark_partition_id()).sortWithinPartitions("key", "conv_id")
    found = common.stored(dealt.mapInArrow(grow, SCHEMA))
    spines, joints = found.where(F.col("kind") == OPEN), []
    while True:
        parts = -(-parts // FAN)
        step = common.stored(spines.groupBy(F.expr(f"fragment div {FAN}").cast("int").alias("to")).applyInArrow(merge(size, parts == 1), SCHEMA))
        joints.append(step.where(F.col("kind") == CLOSED))
        spines = step.where(F.col("kind") == OPEN)
        if parts == 1:
            break
    hashes = ends_hashes(found.where(F.col("kind") == ENDS))
    joint = reduce(DataFrame.unionByName, joints).drop("ends_sha256").join(hashes, "name", "left")
    joint = common.stored(joint.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    columns = [*RESULT, "start", "name"]
    every = found.where(F.col("kind") == CLOSED).select(*columns, "parent").unionByName(joint.select(*RESULT, "start", F.coalesce("key", "name").alias("name"), "parent"))
    above = joint.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    pending = every.where("parent is not null").drop("parent_conv_id").join(above, "parent").withColumnRenamed("above", "parent_conv_id")
    return every.where("parent is null").select(columns).unionByName(pending.select(columns))


def in_batches(rows: Iterator[dict], n: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield batch_of(held)
            held = []
    yield batch_of(held)


def merge(size: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        spines = sorted(table.select(["fragment", "key", "block", "start", *FIGURES]).to_pylist(), key=lambda s: (s["fragment"], s["start"] > 0, s["key"]))
        return pa.Table.from_batches(list(in_batches(merged(spines[0]["fragment"] // FAN, spines, size, final))))

    return run


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the open nodes in which conversations end; a node's ids pass as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                name, ids = batch.column("name")[at].as_py(), batch.column("ids")[at].as_py()
                if name != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if now is not None:
            out.append((now, state.hexdigest()))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["name", "ends_sha256"])

    dealt = ends.select("name", "fragment", "start", "ids").repartition("name").sortWithinPartitions("name", "fragment", "start")
    return dealt.select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def nodes(turns: DataFrame, members: DataFrame, size: int = BLOCK) -> DataFrame:
    """The trie of ``turns`` (see ``numbered``); ``members`` has the ``conv_id`` of all conversations, once each.

    Per node: ``conv_id`` (its smallest conversation), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of its subtree, and ``ends_sha256`` of the conversations that end there.
    """
    rows = common.stored(keys(turns, members, size))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("below_leaves", "below_saved")]
    several = rows.where("block > 0")
    if several.isEmpty():
        return trie(rows.select("*", *nothing), size).select(RESULT)
    # What a later block's trie holds counts with its smallest conversation, in the rows of that one's earlier blocks.
    tops = trie(several.select("*", *nothing), size).where("start = 0")
    owned = tops.select("conv_id", F.expr(f"depth div {size}").alias("block"), "n_leaves", "saved_tokens")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(c).over(later).alias(b) for c, b in (("n_leaves", "below_leaves"), ("saved_tokens", "below_saved"))]
    below = rows.select("conv_id", "block").join(several.select("conv_id").distinct(), "conv_id", "left_semi")
    below = below.join(owned, ["conv_id", "block"], "left").select("conv_id", "block", *sums)
    told = rows.join(below, ["conv_id", "block"], "left").na.fill(0, ["below_leaves", "below_saved"])
    found = common.stored(trie(told, size))
    # Where a block ends the next begins: one node, whose children and ends are in the later trie.
    begins = (F.col("start") == 0) & (F.col("depth") > 0)
    after = found.where(begins).select("name", F.col("n_children").alias("children"), F.col("ends_sha256").alias("ends"))
    seams = found.where(F.col("start") == size).join(after, "name")
    seams = seams.withColumn("n_children", F.col("children")).withColumn("ends_sha256", F.col("ends"))
    return found.where(~begins & (F.col("start") != size)).select(RESULT).unionByName(seams.select(RESULT))
