"""Operator 8: find benchmark passages in documents, also with other numbers, names and units.

Texts become template words: letters are lower-cased words, numbers are one placeholder, a unit after a number another,
and a capitalised word inside a sentence a third. Windows of template words of the benchmark are hashed; documents'
windows are kept if their hash is among them, and joined by hash with the benchmark's. So are windows of the lower-cased
words as they are, numbers and names among them, so that a copy is found whatever its case, its place in a sentence or
its share of placeholders. Windows of a document and an item that lie on one diagonal are a passage. Those of words as
they are make an ``exact`` one, whatever lies between them. Template windows with other values make a
``reparameterised`` one if the placeholders' values are consistent along it: each value of the benchmark stands for one
value of the document and the other way round. What is inconsistent is no finding. ``clean`` drops a document for one
``exact`` window, but for a ``reparameterised`` passage only if it has several windows and most of the item's, or ``LONG``
of them: capitalised words are frequent, and single templates of them match texts that share nothing else.

The benchmark's hashes are broadcast in blocks of bounded size, as many as it takes. An item shorter than a window is
one window of all its words, but items of fewer than ``literal`` words are never found. A template window needs
``literal`` plain words to count, a window of words as they are one word that is no number. Null and empty texts hold
nothing. Rows with equal ``doc_id`` are one document; rows without ``doc_id`` are found under null, but ``clean`` takes each
of them by itself.
Further columns are not read. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.llm import common

WINDOW, LITERAL = 8, 4
#: Windows of a reparameterised passage that drop a document whatever the item's length.
LONG = 32
#: Benchmark windows whose hashes are broadcast at once.
BLOCK = 4_000_000
# Units after numbers.
UNITS = frozenset(
    "m cm mm km g kg mg t l ml s ms min h d b kb mb gb tb hz khz mhz ghz w kw mw v a c f k n j pa bar mol "
    "meter meters metre metres kilometer kilometers centimeter centimeters inch inches foot feet yard yards mile miles "
    "gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees "
    "dollar dollars euro euros cent cents usd eur gbp".split()
)
NUMBER, UNIT, NAME = 1, 2, 3
#: Placeholder marks and how they read in a template.
MARKS = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
_PART = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*")
_MIXER = np.uint64(0x9E3779B97F4A7C15)
_MARKED = {kind: xxhash.xxh64_intdigest(mark, 7) for kind, mark in MARKS.items()}
_LOW = np.uint64((1 << 24) - 1)
_CLOSING = "\"')]}»”’*#$%&"
#: Words whose parts a task remembers.
REMEMBERED = 300_000


class Templates:
    """Template words of blank-separated words, each worked out once.

    A part of a word has a kind and a hash as it is, another kind and hash if it begins a sentence (a name is a plain
    word there), and another hash if it follows a number (a unit). Its third hash is that of its lower-cased letters or
    digits, whatever its kind.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ends = np.zeros(0, dtype=bool)
        self.surfaces: list[str] = []
        self.kinds = np.zeros((2, 0), dtype=np.int8)
        self.units = np.zeros(0, dtype=bool)
        self.hashes = np.zeros((3, 0), dtype=np.uint64)

    def learn(self, new: list[str]) -> None:
        """Latin words with or without marks behind, nearly all words, are worked out together, others one by one."""
        words = pa.array(new, pa.string())
        simple = np.asarray(pc.match_substring_regex(words, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*$"))
        bare = pc.utf8_rtrim(words.filter(pa.array(simple)), ".,;:!?")
        plain = pc.utf8_lower(bare)
        digest = xxhash.xxh64_intdigest
        own = np.array([digest(x, 7) for x in plain.to_pylist()], dtype=np.uint64)
        name = np.asarray(pc.match_substring_regex(bare, "^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+$"))
        kinds = [np.where(name, NAME, 0).astype(np.int8)]
        hashes = [np.where(name, np.uint64(_MARKED[NAME]), own), own]
        units = [np.asarray(pc.is_in(plain, pa.array(sorted(UNITS))))]
        ends = [np.asarray(pc.match_substring_regex(words.filter(pa.array(simple)), "[.!?]$"))]
        lengths, odd = [np.ones(len(own), dtype=np.int64)], np.flatnonzero(~simple)
        more = [self.parts(new[i]) for i in odd.tolist()]
        flat = [x for parts, _ in more for x in parts]
        surfaces = bare.to_pylist() + [x[0] for x in flat]
        kinds = np.concatenate([*kinds, np.array([x[1] for x in flat], dtype=np.int8)])
        first = np.concatenate([hashes[0], np.array([x[2] for x in flat], dtype=np.uint64)])
        heads = np.concatenate([hashes[1], np.array([x[3] for x in flat], dtype=np.uint64)])
        exact = np.concatenate([own, np.array([x[4] for x in flat], dtype=np.uint64)])
        lengths = np.concatenate([*lengths, np.array([len(parts) for parts, _ in more], dtype=np.int64)])
        order = np.flatnonzero(simple).tolist() + odd.tolist()
        self.place.update(zip([new[i] for i in order], range(len(self.starts), len(self.starts) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.surfaces) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ends = np.concatenate([self.ends, *ends, np.array([end for _, end in more], dtype=bool)])
        self.kinds = np.concatenate([self.kinds, [kinds, np.where(kinds == NAME, 0, kinds)]], axis=1)
        self.units = np.concatenate([self.units, *units, np.array([x[0].lower() in UNITS for x in flat], dtype=bool)])
        self.hashes = np.concatenate([self.hashes, [first, heads, exact]], axis=1)
        self.surfaces.extend(surfaces)

    @staticmethod
    def parts(word: str) -> tuple[list[tuple[str, int, int, int, int]], bool]:
        """Surface, kind, hash, hash at the start of a sentence and as it is of each part, and whether the word ends a sentence."""
        out = []
        for part in _PART.findall(word):
            own = xxhash.xxh64_intdigest(part.lower(), 7)
            if part[0].isdigit():
                out.append((part, NUMBER, _MARKED[NUMBER], _MARKED[NUMBER], own))
            elif len(part) > 1 and part[0].isupper() and part[1:].islower():
                out.append((part, NAME, _MARKED[NAME], own, own))
            else:
                out.append((part, 0, own, own, own))
        return out, word == common.LINE or word.rstrip(_CLOSING)[-1:] in (".", "!", "?")

    def stream(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts: template word hashes, kinds, surfaces by number, and where texts start."""
        codes, distinct, offsets = common.words(text, lines=True)
        if len(self.place) > REMEMBERED:
            self.forget()
        distinct = distinct.to_pylist()
        self.learn([w for w in distinct if w not in self.place])
        word = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[codes]
        lengths = self.lengths[word]
        part = common.ragged(self.starts[word], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        begins = before[offsets]
        # The first word of a text or after the end of a sentence is no name.
        initial = np.ones(len(word) + 1, dtype=bool)
        initial[1:] = self.ends[word]
        initial[offsets[:-1]] = True
        heads = before[:-1][initial[:-1] & (lengths > 0)]
        hashes, kinds = self.hashes[0][part], self.kinds[0][part]
        hashes[heads], kinds[heads] = self.hashes[1][part[heads]], self.kinds[1][part[heads]]
        # A unit is one after a number only.
        unit = np.flatnonzero(self.units[part[1:]] & (kinds[:-1] == NUMBER)) + 1
        unit = unit[~np.isin(unit, begins)]
        hashes[unit], kinds[unit] = _MARKED[UNIT], UNIT
        return hashes, kinds, part, begins


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` template words."""
    out = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + len(out)]) * _MIXER
        out ^= out >> np.uint64(29)
    return out


def windows(table: DataFrame, ident: str, size: int, literal: int, shorter: bool, wanted=None) -> DataFrame:
    """``ident, exact, pos, size, hash, template, slots`` of windows; only those in the broadcast ``wanted`` if it is given.

    ``exact`` windows are of words as they are, others of template words. With ``shorter``, a text of fewer than ``size``
    words has one window; ``size`` words of a document are matched with shorter items through ``wanted``, which maps
    ``exact`` and window sizes to sorted hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates()
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                hashes, kinds, stream, begins = own.stream(text.slice(low, high - low))
                plain, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (kinds == 0, kinds != NUMBER))
                row_of = np.repeat(np.arange(high - low), np.diff(begins))
                streams = {False: hashes, True: own.hashes[2][stream]}
                rows, places, sizes, found, whole = [], [], [], [], []
                if wanted is None:
                    for r, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                        n = size if b - a >= size or not shorter else b - a
                        if n and b - a >= n:
                            at = np.arange(a, b - n + 1)
                            for exact, some in streams.items():
                                rows.append(np.full(len(at), r)), places.append(at), sizes.append(np.full(len(at), n)), whole.append(np.full(len(at), exact))
                                found.append(window_hashes(some[a:b], n))
                else:
                    for (exact, n), (known, low_bits) in wanted.value.items():
                        mine = window_hashes(streams[exact], n)
                        at = np.flatnonzero(low_bits[(mine & _LOW).astype(np.int64)])
                        at = at[known[np.minimum(np.searchsorted(known, mine[at]), len(known) - 1)] == mine[at]]
                        at = at[row_of[at] == row_of[at + n - 1]]
                        rows.append(row_of[at]), places.append(at), sizes.append(np.full(len(at), n)), whole.append(np.full(len(at), exact))
                        found.append(mine[at])
                if not rows:
                    continue
                rows, places, sizes, found, whole = (np.concatenate(x) for x in (rows, places, sizes, found, whole))
                enough = plain[places + sizes] - plain[places] >= literal
                good = np.where(whole, (sizes >= literal) & (letters[places + sizes] > letters[places]), enough)
                rows, places, sizes, found, whole = rows[good], places[good], sizes[good], found[good], whole[good]
                templates, slots = [], []
                for p, n, exact in zip(places.tolist(), sizes.tolist(), whole.tolist()):
                    kind, word = [0] * n if exact else kinds[p : p + n].tolist(), [own.surfaces[c] for c in stream[p : p + n].tolist()]
                    templates.append(" ".join(MARKS.get(k) or w.lower() for k, w in zip(kind, word)))
                    slots.append([f"{k} {w.lower()}" for k, w in zip(kind, word) if k])
                yield pa.record_batch(
                    [batch.column("id").slice(low, high - low).take(pa.array(rows, pa.int64())), pa.array(whole, pa.bool_()), pa.array(places - begins[rows], pa.int64()),
                     pa.array(sizes, pa.int32()), pa.array(found.view(np.int64), pa.int64()), pa.array(templates, pa.string()), pa.array(slots, pa.list_(pa.string()))],
                    names=["id", "exact", "pos", "size", "hash", "template", "slots"],
                )

    plain = table.select(F.col(ident).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "id long, exact boolean, pos long, size int, hash long, template string, slots array<string>")


def findings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, n_windows, first_word, kind`` of each benchmark item that a document holds a passage of."""
    items = common.stored(windows(benchmark, "item_id", window, literal, True))
    return matched(docs, items, window, literal, block)


def matched(docs: DataFrame, items: DataFrame, window: int, literal: int, block: int) -> DataFrame:
    """Findings from the stored windows of the items."""
    spark = docs.sparkSession
    hashes = items.select("exact", "size", "hash").distinct()
    blocks = max(1, -(-hashes.count() // block))
    hits = None
    for number in range(blocks):
        part = hashes_of(spark, hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == number))
        some = windows(docs, "doc_id", window, literal, False, part)
        hits = some if hits is None else hits.union(some)
    a = hits.select(F.col("id").alias("doc_id"), "exact", F.col("pos").alias("at"), "size", "hash", "template", F.col("slots").alias("doc_slots"))
    b = items.select(F.col("id").alias("item_id"), "exact", F.col("pos").alias("item_at"), "size", "hash", "template", F.col("slots").alias("item_slots"))
    pairs = a.join(b, ["exact", "hash", "size", "template"]).select(
        "doc_id", "item_id", "exact", "at", (F.col("at") - F.col("item_at")).alias("diagonal"),
        F.arrays_zip(F.col("item_slots").alias("item"), F.col("doc_slots").alias("doc")).alias("values"),
    )
    # Template windows with equal values are found as they are.
    changed = F.exists("values", lambda v: v.getField("item") != v.getField("doc"))
    passages = pairs.where(F.col("exact") | changed).groupBy("doc_id", "item_id", "diagonal", "exact").agg(
        F.count_distinct("at").alias("n_windows"), F.min("at").alias("first_word"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values")
    )
    distinct = [F.size(F.array_distinct(F.col(f"values.{side}"))) for side in ("item", "doc")]
    consistent = (distinct[0] == F.size("values")) & (distinct[1] == F.size("values"))
    kept = passages.where(F.col("exact") | consistent)
    # Of several passages the exact ones, then the one with most windows, counts.
    best = F.max(F.struct("exact", "n_windows", (-F.col("first_word")).alias("first")))
    return kept.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), (-F.col("best.first")).alias("first_word"),
        F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"),
    )


def hashes_of(spark: SparkSession, hashes: DataFrame):
    """A broadcast of ``exact`` and window size to sorted hashes, and flags of the low bits of all; the caller bounds their number."""
    got, out = hashes.toPandas(), {}
    flags = np.zeros(int(_LOW) + 1, dtype=bool)
    for (exact, size), group in got.groupby(["exact", "size"])["hash"]:
        known = np.sort(group.to_numpy().view(np.uint64))
        flags[(known & _LOW).astype(np.int64)] = True
        out[bool(exact), int(size)] = known, flags
    return spark.sparkContext.broadcast(out)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, block: int = BLOCK) -> DataFrame:
    """``docs`` without those that hold a benchmark passage. Rows with equal ``doc_id`` are kept or dropped together, each
    row without ``doc_id`` by its own text."""
    row, name = common.fresh(docs, "row", "found")
    own = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.col("text").cast("string"))))
    named = own.select(F.col(row).alias("doc_id"), "text")
    items = common.stored(windows(benchmark, "item_id", window, literal, True))
    totals = items.where("exact").groupBy(F.col("id").alias("item")).agg(F.count_distinct("pos").alias("total"))
    held = matched(named, items, window, literal, block).join(totals, F.col("item_id").eqNullSafe(F.col("item")), "left")
    several = (F.col("n_windows") > 1) & (2 * F.col("n_windows") > F.coalesce("total", F.lit(0)))
    held = held.where((F.col("kind") == "exact") | several | (F.col("n_windows") >= LONG))
    found = common.stored(held.select(F.col("doc_id").alias(name)).distinct())
    return own.join(found, F.col(row) == F.col(name), "left_anti").drop(row)
