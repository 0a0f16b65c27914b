"""Operator 13: phrase collocations, counted in tiles of pairs of frequency-ranked ids.

Words are ranked by frequency in each language. A pair is a phrase's id and the rank of the word that follows it. Its
ids are split into a tile and a place in the tile: pairs of a well-filled tile are counted by direct address (a dense
``bincount`` over the tile), those of a sparse one as sorted coordinates. Pairs that occur ``least`` times are phrases,
are ranked anew by frequency, and pair up with the next word, until phrases have ``longest`` words. A phrase of m words
can be frequent only if its first and its last m - 1 words are, so only places where both are go on to the next length.

Texts are cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at blanks and tabs; A-Z is lower-cased. Texts
are read once, into slices of words of one language: a slice's frequent places with their ids and last words. Ids reach
the slices by joins of each slice's distinct words and pairs; a bitmap of fixed size leaves out most pairs that are rare.
Tasks count many slices before they send a row for each distinct pair, so a frequent pair is one row of a task. Nothing
is capped: ids are 32 bits for words and phrases of a language.

Null and empty texts have no words. A null language is ``und``. Repeated rows count each. Further columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from novelscape.llm import common
from novelscape.operators.ordering import ordinal

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a slice, and of all slices that a task has open; bytes of text that are split into words at once.
SLICE, OPEN, TEXT = 2_500_000, 6_000_000, 2 << 20
#: Bytes of text that a task reads, so that slices fill up; fewer only if there were fewer tasks than cores.
TASK_TEXT = 72 << 20
#: Bits of a place in a tile's row, pairs counted at once, and pairs from which on a tile is dense.
SIDE, AT_ONCE, DENSE = 9, 1 << 21, 1 << 15
#: Bits of a word's rank in the code of a pair.
LOW = 31
#: Bits of the bitmap of frequent pairs, as a power of two.
MARKS = 25
#: What ends a piece, and what separates words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = bytes(2 if b in ENDS else 1 if b in GAPS else 0 for b in range(256))
_PLAIN = bytes(32 if b in ENDS + GAPS else b for b in range(256))


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def repeated(value: str, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32)))


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words, the distinct words, and places; neighbors in a piece have places one apart, others more."""
    # What the last texts took goes back first; it would stay with the worker.
    pa.default_memory_pool().release_unused()
    raw = b"\n".join(texts).lower()
    kind = np.frombuffer(raw.translate(_KIND), dtype=np.uint8)
    inside = kind == 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = pa.py_buffer(np.array([0, len(raw)], dtype=np.int64))
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(raw.translate(_PLAIN))])
    parts = pc.ascii_split_whitespace(whole).values
    coded = parts.filter(pc.not_equal(parts, "")).dictionary_encode()
    place = np.arange(len(starts), dtype=np.int32) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0, dtype=np.int32)
    return np.asarray(coded.indices, dtype=np.int32), coded.dictionary, place


class Slice:
    """Words of texts of one language: their codes and places, and the distinct words with their counts."""

    def __init__(self) -> None:
        self.texts, self.bytes, self.n, self.end = [], 0, 0, 0
        self.codes, self.places, self.words = [], [], {}

    def add(self, text: bytes) -> int:
        """How many words are new; texts wait until there are enough of them."""
        self.texts.append(text)
        self.bytes += len(text)
        return self.split() if self.bytes > TEXT else 0

    def split(self) -> int:
        codes, distinct, place = placed_words(self.texts)
        own = np.array([self.words.setdefault(w, len(self.words)) for w in distinct.to_pylist()], dtype=np.int32)
        self.codes.append(own[codes])
        self.places.append(place + self.end)
        self.end += 2 + (int(place[-1]) if len(place) else 0)
        self.n += len(codes)
        self.texts, self.bytes = [], 0
        return len(codes)

    def row(self, lang: str) -> pa.RecordBatch:
        self.split()
        codes, place = np.concatenate(self.codes), np.concatenate(self.places)
        counts = np.bincount(codes, minlength=len(self.words)).tolist()
        cells = [uuid.uuid4().hex, lang, len(codes), packed(np.diff(place, prepend=np.int32(0))), packed(codes), list(self.words), counts]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, _SLICE.values())], names=list(_SLICE))


_SLICE = {"part": pa.string(), "lang": pa.string(), "n": pa.int64(), "place": pa.binary(), "code": pa.binary(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}


def word_slices(docs: DataFrame) -> DataFrame:
    """``part, lang, n, place, code, words, counts``: one row for each slice of texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slice] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at, lang in enumerate(batch.column("lang").to_pylist()):
                if not held.setdefault(lang, Slice()).add(texts[at].as_py()):
                    continue
                for one in [lang] if held[lang].n > SLICE else list(held) if sum(x.n for x in held.values()) > OPEN else []:
                    yield held.pop(one).row(one)
        for lang, one in held.items():
            yield one.row(lang)

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    plain = plain.where(F.length("text") > 0)
    weight = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    plain = plain.coalesce(max(-(-weight // TASK_TEXT), docs.sparkSession.sparkContext.defaultParallelism))
    return plain.mapInArrow(run, "part string, lang string, n long, place binary, code binary, words array<string>, counts array<long>")


def ranked_words(slices: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, n, id`` of the frequent words."""
    each = slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.counts").alias("n"))
    counts = each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return ordinal(counts, [F.desc("n"), "phrase"], ["lang"], "id")


PLACES = "part string, lang string, place binary, id binary, last binary"


def word_places(slices: DataFrame, words: DataFrame) -> DataFrame:
    """``part, lang, place, id, last`` of each slice's frequent words; ids are their ranks, last words the same (null)."""
    bitmap = common.bitmap(words.select("phrase"), lambda batch: word_mark(batch.column("phrase").to_pylist()), MARKS)
    shared = slices.sparkSession.sparkContext.broadcast(bitmap)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lang, own in zip(*(batch.column(c) for c in ("part", "lang", "words"))):
                at = np.flatnonzero(common.in_bitmap(shared.value, word_mark(own.values.to_pylist())))
                yield pa.record_batch([repeated(part.as_py(), len(at)), repeated(lang.as_py(), len(at)), pa.array(at, pa.int32()), own.values.take(pa.array(at))], names=["of", "lang", "at", "phrase"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        out = []
        for slice_ in left.to_pylist():
            rank = np.full(slice_["kinds"], -1, dtype=np.int64)
            rank[np.asarray(right.column("at"))] = np.asarray(right.column("id"))
            ids, place = rank[unpacked(slice_["code"], "i4")], np.cumsum(unpacked(slice_["place"], "i4"), dtype=np.int32)
            out.append(places_row(slice_, place, ids, None, ids >= 0))
        return places_table(out)

    asked = slices.select("part", "lang", "words").mapInArrow(ask, "of string, lang string, at int, phrase string")
    told = asked.join(words, ["lang", "phrase"]).select("of", "at", "id")
    own = slices.select("part", "lang", "place", "code", F.size("words").alias("kinds"))
    return own.groupBy("part").cogroup(told.groupBy("of")).applyInArrow(run, PLACES)


def word_mark(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) >> 64 - MARKS for w in words], dtype=np.int64)


def places_row(slice_: dict, place: np.ndarray, ids: np.ndarray, last: np.ndarray | None, keep: np.ndarray) -> list:
    last = None if last is None else packed(last[keep].astype(np.int32))
    return [slice_["part"], slice_["lang"], packed(np.diff(place[keep], prepend=np.int32(0))), packed(ids[keep]), last]


def places_table(rows: list[list]) -> pa.Table:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "lang", "place", "id", "last"])


def pairs_of(slice_: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a slice's pairs, their places, and the ranks of their last words."""
    place, ids = np.cumsum(unpacked(slice_["place"], "i4"), dtype=np.int32), unpacked(slice_["id"], "i8")
    last = ids if slice_["last"] is None else unpacked(slice_["last"], "i4")
    follows = np.flatnonzero(np.diff(place) == 1)
    return ids[follows] << LOW | last[follows + 1], place[follows], last[follows + 1]


def tile_counts(codes: np.ndarray, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs, tile by tile."""
    upper, lower, mask = codes >> LOW, codes & ((1 << LOW) - 1), (1 << SIDE) - 1
    tile = (upper >> SIDE) << (LOW - SIDE) | lower >> SIDE
    local = ((upper & mask) << SIDE | lower & mask).astype(np.int32)
    kinds, at, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    full = sizes >= dense
    found, counts = [], []
    sparse = ~full[at]
    if sparse.any():
        own, n = np.unique(codes[sparse], return_counts=True)
        found.append(own)
        counts.append(n)
    if full.any():
        order = np.flatnonzero(~sparse)
        order = order[np.argsort(at[order], kind="stable")]
        begin = 0
        for number in np.flatnonzero(full).tolist():
            end = begin + int(sizes[number])
            n = np.bincount(local[order[begin:end]], minlength=1 << 2 * SIDE)
            seen = np.flatnonzero(n)
            row, column = int(kinds[number]) >> (LOW - SIDE), int(kinds[number]) & ((1 << (LOW - SIDE)) - 1)
            found.append((row << SIDE | seen >> SIDE) << LOW | column << SIDE | seen & mask)
            counts.append(n[seen])
            begin = end
    return (np.concatenate(found), np.concatenate(counts)) if found else (codes, codes)


def pair_counts(places: DataFrame) -> DataFrame:
    """``lang, code, n`` of all pairs."""

    def counted(lang: str, held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = tile_counts(np.concatenate(held))
        return pa.record_batch([repeated(lang, len(codes)), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                pa.default_memory_pool().release_unused()
                slice_ = batch.slice(at, 1).to_pylist()[0]
                lang, codes = slice_["lang"], pairs_of(slice_)[0]
                for begin in range(0, len(codes), AT_ONCE):
                    held.setdefault(lang, []).append(codes[begin : begin + AT_ONCE].copy())
                    sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                    for one in [lang] if sizes[lang] >= AT_ONCE else list(held) if sum(sizes.values()) > 2 * AT_ONCE else []:
                        del sizes[one]
                        yield counted(one, held.pop(one))
        for lang, codes in held.items():
            yield counted(lang, codes)

    return places.select("lang", "place", "id", "last").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def mark(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARKS)).astype(np.int64)


def phrase_places(places: DataFrame, phrases: DataFrame) -> DataFrame:
    """The places of phrases one word longer, with their new ids."""
    bitmap = common.bitmap(phrases.select("code"), lambda batch: mark(np.asarray(batch.column("code"))), MARKS)
    shared = places.sparkSession.sparkContext.broadcast(bitmap)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                slice_ = batch.slice(at, 1).to_pylist()[0]
                codes, place, last = pairs_of(slice_)
                yield from places_table([places_row(slice_, place, codes, last, common.in_bitmap(shared.value, mark(codes)))]).to_batches()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lang, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "id"))):
                codes = np.unique(unpacked(ids, "i8"))
                yield pa.record_batch([repeated(part, len(codes)), repeated(lang, len(codes)), pa.array(codes)], names=["of", "lang", "code"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        known, ids = np.asarray(right.column("code"), dtype=np.int64), np.asarray(right.column("id"), dtype=np.int64)
        order, out = np.argsort(known), []
        known, ids = known[order], ids[order]
        for slice_ in left.to_pylist():
            codes, place, last = unpacked(slice_["id"], "i8"), np.cumsum(unpacked(slice_["place"], "i4"), dtype=np.int32), unpacked(slice_["last"], "i4")
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            keep = known[at] == codes if len(known) else np.zeros(len(codes), dtype=bool)
            out.append(places_row(slice_, place, ids[at] if len(known) else codes, last, keep))
        return places_table(out)

    # Places whose pair may be frequent, with the pair's code for an id.
    some = common.stored(places.mapInArrow(reduce_, PLACES))
    asked = some.select("part", "lang", "id").mapInArrow(ask, "of string, lang string, code long")
    told = asked.join(phrases.select("lang", "code", "id"), ["lang", "code"]).select("of", "code", "id")
    return some.groupBy("part").cogroup(told.groupBy("of")).applyInArrow(run, PLACES)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """``lang, phrase, n, id`` of the frequent phrases of each length, and ``lang, n`` of all words."""
    slices = common.stored(word_slices(docs))
    words = common.stored(ranked_words(slices, least))
    levels, places = [words], None
    while len(levels) < longest:
        places = common.stored(phrase_places(places, ids) if places else word_places(slices, words))
        counts = pair_counts(places).where(F.col("n") >= least)
        ids = common.stored(ordinal(counts, [F.desc("n"), "code"], ["lang"], "id"))
        if ids.isEmpty():
            break
        head = levels[-1].select("lang", F.col("id").alias("head"), F.col("phrase").alias("first"))
        tail = words.select("lang", F.col("id").alias("tail"), F.col("phrase").alias("then"))
        both = ids.withColumn("head", F.shiftright("code", LOW)).withColumn("tail", F.col("code").bitwiseAND((1 << LOW) - 1))
        both = both.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
        levels.append(common.stored(both.select("lang", F.concat_ws(" ", "first", "then").alias("phrase"), "n", "id")))
    return levels, slices.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by the score of their weakest cut.

    A phrase that occurs only inside one longer frequent phrase is left out.
    """
    levels, totals = frequent_phrases(docs, least, longest)
    spoken = reduce(DataFrame.unionByName, [x.select("lang", "phrase", F.col("n").alias("a"), F.lit(m).alias("m")) for m, x in enumerate(levels, 1)])
    cut = F.split("phrase", " ", -1)
    found = spoken.where("m > 1").withColumn("w", cut)
    # If a phrase two words longer is as frequent, so is one that is one word longer.
    inner = F.array(F.slice("w", F.lit(1), F.col("m") - 1), F.slice("w", F.lit(2), F.col("m") - 1))
    longer = found.where("m > 2").select("lang", F.explode(F.transform(inner, lambda x: F.array_join(x, " "))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(longer, ["lang", "phrase"], "left").where("most is null or most < a").drop("most")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    left, right = F.slice("w", F.lit(1), F.col("k")), F.slice("w", F.col("k") + 1, F.col("m") - F.col("k"))
    cuts = cuts.withColumn("left", F.array_join(left, " ")).withColumn("right", F.array_join(right, " ")).drop("w", "m")
    cuts = cuts.join(spoken.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(spoken.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumn("up", F.lit(1000) * wide["a"] * wide["n"]).withColumn("down", wide["l"] * wide["r"])
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("x"))
    scored = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
