"""Operator 1: token ids of texts in frequency-ranked, byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over all documents, so that frequent ids take one byte. A document's
ranks are a control stream (2 bits for each: its bytes less one) and a data stream (its low bytes), as two binary
columns of a Parquet table in ascending ``doc_id`` order; a table lookup by control byte decodes four ranks at once.

Null texts are empty; each document ends with ``end``, so an empty text has one id. Equal ``doc_id``s follow each other
by number of ids and checksum; a null ``doc_id`` comes first. Columns besides ``doc_id`` and ``text`` are not read. An
empty table gives an empty file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.llm import common

END = 1
#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000
#: Latin words that are one part to a vocabulary with word ends, and such with one mark, which are two.
WORD, MARKED, SUFFIX = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]+$", "</w>"
#: Ids in one sorted file.
IDS_PER_FILE = 16_000_000


class WordEncoder:
    """Ids of blank-separated words, each encoded once; the vocabulary splits at blanks, so words stand alone."""

    def __init__(self, vocabulary: str, separator: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.separator, self.mark, self.end = separator, self.tokenizer.token_to_id(separator), end
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        self.lower = '{"type":"Lowercase"}' in json.dumps(json.loads(vocabulary)["normalizer"], separators=(",", ":"))
        self.narrow = names[-1][1] < 1 << 16
        self.ends = np.zeros(names[-1][1] + 1, dtype=bool)
        if json.loads(vocabulary)["model"].get("end_of_word_suffix") == SUFFIX:
            self.ends[[i for name, i in names if name.endswith(SUFFIX)]] = True
        else:
            self.ends = self.ends[:0]
        self.forget()

    def forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.pool = np.array([self.end], dtype=np.uint32)
        self.starts, self.lengths, self.hits = np.array([0]), np.array([1]), np.array([0])

    def thin(self) -> None:
        """Forget words that only one slice had."""
        kept = np.flatnonzero(self.hits[1:] > 1)
        if 2 * len(kept) > REMEMBERED:
            return self.forget()
        self.names = self.names.take(pa.array(kept))
        entries = np.concatenate([[0], kept + 1])
        starts, self.lengths = self.starts[entries], self.lengths[entries]
        self.pool = self.pool[common.ragged(starts, self.lengths)]
        self.starts, self.hits = np.cumsum(self.lengths) - self.lengths, np.ones(len(entries), dtype=np.int64)

    def learn(self, words: pa.Array) -> None:
        """Encode new words. Latin words, with or without a mark behind, are encoded as one text and told apart by
        the tokens that end a part; others stand between separators, and those that hold a separator alone."""
        if not len(words):
            return
        new = words.to_pylist()
        marks = np.where(np.asarray(pc.match_substring_regex(words, WORD)), 1, 0)
        marks = np.where(np.asarray(pc.match_substring_regex(words, MARKED)), 2, marks)
        flat, lengths, order = [], [], []
        simple = np.flatnonzero(marks) if len(self.ends) else marks[:0]
        for low in range(0, len(simple), 2000):
            some = simple[low : low + 2000]
            ids = np.array(self.ids(" ".join([new[i] for i in some.tolist()])), dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != marks[some].sum():
                marks[some] = 0
                continue
            flat.append(ids)
            lengths.append(np.diff(stops[np.cumsum(marks[some]) - 1], prepend=0))
            order.append(some)
        other = np.flatnonzero(marks == 0) if len(self.ends) else np.arange(len(new))
        held = np.array([self.separator in new[i] for i in other.tolist()], dtype=bool)
        for low in range(0, len(plain := other[~held]), 1000):
            some = plain[low : low + 1000]
            ids = np.array(self.ids(self.separator.join([new[i] for i in some.tolist()]) + self.separator), dtype=np.uint32)
            lengths.append(np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1)
            flat.append(ids[ids != self.mark])
            order.append(some)
        for i in other[held].tolist():
            flat.append(np.array(self.ids(new[i]), dtype=np.uint32))
            lengths.append(np.array([len(flat[-1])]))
            order.append(np.array([i]))
        order, lengths = np.concatenate(order), np.concatenate(lengths)
        self.order = order
        self.names = pa.concat_arrays([self.names, words.take(pa.array(order))])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), dtype=np.int64)])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, *flat])

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end, and the places where texts start."""
        # The vocabulary is lower case; only the marks of special tokens tell cases apart.
        lower = self.lower and not pc.any(pc.match_substring(text, "<|")).as_py()
        codes, distinct, offsets = common.words(text, lower=lower)
        if len(self.names) > REMEMBERED:
            self.thin()
        known = pc.index_in(distinct, value_set=self.names)
        place = np.asarray(pc.fill_null(known, -1), dtype=np.int64) + 1
        new, first = np.flatnonzero(place == 0), len(self.starts)
        self.learn(distinct.take(pa.array(new)))
        if len(new):
            place[new[self.order]] = np.arange(first, first + len(new))
        self.hits[place] += 1
        entries = np.insert(place[codes], offsets[1:], 0)
        lengths = self.lengths[entries]
        ids = self.pool[common.ragged(self.starts[entries], lengths)]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return ids, starts[offsets + np.arange(len(offsets))]


def encoder(spark: SparkSession, vocabulary: str, end: int = END, separator: str = "<|startoftext|>") -> Callable[[], WordEncoder]:
    """A function that gives a worker its encoder; the vocabulary file is read once, on the driver."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def get() -> WordEncoder:
        state = common.worker_state("encoders")
        key = f"{vocabulary} {end} {separator}"
        if key not in vars(state):
            setattr(state, key, WordEncoder(shared.value, separator, end))
        return getattr(state, key)

    return get


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``raw``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def raw_of(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    return np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None and len(column) else np.zeros(0, dtype=np.uint8)


def checksums(ids: np.ndarray, starts: np.ndarray) -> list[int]:
    raw, bounds = memoryview(ids.astype("<u4")).cast("B"), (4 * starts).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]


def tokenized(docs: DataFrame, get: Callable[[], WordEncoder]) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids`` of each row; ids are unsigned 16-bit integers, or 32-bit for a large vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        kind = "<u2" if own.narrow else "<u4"
        for batch in batches:
            text = batch.column("text")
            for low, high in common.slices(text):
                ids, starts = own.encode(text.slice(low, high - low))
                raw = ids.astype(kind)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(starts), pa.int64()), pa.array(checksums(ids, starts), pa.int64()), binaries(raw, starts[1:] * raw.itemsize)],
                    names=["doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """All ids of a batch of ``tokenized`` rows; a row has one at least."""
    raw, n = raw_of(batch.column("ids")), int(np.asarray(batch.column("n_tokens")).sum())
    return raw.view("<u2" if len(raw) == 2 * n else "<u4")


def frequency_ranks(ids: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id; at most as many as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            seen = np.bincount(unpacked(batch), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    counts = ids.select("ids", "n_tokens").mapInArrow(count, "id long, n long")
    ranked = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id")
    return np.array([row.id for row in ranked.collect()], dtype=np.uint32)


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of runs of ``sizes`` ranks, and where each run's end; its last control byte is filled up
    with ranks of 0."""
    wide = -(-sizes // 4) * 4
    filled = np.zeros(int(wide.sum()), dtype="<u4")
    filled[common.ragged(np.cumsum(wide) - wide, sizes)] = ranks
    more = (filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)
    quads = more.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = filled.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    before = np.concatenate([[0], np.cumsum(more + 1, dtype=np.int64)])
    ends = np.cumsum(wide)
    return control.astype(np.uint8), ends // 4, data, before[ends]


def lookup_table() -> np.ndarray:
    """For each control byte, which of the 16 bytes of four integers the data stream fills."""
    lengths = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    return (np.arange(4) <= lengths[:, :, None]).reshape(256, 16)


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ranks of all runs."""
    filled = table[control]
    out = np.zeros(filled.shape, dtype=np.uint8)
    out[filled] = data
    wide = -(-sizes // 4) * 4
    return out.reshape(-1).view("<u4")[common.ragged(np.cumsum(wide) - wide, sizes)]


def parts_of(batch: pa.RecordBatch, weight: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``weight`` ids, one row at least."""
    before = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_tokens")))])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(before, before[low] + weight, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: int = END, ids_per_file: int = IDS_PER_FILE) -> None:
    """Tokenize ``docs`` and write ``folder``: ``ids`` (the coded documents) and ``ranks`` (id of each rank)."""
    spark = docs.sparkSession
    plain = common.scratch(spark)
    tokens = common.stored(tokenized(docs, encoder(spark, vocabulary, end)), plain)
    ids = frequency_ranks(tokens)
    spark.createDataFrame([(ids.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    n = common.tasks(spark, tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0], ids_per_file)
    order = ("doc_id", "n_tokens", "ids_crc32")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for some in parts_of(batch):
                sizes = np.asarray(some.column("n_tokens"))
                control, control_ends, data, data_ends = pack(shared.value[unpacked(some)], sizes)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.record_batch(
                    [some.column("part"), some.column("doc_id"), pa.array(starts, pa.int64()), some.column("n_tokens"), binaries(control, control_ends), binaries(data, data_ends)],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "control", "data"],
                )

    rows = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = "part int, doc_id long, start_in_part long, n_tokens long, control binary, data binary"
    rows.mapInArrow(code, schema).write.option("compression", "zstd").parquet(f"{folder}/ids")
    common.drop(spark, plain)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids array<long>`` of each document in the files."""
    coded = spark.read.parquet(f"{folder}/ids")
    ids = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first().ids, dtype="<u4")
    # One row for each file, as many as there were tasks.
    sizes = {r.part: r.n for r in coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    first = np.zeros(max(sizes, default=0) + 2, dtype=np.int64)
    first[[p + 1 for p in sizes]] = list(sizes.values())
    shared = spark.sparkContext.broadcast((ids, np.cumsum(first)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, first), table = shared.value, lookup_table()
        for batch in batches:
            for some in parts_of(batch):
                size = np.asarray(some.column("n_tokens"))
                found = names[unpack(raw_of(some.column("control")), raw_of(some.column("data")), size, table)]
                starts = np.concatenate([[0], np.cumsum(size)])
                begin = first[np.asarray(some.column("part"))] + np.asarray(some.column("start_in_part"))
                out = [some.column("doc_id"), pa.array(begin, pa.int64()), some.column("n_tokens"), pa.array(checksums(found, starts), pa.int64())]
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.astype(np.int64)))] * with_ids
                yield pa.record_batch(out + lists, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return coded.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
