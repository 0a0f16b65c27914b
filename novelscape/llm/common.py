"""What the operators share: scratch tables, documents, words of Arrow text columns, state of a Python worker."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelscape.session import shuffles_dropped

#: Fixed value: what separates words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a line break among the words of ``words(..., lines=True)``.
LINE = "\x1e"
#: Bytes of text that are split into words at once; a longer text is a slice by itself.
SLICE = 4 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; without that setting a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="novelscape-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; cuts the lineage, and its shuffles are deleted."""
    spark = df.sparkSession
    path = path or scratch(spark)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tasks(spark: SparkSession, weight: float, per_task: float) -> int:
    """Partitions for ``weight`` at ``per_task`` each; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-weight // per_task)))


def hash_sample(df: DataFrame, bound: int, key: str, *ties: Column | str) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hashes of ``key``; for fitting models only.

    Rows above the hash below which ``bound`` rows are all but sure to lie are left out first, so that tasks do not
    send ``bound`` rows each.
    """
    n, order = df.count(), F.xxhash64(key)
    share = min(1.0, (bound + 8 * bound**0.5 + 8) / max(n, 1))
    some = df.where(order <= min(2**63 - 1, int(share * 2.0**64) - 2**63)) if share < 1 else df
    return some.orderBy(order, *ties).limit(bound)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a number written as text, modulo ``n``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def worker_state(name: str) -> types.SimpleNamespace:
    """An object that stays with a Python worker from task to task."""
    home = sys.modules.setdefault("novelscape_llm_worker", types.ModuleType("novelscape_llm_worker"))
    if not hasattr(home, name):
        setattr(home, name, types.SimpleNamespace())
    return getattr(home, name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def slices(text: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    if not len(sizes):
        return []
    out, low, weight = [], 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > low and weight + size > most:
            out.append((low, row))
            low, weight = row, 0
        weight += size
    return [*out, (low, len(sizes))]


def words(text: pa.Array, lower: bool = False, lines: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Blank-separated words of texts: codes, the distinct words, and each text's first place among the codes.

    Null is an empty text. ``lower`` maps A-Z only. With ``lines`` a line break is the word ``LINE``.
    """
    # What the last slice took goes back first; it would stay with the worker.
    pa.default_memory_pool().release_unused()
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    if lines:
        text = pc.replace_substring(text, "\n", f" {LINE} ")
    parts = pc.ascii_split_whitespace(text)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, distinct = np.asarray(coded.indices), coded.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, distinct, offsets


def bitmap(df: DataFrame, place: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """``2 ** bits`` bits as bytes, with those set that ``place`` gives for the rows; of that size however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits - 3, dtype=np.uint8)
        for batch in batches:
            at = place(batch)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = own.view(np.int64)
        seen = np.flatnonzero(words)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(words[seen], pa.int64())], names=["at", "bits"])

    got = df.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, dtype=np.int64)
    out[np.asarray(got.column("at"), dtype=np.int64)] = np.asarray(got.column("bits"), dtype=np.int64)
    return out.view(np.uint8)


def in_bitmap(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    return own[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run ``offsets[i]:offsets[i + 1]``; 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
