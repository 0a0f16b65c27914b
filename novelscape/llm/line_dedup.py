"""Operator 2: drop lines that an earlier document has, as keep bitmaps of each document. DataFrame functions only.

A line's key is the line without blanks at both ends, A-Z lower-cased. Hashes of keys (128 bits) are dealt by range and
sorted by document and position, so that the first row of each hash is its first occurrence; all rows of later
documents are dropped. The result is a compressed keep bitmap for each document that loses lines: run lengths of kept
and dropped lines in turn, beginning with kept ones. A hash with so many rows that one task would be uneven is not
dealt by range: the smallest document of each such hash is aggregated, and their bounded list is broadcast.

A null or empty text is one empty line. Rows with equal ``doc_id`` are one document as to where a line is first, and
keep their own texts; a null ``doc_id`` comes before all others. Keys below ``least`` code points are kept. Further
columns pass through untouched, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelscape.llm import common

LEAST = 10
#: A hash is dealt by itself if it fills more than this share of an average task.
HOT_SHARE = 0.25
#: Sampled rows for each task when hot hashes are looked for; the sample decides only where rows go.
SAMPLED = 400
#: Letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    bare = F.trim(line, F.lit(common.BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, ident: str, text: str, least: int) -> DataFrame:
    """``doc, same, pos, h1, h2`` of each line whose key is long enough; ``same`` tells apart rows of one document."""
    lines = docs.select(
        F.col(ident).alias("doc"),
        F.xxhash64(text).alias("same"),
        F.posexplode(split_lines(F.col(text))).alias("pos", "line"),
    )
    keys = lines.select("doc", "same", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keys.select("doc", "same", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc, same, n_dropped, keep_runs`` of each document row that loses lines."""
    spark = docs.sparkSession
    lines = common.stored(hashed_lines(docs, ident, text, least))
    total = lines.count()
    n = common.tasks(spark, total, 500_000)
    share = min(1.0, SAMPLED * n / max(total, 1))
    sample = lines.sample(fraction=share, seed=1).groupBy("h1", "h2").count()
    # At most n / HOT_SHARE hashes.
    hot = sample.where(F.col("count") > max(8.0, HOT_SHARE * share * total / n)).select("h1", "h2")
    hot = common.stored(hot)
    first = lines.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(first_document("doc").alias("first"))
    first = common.stored(first)
    alone = lines.join(F.broadcast(first), ["h1", "h2"]).select("doc", "same", "pos", F.struct(F.col("first.doc").alias("doc")).alias("first"))
    dealt = lines.join(F.broadcast(first), ["h1", "h2"], "left_anti").repartitionByRange(n, "h1", "h2")
    along = Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_first(), "pos")
    streamed = dealt.select("doc", "same", "pos", F.struct(F.first("doc").over(along).alias("doc")).alias("first"))
    late = alone.union(streamed).where(~F.col("doc").eqNullSafe(F.col("first.doc")))
    dropped = late.groupBy("doc", "same").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return dropped.select("doc", "same", F.size("at").cast("long").alias("n_dropped"), runs(F.col("at")).alias("keep_runs"))


def first_document(doc: str) -> Column:
    """The smallest document, null before all, as a struct."""
    return F.min(F.struct(F.col(doc).isNotNull().alias("real"), F.col(doc).alias("doc")))


def runs(at: Column) -> Column:
    """Sorted dropped positions as lengths of kept and dropped runs in turn; lines after the last run are kept."""
    step = F.transform(at, lambda p, i: F.when(i == 0, p).otherwise(p - F.element_at(at, F.greatest(i, F.lit(1))) - 1))
    first = F.filter(F.transform(step, lambda gap, i: F.struct(gap.alias("gap"), i.alias("i"))), lambda s: (s.gap > 0) | (s.i == 0))
    ends = F.concat(F.slice(F.transform(first, lambda s: s.i), 2, F.size(first)), F.array(F.size(at)))
    return F.flatten(F.transform(first, lambda s, k: F.array(s.gap, F.element_at(ends, k + 1) - s.i)))


def dropped_by(keep_runs: Column, n_lines: Column) -> Column:
    """For each line whether its bitmap drops it."""
    filled = F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 1, n))
    mask = F.flatten(F.coalesce(filled, F.array().cast("array<array<boolean>>")))
    return F.concat(mask, F.array_repeat(F.lit(False), F.greatest(n_lines - F.size(mask), F.lit(0))))


def with_kept_text(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` and, as the last three, its number of lines, of dropped lines, and its text without these.

    They are named ``n_lines, n_dropped, kept``, with underscores in front if ``docs`` has such columns.
    """
    row, n_lines, n_dropped, kept = common.fresh(docs, "row", "n_lines", "n_dropped", "kept")
    maps = keep_bitmaps(docs, ident, text, least).select(F.struct("doc", "same").alias("found"), F.col("n_dropped").alias("n"), F.col("keep_runs").alias("runs"))
    own = docs.withColumn(row, F.struct(F.col(ident).alias("doc"), F.xxhash64(text).alias("same")))
    same = F.col(f"l.{row}.doc").eqNullSafe(F.col("r.found.doc")) & (F.col(f"l.{row}.same") == F.col("r.found.same"))
    joined = own.alias("l").join(maps.alias("r").hint("shuffle_hash"), same, "left")
    lines = split_lines(F.col(f"l.`{text}`"))
    drops = dropped_by(F.col("r.runs"), F.size(lines))
    left = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), drops.alias("out")), lambda z: ~z.out), lambda z: z.line), "\n")
    return joined.select(
        *[F.col(f"l.`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce("r.n", F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col("r.n").isNull(), F.coalesce(F.col(f"l.`{text}`"), F.lit(""))).otherwise(left).alias(kept),
    )


def deduplicated(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; a null text stays null."""
    cleaned = with_kept_text(docs, ident, text, least)
    *_, n_dropped, kept = cleaned.columns
    changed = F.when(F.col(n_dropped) > 0, F.col(kept)).otherwise(F.col(text))
    return cleaned.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
