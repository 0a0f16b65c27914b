"""Hash buckets that agree with ``int(md5_hex, 16) % width``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from novelscape.config import HASH_WIDTH


def bucket(token: Column, width: int = HASH_WIDTH) -> Column:
    """The bucket of a string in ``[0, width)``.

    If ``width`` is a power of two up to 2**32, the last eight hex digits decide it;
    else the digest is folded, eight digits at a time.
    """
    digest = F.md5(token)
    if 2**32 % width == 0:
        return (F.conv(F.substring(digest, 25, 8), 16, 10).cast("long") % width).cast("int")
    shift = 2**32 % width
    folded = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        part = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        folded = (folded * shift + part) % width
    return folded.cast("int")


def unigram_bucket(token: Column, width: int = HASH_WIDTH) -> Column:
    return bucket(F.concat(F.lit("uni::"), token), width)


def bigram_bucket(token: Column, following: Column, width: int = HASH_WIDTH) -> Column:
    return bucket(F.concat(F.lit("bi::"), token, F.lit("::"), following), width)


def shuffle_key(seed: int | str, ident: Column) -> Column:
    """A reproducible random order: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))
