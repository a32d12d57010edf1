"""Filters before joins: bitmaps of hashed keys, of one size for any number of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 27


def flagged(rows: DataFrame, ids: DataFrame, mark: str, key: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a column ``mark`` that is true for all whose ``key`` is in ``ids`` (key), and for a few others.

    Hashed ids set bits of a bitmap of 2**bits bits, which is all that is broadcast for any corpus. Where
    ids become so many that most bits are set, most rows are marked, and what follows decides alone.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    part, bitmap = mark + "p", mark + "b"
    maps = ids.select(spot.alias("s")).groupBy((F.col("s") / 32768).cast("long").alias(part)).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(32768))).alias(bitmap))
    place = F.pmod(spot, F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = rows.withColumn(part, (spot / 32768).cast("long")).join(F.broadcast(maps), part, "left")
    hit = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(mark))


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``rows`` whose ``key`` is in ``ids`` (key), and a few others: a filter before a join."""
    return flagged(rows, ids, "_in", key).where("_in").drop("_in")
