"""Set-like operations on rows with an id and a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import messages as M
from ..sources.shared import written


def number_rows(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in the order given, without a single-task window.

    Rows are sorted by range and written with their place within their partition; the partitions' counts,
    one row each, shift the places. They are written because bounds of ranges are sampled: sorted twice,
    rows could fall into other partitions than those that were counted.
    """
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # there is one row a partition to broadcast
    return ordered.join(F.broadcast(before), "_part").withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).cast("long")).drop("_at", "_part", "_before")


def _ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids
    return df.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(ids)], f"{key} long, ord long")


def select_by_ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "id", strict: bool = True) -> DataFrame:
    """Rows of the ids asked for, in the order asked (ids with a column ``ord``, or a list); with ``strict`` a missing id raises KeyError."""
    asked = _ids(df, ids, key)
    if strict:
        missing = asked.join(df.select(key), key, "left_anti")
        if first := missing.take(1):
            raise KeyError(first[0][key])
    found = df.join(asked, key)
    return found.orderBy("ord").drop("ord") if "ord" in asked.columns else found


def exclude_by_ids(df: DataFrame, ids: DataFrame | Sequence[int], key: str = "id") -> DataFrame:
    """All other rows."""
    return df.join(_ids(df, ids, key).select(key), key, "left_anti")


def contains(df: DataFrame, ids: int | DataFrame | Sequence[int], key: str = "id") -> bool:
    """Whether all ids are there."""
    asked = _ids(df, [ids] if isinstance(ids, int) else ids, key).select(key).distinct()
    return asked.join(df.select(key), key, "left_anti").isEmpty()


def get(df: DataFrame, ids: int | Sequence[int] | slice, key: str = "id", pos: str = "pos") -> DataFrame:
    """The row of an id, rows of several, or a slice of positions."""
    if isinstance(ids, slice):
        if ids.step not in (None, 1):
            raise ValueError("slices have a step of 1")
        if (ids.start or 0) < 0 or (ids.stop or 0) < 0:
            n = df.count()
            start, stop, _ = ids.indices(n)
        else:
            start, stop = ids.start or 0, ids.stop
        return df.where((F.col(pos) >= start) & (F.lit(True) if stop is None else F.col(pos) < stop))
    return df.where(F.col(key) == ids) if isinstance(ids, int) else df.join(_ids(df, ids, key).select(key), key, "left_semi")


def upsert(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with rows of the same id replaced and new ones added."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def append(df: DataFrame, rows: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """``df`` with rows added behind, numbered on from the largest id and position."""
    last = df.agg(F.coalesce(F.max(key), F.lit(-1)).alias("i"), F.coalesce(F.max(pos), F.lit(-1)).alias("p")).first()
    new = number_rows(rows, *([pos] if pos in rows.columns else [F.lit("")]), name="_k").drop(key, pos)
    return df.unionByName(new.withColumn(key, F.col("_k") + last["i"] + 1).withColumn(pos, F.col("_k") + last["p"] + 1).drop("_k"), allowMissingColumns=True)


def order_key(id_: Column, seed: int) -> Column:
    """A pseudo-random key of an id, the same in any engine: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def shuffle(df: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows in pseudo-random order with new positions; ids travel with their rows."""
    return number_rows(df.drop("pos"), order_key(F.col(key), seed), key)


def sort(df: DataFrame, by: Column, reverse: bool = False, pos: str = "pos") -> DataFrame:
    """Rows in order of ``by``, equal ones in their old order in both directions, with new positions."""
    old = df.withColumn("_by", by).withColumnRenamed(pos, "_old")
    first = F.col("_by").desc_nulls_last() if reverse else F.col("_by").asc_nulls_first()
    return number_rows(old, first, F.col("_old"), name=pos).drop("_by", "_old")


def by_last_message(name: str = "id") -> Column:
    """The last message's extra field, as a number."""
    return F.try_element_at(M.last(F.col("messages"))["extras"], F.lit(name)).try_cast("long")


def merge(*frames: DataFrame, shuffled: bool = False, seed: int = 42) -> DataFrame:
    """All rows of frames of equal schema, ids and positions shifted."""
    from ..sources.samples import concat

    if not frames:
        raise ValueError("nothing to merge")
    out = frames[0]
    for f in frames[1:]:
        if sorted(f.columns) != sorted(out.columns):
            raise ValueError(f"columns differ: {sorted(out.columns)} and {sorted(f.columns)}")
        out = concat(out, f)
    return shuffle(out, seed) if shuffled else out


def union_ids(*frames: DataFrame, key: str = "id") -> DataFrame:
    """Ids of all frames, each once."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``a`` whose id is in ``b``."""
    return a.join(b.select(key), key, "left_semi")


def distinct_text(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One row for each text, the one of least id; rows without text all stay."""
    first = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256)).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi").unionByName(df.where(F.col(text).isNull()))
