"""Samples of an exact size, and splits."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import number_rows, order_key, select_by_ids

#: Rows of a sample that one task may bring together.
FEW = 10_000


def sample(df: DataFrame, num: int | None = None, ratio: float | None = None, seed: int = 42, key: str = "id", parity: bool = False) -> DataFrame:
    """Exactly ``num`` rows, or ``int(n * ratio)``, without replacement, in pseudo-random order.

    The rows are those of least hash of seed and id: of few one top-k, no shuffle of the rest; of more the
    keys alone are sorted and numbered, and rows up to the last wanted are sorted. ``parity`` draws as
    Python's generator does, over all ids on the driver, for small sets only.
    """
    if (num is None) == (ratio is None):
        raise ValueError("give either num or ratio")
    n = df.count()
    k = int(n * ratio) if num is None else num
    if not 0 <= k <= n:
        raise ValueError(f"{k} of {n} rows")
    if parity:
        ids = [r[0] for r in df.select(key).orderBy("pos" if "pos" in df.columns else key).collect()]
        return select_by_ids(df, random.Random(seed).sample(ids, k), key)
    order = [order_key(F.col(key), seed), F.col(key)]
    if k <= FEW:
        return df.orderBy(*order).limit(k)
    # a limit behind a sort would bring all k rows to one task
    # the k-th key bounds the rows: they are filtered where they lie, and of equal keys as many taken as are wanted
    numbered = number_rows(df.select(F.col(key).alias("_key")), order_key(F.col("_key"), seed), F.col("_key"), name="_k")
    last = numbered.where(F.col("_k") == k - 1).first()["_key"]
    less = numbered.where(F.col("_key").eqNullSafe(F.lit(last))).agg(F.min("_k")).first()[0]
    before = F.struct(*order) < F.struct(order_key(F.lit(last), seed), F.lit(last).cast(df.schema[key].dataType))
    rows = df.where(before).unionByName(df.where(F.col(key).eqNullSafe(F.lit(last))).limit(k - less))
    return rows.orderBy(*order)


def dry_run(df: DataFrame, n: int = 16, seed: int = 42, key: str = "id") -> DataFrame:
    """A few rows to try a task on: a pseudo-random ``n``, or all if there are fewer."""
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)


def part_bounds(n: int, ratios: Sequence[float]) -> list[tuple[int, int]]:
    """Positions at which parts begin and end: ``int(n * share)`` rows each, and the rest to the last."""
    total = sum(ratios)
    if not ratios or total <= 0 or min(ratios) < 0:
        raise ValueError(f"not ratios: {ratios}")
    out, at = [], 0
    for k, r in enumerate(ratios):
        to = n if k == len(ratios) - 1 else at + int(n * (r / total))
        out.append((at, to))
        at = to
    return out


def with_part(df: DataFrame, ratios: Sequence[float], randomly: bool = False, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows with the number of their part, from 0, by order of id, or pseudo-random: one sort for all parts."""
    order = [order_key(F.col(key), seed), F.col(key)] if randomly else [F.col("pos") if "pos" in df.columns else F.col(key)]
    bounds = part_bounds(df.count(), ratios)
    numbered = number_rows(df, *order, name="_k")
    part = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        part = F.when(F.col("_k") < bounds[k][1], k).otherwise(part)
    return numbered.withColumn("part", part.cast("int")).drop("_k")


def split(df: DataFrame, ratios: Sequence[float], randomly: bool = False, seed: int = 42, key: str = "id") -> list[DataFrame]:
    """The parts as frames; write :func:`with_part` partitioned by ``part`` to compute all at once."""
    whole = with_part(df, ratios, randomly, seed, key)
    return [whole.where(F.col("part") == k).drop("part") for k in range(len(ratios))]
