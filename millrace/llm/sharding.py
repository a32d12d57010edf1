"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, from two hashes of its
name: an offset and a skip. The shards take turns, each claiming the next slot of its order that is
still free, until the table is full. A key's hash picks a slot, and the slot names the shard: constant
time, shares even to within a slot or so, and few keys move when a shard comes or goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

SLOTS = 65537
SHARDS = tuple(f"shard-{k:04d}" for k in range(256))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard of each slot. Shards have different names; the order in which they are given doesn't matter for who prefers what, only for turns, so they are sorted."""
    if not is_prime(slots):
        raise ValueError(f"the table's size must be prime: {slots}")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if len(shards) > slots:
        raise ValueError("there are more shards than slots")
    order = np.argsort(np.array(shards), kind="stable")
    digest = [hashlib.sha256(shards[k].encode()).digest() for k in order]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for k in range(len(order)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = order[k]
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of its MD5, as any engine can compute it. A null key counts as an empty one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``rows`` with the slot and the shard of each, through a broadcast of the table, whose size doesn't depend on the rows.

    A null key is placed like an empty one; equal keys go to one shard; keys of any length are hashed in
    whole; no rows give no rows. All other columns stay; those that already have the new names are replaced.
    """
    spark = rows.sparkSession
    table = fill_table(shards, slots)
    names = list(shards)
    given = [c for c in rows.columns if c.lower() not in (slot_name.lower(), shard_name.lower())]
    own = "_" * (max([0, *map(len, given)]) + 1)
    lookup = spark.createDataFrame([(k, names[s]) for k, s in enumerate(table.tolist())], f"`{own}` int, `{shard_name}` string")
    placed = rows.withColumn(own + "_", slot_of(F.col(key), slots)).select(*[F.col(f"`{c}`") for c in given], F.col(own + "_").alias(slot_name))
    # the table has `slots` rows for any input
    return placed.join(F.broadcast(lookup), F.col(slot_name) == F.col(own)).select(*[F.col(f"`{c}`") for c in given], slot_name, shard_name)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document, with its text and all else, and its shard, by doc_id."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


QUERIES: dict[str, Callable] = {"op3_sharding": op3}
SQL: dict[str, str] = {}
