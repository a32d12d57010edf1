"""Token counts."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def approximate_tokens(text: Column) -> Column:
    """Words and marks: runs of letters or digits and every other visible character, without a vocabulary."""
    return F.regexp_count(text, F.lit(r"[a-zA-Z0-9\x{80}-\x{10ffff}]+|[^a-zA-Z0-9\x{80}-\x{10ffff}\s]"))


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ids from a rank file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def count_tokens(path: str):
    """A function from a text column to its number of tokens by the rank file at ``path``, which is read on the driver and broadcast."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(read_ranks(path))
    made: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}))
        encode = made[0].encode_ordinary
        return texts.map(lambda t: len(encode(t)), na_action="ignore").astype("Int64")

    return count
