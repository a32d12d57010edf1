"""Statistics over samples and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import messages as M
from .dedup import ROWS, best_scores, score_moments

BINS = tuple(1024 * 2**k for k in range(8))
THRESHOLDS = tuple(k / 10 for k in range(10))


def threshold_sweep(source: DataFrame, reference: DataFrame | None = None, thresholds: Sequence[float] = THRESHOLDS, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(threshold, rows, percent): how many rows have any score above each threshold, from one pass over each row's best score."""
    best = best_scores(source, reference, key, vector)
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    per = best.select("best", steps.alias("threshold")).groupBy("threshold").agg(F.count_if(F.coalesce(F.col("best") > F.col("threshold"), F.lit(False))).alias("rows"), F.count(F.lit(1)).alias("n"))
    return per.select("threshold", "rows", F.round(F.try_divide(F.col("rows") * 100.0, "n"), 6).alias("percent"))


def score_stats(source: DataFrame, reference: DataFrame | None = None, key: str = "id", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(pairs, mean, std, max, min) over all pairs of rows, those of a row with itself counting as 0; rounded to 9 places."""
    s = score_moments(source, reference, key, vector, rows).select("n", F.col("total").alias("t"), F.col("squares").alias("q"), F.col("high").alias("h"), F.col("low").alias("l"))
    mean = F.try_divide("t", "n")
    std = F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0)))
    return s.select(F.col("n").cast("long").alias("pairs"), F.round(mean, 9).alias("mean"), F.round(std, 9).alias("std"), F.round("h", 9).alias("max"), F.round("l", 9).alias("min"))


def bin_of(value: Column, bins: Sequence[int]) -> Column:
    """The least bound that the value doesn't exceed; null above all."""
    out = F.lit(None).cast("long")
    for b in sorted(bins, reverse=True):
        out = F.when(value <= b, F.lit(b).cast("long")).otherwise(out)
    return out


def length_histogram(df: DataFrame, text: Column, bins: Sequence[int] = BINS, length=F.length) -> DataFrame:
    """(bin, n) of texts by length; ``length`` may count tokens instead."""
    return df.select(bin_of(length(text), bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def rounds_histogram(samples: DataFrame, bins: Sequence[int] | None = None) -> DataFrame:
    """(rounds, n): samples by number of human turns, in bins if given."""
    rounds = M.count_role(F.col("messages"), "user").cast("long")
    return samples.select((bin_of(rounds, bins) if bins else rounds).alias("rounds")).groupBy("rounds").agg(F.count(F.lit(1)).alias("n"))


def role_counts(samples: DataFrame) -> DataFrame:
    """(id, system, user, assistant, kinds): messages of each role in each sample."""
    m = F.col("messages")
    return samples.select("id", *[M.count_role(m, r).cast("long").alias(r) for r in ("system", "user", "assistant")], F.size(F.array_distinct(M.roles(m))).cast("long").alias("kinds"))


def agreement(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """(key, agreed): the vote of keys whose voters all say the same; others go."""
    return votes.groupBy(key).agg(F.min(vote).alias("agreed"), F.count_distinct(vote).alias("_n"), F.count_if(F.col(vote).isNull()).alias("_none")).where("_n = 1 and _none = 0").drop("_n", "_none")


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame, and an observation that has its row count after the first action, without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


METRICS: dict = {}


def metric(name: str):
    """Registers an aggregate: a function from a frame to a frame of one row."""

    def add(function):
        METRICS[name] = function
        return function

    return add


@metric("tokens")
def _token_metric(df: DataFrame) -> DataFrame:
    from ..functions.tokens import approximate_tokens

    return df.agg(F.sum(approximate_tokens(F.col("text"))).alias("tokens"))


def reduce_dimensions(df: DataFrame, k: int, vector: str = "embedding", method: str = "pca") -> DataFrame:
    """``df`` with ``reduced``: the first ``k`` principal components (pca), or the same without centring (svd)."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if method == "pca":
        own = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
        model = PCA(k=k, inputCol="_v", outputCol="_p").fit(own)
        return model.transform(own).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")
    if method != "svd":
        raise ValueError(f"neither pca nor svd: {method}")
    # d x d sums of products, whatever the number of rows
    pairs = df.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v")).groupBy("i").agg(*[F.array(*[F.sum(F.col("x").cast("double") * F.get("v", F.lit(j))) for j in range(len(df.select(vector).first()[0]))]).alias("row")])
    gram = np.array([r["row"] for r in pairs.orderBy("i").collect()])
    values, axes = np.linalg.eigh(gram)
    top = axes[:, np.argsort(-values)[:k]].T
    return df.withColumn("reduced", F.array(*[F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(c)) for c in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in top]))
