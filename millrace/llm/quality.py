"""Quality rules: hashed n-gram logistic regression, calibrated, scored in Arrow batches.

Features are hashed words, pairs of words in a row, and character n-grams of the text as it is (upper case and marks tell much
about quality), each kind averaged over the document. The model is fitted on a bounded sample of the
labelled rows; everything else covers all documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import blocks, document_sums, release, shingles, word_hashes

BITS = 18
GRAMS = (3, 5)
SAMPLE = 8000
#: Added to the number of features of a kind, so that a few words don't weigh like many.
SMOOTH = 80
KEEP, HIGH = 0.5, 0.9
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 3624381081], np.uint32)


@dataclass(frozen=True)
class QualityModel:
    """A row of weights for each kind of feature, a bias, and the calibration of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def indices(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, for pairs of words, and for each length of character n-grams: hashed features, and bounds by document. A document of one word has it as its only pair."""
    h, bounds = word_hashes(data, offsets)
    yield (h >> np.uint64(64 - bits)).astype(np.int64), bounds
    pairs, of_pairs = shingles(h, bounds, 2)
    yield (pairs >> np.uint64(64 - bits)).astype(np.int64), of_pairs
    d = data.astype(np.uint32) + np.uint32(1)
    for n in GRAMS:
        m = max(len(d) - n + 1, 0)
        g = np.full(m, n, np.uint32)
        for j in range(n):
            g = (g ^ d[j : j + m]) * _FACTORS[j]
            g ^= g >> np.uint32(15)
        # an n-gram belongs to the document in which it starts, unless it runs beyond it
        count = np.maximum(np.diff(offsets) - n + 1, 0)
        new = np.concatenate([[0], np.cumsum(count)])
        take = np.ones(m, bool)
        ends = offsets[1:]
        for k in range(1, n):
            at = ends - k
            at = at[(at >= 0) & (at < m)]
            take[at] = False
        yield (g[take] >> np.uint32(32 - bits)).astype(np.int64), new


def margins(texts, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """The model's margin of each text, and whether it has any feature."""
    out, some = [], []
    for _, _, data, offsets in blocks(texts, lower=False):
        total, any_ = np.full(len(offsets) - 1, model.bias), np.zeros(len(offsets) - 1, bool)
        for w, (index, bounds) in zip(model.weights, indices(data, offsets, model.weights.shape[1].bit_length() - 1)):
            count = np.diff(bounds)
            total += document_sums(w[index], bounds) / (count + SMOOTH)
            any_ |= count > 0
        out.append(total)
        some.append(any_)
    return (np.concatenate(out), np.concatenate(some)) if out else (np.zeros(0), np.zeros(0, bool))


def train(texts: pa.Array, good: np.ndarray, bits: int = BITS, epochs: int = 12, seed: int = 7) -> QualityModel:
    """Fits the regression by mini-batches, each weight at a rate of its own (AdaGrad), on three quarters of the rows and calibrates its margin on the rest.

    Rows come in a fixed order, so the same rows give the same model. No rows, or rows of one class
    only, give a constant model of the smoothed share of good rows.
    """
    good = np.asarray(good, float)
    kinds = 2 + len(GRAMS)
    weights = np.zeros((kinds, 1 << bits), np.float32)
    if len(good) < 8 or good.min() == good.max():
        p = (good.sum() + 1) / (len(good) + 2)
        return QualityModel(weights, 0.0, 1.0, float(np.log(p / (1 - p))))
    # by blocks of documents: features of all kinds, how often each occurs, bounds; and the totals by kind
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    of: list[tuple[int, int]] = []
    totals = np.zeros((len(good), kinds), np.float32)
    for at, to, data, offsets in blocks(texts, lower=False):
        per = list(indices(data, offsets, bits))
        index, many, ends = [], [], [0]
        for d in range(to - at):
            for k, (all_, bounds) in enumerate(per):
                value, count = np.unique(all_[bounds[d] : bounds[d + 1]], return_counts=True)
                totals[at + d, k] = count.sum()
                index.append((value + (k << bits)).astype(np.int32))
                many.append(count.astype(np.uint32))
            ends.append(ends[-1] + sum(map(len, index[-kinds:])))
            of.append((len(held), d))
        held.append((np.concatenate(index), np.concatenate(many), np.array(ends)))

    def row(d: int) -> tuple[np.ndarray, np.ndarray]:
        block, k = of[d]
        index, many, ends = held[block]
        own = slice(ends[k], ends[k + 1])
        return index[own], many[own].astype(np.float32) / (totals[d] + SMOOTH)[index[own] >> bits]

    part = np.arange(len(good)) % 4
    fit, hold = np.flatnonzero(part != 3), np.flatnonzero(part == 3)
    share = good[fit].mean()
    w, bias = np.zeros(kinds << bits, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    g2 = np.full(kinds << bits, 1e-8, np.float32)
    b2 = 1e-8
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 3.0 / (1 + epoch) ** 0.5
        order = rng.permutation(fit)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            got = [row(d) for d in batch]
            index = np.concatenate([i for i, _ in got])
            value = np.concatenate([v for _, v in got])
            own = np.repeat(np.arange(len(batch)), [len(i) for i, _ in got])
            m = bias + np.bincount(own, w[index] * value, len(batch))
            e = (1 / (1 + np.exp(-np.clip(m, -40, 40))) - good[batch]) / len(batch)
            seen, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, value * e[own], len(seen)).astype(np.float32) + np.float32(1e-7) * w[seen]
            g2[seen] += g * g
            w[seen] -= np.float32(rate) * g / np.sqrt(g2[seen])
            b2 += e.sum() ** 2
            bias -= 0.1 * e.sum() / b2**0.5
    model = QualityModel(w.reshape(kinds, 1 << bits), float(bias), 1.0, 0.0)
    m = np.array([bias + float((w[i] * v).sum()) for i, v in map(row, hold)])
    slope, offset = platt(m, good[hold])
    return QualityModel(model.weights, model.bias, slope, offset)


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that maps held-out margins to probabilities, with smoothed targets."""
    p, n = good.sum(), len(good) - good.sum()
    if not p or not n:
        return 1.0, 0.0
    t = np.where(good > 0, (p + 1) / (p + 2), 1 / (n + 2))
    scale = max(float(np.abs(margin).std() + np.abs(margin).mean()), 1e-6)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta -= np.clip(np.linalg.solve(h, x.T @ (q - t)), -4, 4)
    return float(max(theta[0], 1e-3) / scale), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from at most ``sample`` labelled rows, those of least hash of doc_id; rows without id, text or label don't count."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers are broadcast
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(F.broadcast(own), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def fit(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5555), kind="stable")
        model = train(table.column("text").combine_chunks().take(pa.array(order)), table.column("quality").to_numpy()[order])
        release()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # the bounded sample is one group, fitted in a task, so that only the weights come to the driver
    fitted = once.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "model binary").collect()
    return pickle.loads(bytes(fitted[0]["model"])) if fitted else train(pa.array([], pa.string()), np.zeros(0))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with probability and verdict in columns named as by :func:`score_names`, in Arrow batches."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m, some = margins(texts, shared.value)
        p = np.where(some, shared.value.probability(m), 0.0)
        return pa.array(np.round(p, 6))

    # nondeterministic in name only: a filter on the score isn't pushed below it, which would score twice
    return docs.withColumn(score_name(docs), score.asNondeterministic()(F.col("text").cast("string")))


def score_name(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    return "_" * (max(map(len, docs.columns)) + 1)


def keep_quality(docs: DataFrame, model: QualityModel, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose calibrated probability of good quality is ``keep`` or more; all columns stay.

    Null and empty texts have no features and a probability of 0, so they go. Nulls in other columns
    don't matter; long texts count in whole; repeated rows are judged alike; a probability equal to
    the threshold stays; no rows give no rows.
    """
    name = score_name(docs)
    return scored(docs, model).where(F.col(name) >= keep).drop(name)


def quality_verdicts(docs: DataFrame, model: QualityModel, keep: float = KEEP, high: float = HIGH) -> DataFrame:
    """(doc_id, probability, grade) of the documents that stay: grade ``high`` from ``high``, else ``medium``. See :func:`keep_quality`."""
    two = docs.select("doc_id", "text")
    name = score_name(two)
    out = scored(two, model).where(F.col(name) >= keep)
    return out.select("doc_id", F.col(name).alias("probability"), F.when(F.col(name) >= high, "high").otherwise("medium").alias("grade"))


def op9(spark, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_verdicts(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable] = {"op9_quality": op9}
SQL: dict[str, str] = {}
