"""Language ID: mixtures of languages by expectation-maximisation, the set chosen by penalised likelihood.

Each word is a draw from one language, whose likelihood is the product of its byte n-gram
probabilities; a background without structure takes what no language explains. A document's
languages and their shares maximise the mixture's likelihood less a penalty for each language. The
likelihood is concave in the shares, so a language is tried only if its first-order gain at share 0
is positive, which settles most documents of one language without any iteration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import score_name
from .textvec import LETTERS, blocks, document_sums, word_spans

ORDER = 4
BITS = 17
SAMPLE = 400
PENALTY = 3.0
SYMBOLS = 40
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Language names; by hashed n-gram, and by hashed context, a row of logs of smoothed counts, one for each language."""

    names: tuple[str, ...]
    grams: np.ndarray
    contexts: np.ndarray


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams and contexts of words with a mark at either end, word after word, and bounds by word."""
    size = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    padded = np.append(data, np.uint8(0))
    sign = np.where(last, np.uint8(1), padded[at]).astype(np.uint32)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    context = np.full(bounds[-1], 17, np.uint32)
    for j in range(1, ORDER):
        before = np.zeros(bounds[-1], np.uint32)
        before[j:] = sign[:-j] if j else sign
        before[place < j] = 2
        context = (context ^ before) * _FACTORS[j]
        context ^= context >> np.uint32(15)
    gram = (context ^ sign) * _FACTORS[0]
    gram ^= gram >> np.uint32(13)
    return (gram * np.uint32(2246822519) >> np.uint32(32 - bits)).astype(np.int64), (context * np.uint32(3266489917) >> np.uint32(32 - bits)).astype(np.int64), bounds


def train(texts: pa.Array, langs: list[str], bits: int = BITS) -> LanguageModel:
    """Counts of n-grams and of their contexts by language, smoothed by adding constants. No labelled rows give a model of no language."""
    names = tuple(sorted(set(langs)))
    of = np.array([names.index(x) for x in langs], np.int64)
    n, m = np.zeros((1 << bits, len(names))), np.zeros((1 << bits, len(names)))
    for at, to, data, offsets in blocks(texts):
        starts, ends, bounds = word_spans(data, offsets, LETTERS)
        g, c, wb = grams(data, starts, ends, bits)
        lang = np.repeat(np.repeat(of[at:to], np.diff(bounds)), np.diff(wb))
        np.add.at(n, (g, lang), 1)
        np.add.at(m, (c, lang), 1)
    return LanguageModel(names, np.log(n + 0.5 / SYMBOLS).astype(np.float32), np.log(m + 0.5).astype(np.float32))


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from at most ``sample`` labelled documents of each language, those of least hash of doc_id; rows without id, text or lang don't count."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    own = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("doc_id").distinct()
    # ids of a bounded sample by language are broadcast
    rows = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(own), "doc_id")
    table = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.lang", "x.text").where("lang is not null").orderBy("doc_id").toArrow()
    if not len(table):
        return LanguageModel((), *[np.zeros((1 << BITS, 0), np.float32)] * 2)
    return train(table.column("text").combine_chunks(), table.column("lang").to_pylist())


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word under each language and, last, the background; bounds by document."""
    starts, ends, bounds = word_spans(data, offsets, LETTERS)
    g, c, wb = grams(data, starts, ends, len(model.grams).bit_length() - 1)
    flat = -np.log(SYMBOLS)
    if not len(g):
        return np.zeros((0, len(model.names) + 1)), bounds
    words = np.add.reduceat(model.grams[g] - model.contexts[c], wb[:-1], axis=0)
    return np.concatenate([words, ((ends - starts + 1) * flat)[:, None]], 1).astype(np.float64), bounds


def shares(p: np.ndarray, rounds: int = 60, close: float = 1e-4) -> np.ndarray:
    """Mixture shares of the columns of ``p``, likelihoods by word, by expectation-maximisation."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        total = p @ pi
        new = pi * ((1 / total) @ p) / len(p)
        if np.abs(new - pi).max() < close:
            return new
        pi = new
    return pi


def mixture(log_p: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of a document's words by language (0 for those not chosen), from words' log-likelihoods.

    Languages join one at a time, the most promising first, as long as the likelihood grows by more
    than ``penalty`` times the log of the number of words; where one's growth is too small, the others
    are tried in turn.
    """
    n, kinds = log_p.shape
    out = np.zeros(kinds)
    total = log_p.sum(0)
    chosen = [int(total.argmax())]
    cost = penalty * np.log(n + 1)
    top = log_p.max(1)
    if n == 1 or top.sum() - total[chosen[0]] <= cost:
        out[chosen[0]] = 1
        return out
    p = np.exp(log_p - top[:, None])
    best, pi = float(np.log(p[:, chosen[0]] + 1e-300).sum()), np.ones(1)
    while len(chosen) < kinds:
        inverse = 1 / np.maximum(p[:, chosen] @ pi, 1e-300)
        gain = inverse @ p / n - 1
        gain[chosen] = -1
        for k in [k for k in np.argsort(-gain, kind="stable").tolist() if gain[k] > 0]:
            more = [*chosen, k]
            q = shares(np.maximum(p[:, more], 1e-300))
            now = float(np.log(np.maximum(p[:, more] @ q, 1e-300)).sum())
            if now - best > cost:
                chosen, pi, best = more, q, now
                break
        else:
            break
    out[chosen] = pi / pi.sum()
    return out


def identify(texts, model: LanguageModel, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Shares by text (the last column is the background's) and numbers of words."""
    out, words = [], []
    for _, _, data, offsets in blocks(texts):
        log_p, bounds = word_likelihoods(data, offsets, model)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out.append(mixture(log_p[a:b], penalty) if b > a else np.zeros(len(model.names) + 1))
            words.append(b - a)
    return (np.array(out), np.array(words)) if out else (np.zeros((0, len(model.names) + 1)), np.zeros(0, np.int64))


_KIND = "lang string, languages string, share double, words long"


def identified(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with a struct (lang, languages, share, words) in a column named as by ``score_name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_KIND)
    def name(texts: pa.Array) -> pa.Array:
        found, words = identify(texts, shared.value, penalty)
        names = (*shared.value.names, "und")
        lang, several, share = [], [], []
        for exact, row, n in zip(found, np.round(found, 4), words):
            order = [k for k in np.argsort(-row, kind="stable") if exact[k] > 0]
            known = [k for k in order if k < len(names) - 1]
            und = row[-1] > 0.5 or not known
            lang.append("und" if und else names[known[0]])
            several.append(",".join(f"{names[k]}:{row[k]:.4f}" for k in order))
            share.append(float(row[order[0]]) if order else 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(several, pa.string()), pa.array(share, pa.float64()), pa.array(words, pa.int64())], ["lang", "languages", "share", "words"])

    return docs.withColumn(score_name(docs), name.asNondeterministic()(F.col("text").cast("string")))


def keep_languages(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` that are in some language of the model; all columns stay.

    A text goes if it has no word, is null or empty, or if more than half of it belongs to the
    background. Texts of several languages stay. Nulls in other columns don't matter; long texts count
    in whole; repeated rows are judged alike; no rows give no rows; equal likelihoods go to the first
    language by name.
    """
    name = score_name(docs)
    return identified(docs, model, penalty).where(F.col(f"{name}.lang") != "und").drop(name)


def languages(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang, languages, share, words) of the documents that :func:`keep_languages` keeps: main language, all with shares, the largest share."""
    two = docs.select("doc_id", "text")
    name = score_name(two)
    return identified(two, model, penalty).where(F.col(f"{name}.lang") != "und").select("doc_id", f"{name}.*")


def op10(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents that are in one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages(docs, fit_languages(docs))


QUERIES: dict[str, Callable] = {"op10_language": op10}
SQL: dict[str, str] = {}
