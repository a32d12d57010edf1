"""The external-call operator: rows through a model, with retries, a cache, checkpoints, resumption and reruns."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import cache_key
from ..sources.shared import new_folder, written
from .backend import Backend, CallError, Retry, chat_once

RESULT = "ok boolean, value string, error_class string, error string"
#: Errors that reject a row; any other ends the job.
FAILURES: tuple[type[Exception], ...] = (AssertionError, CallError, ValueError, OSError)


MODES = ("thread", "coroutine", "serial")
#: Rows of a task whose texts and answers are held at once, if there aren't more workers; ranks that run at once.
HELD, RANKS = 256, 8


def call_rows(df: DataFrame, key: str, payload: str, function: Callable[[str], str], workers: int = 8, mode: str = "thread") -> DataFrame:
    """(key, ok, value, error_class, error): ``function`` of each row's payload, ``workers`` at a time in each task.

    ``mode`` is ``thread`` for a pool of threads, ``coroutine`` for coroutines in one loop (``function`` may be
    one; a plain function is called in a thread), or ``serial`` for one row after the other, as with one
    worker. A failure of a known class becomes a rejected row; any other ends the job.
    """
    if workers < 1:
        raise ValueError("at least one worker")
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {MODES}")
    kind = df.schema[key].dataType.simpleString()

    def one(text: str | None) -> tuple[bool, str | None, str | None, str | None]:
        try:
            return True, function(text), None, None
        except FAILURES as e:
            return False, None, type(e).__name__, str(e)

    async def all_of(texts: list) -> list:
        gate = asyncio.Semaphore(workers)

        async def one_of(text: str | None):
            async with gate:
                try:
                    got = await function(text) if asyncio.iscoroutinefunction(function) else await asyncio.to_thread(function, text)
                    return True, got, None, None
                except FAILURES as e:
                    return False, None, type(e).__name__, str(e)

        return list(await asyncio.gather(*map(one_of, texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool, asyncio.Runner() as loop:
            for whole in batches:
                # a part at a time: texts, answers and coroutines of a whole batch would be held at once
                for batch in (whole.slice(at, max(HELD, workers)) for at in range(0, len(whole), max(HELD, workers))):
                    texts = batch.column(1).to_pylist()
                    if mode == "coroutine":
                        rows = loop.run(all_of(texts))
                    else:
                        rows = list(pool.map(one, texts)) if workers > 1 and mode == "thread" else [one(t) for t in texts]
                    ok, value, name, error = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_()), pa.array(value, pa.string()), pa.array(name, pa.string()), pa.array(error, pa.string())], [key, "ok", "value", "error_class", "error"])

    return df.select(key, payload).mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def chat_payload(messages: str = "messages"):
    """A column of messages as the JSON that :func:`chat_function` reads."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def chat_function(backend: Backend, params: Mapping[str, Any] | None = None, retry: Retry = Retry()) -> Callable[[str], str]:
    """A function from messages in JSON to the model's answer."""
    own = dict(params or {})
    return lambda text: chat_once(backend, json.loads(text), own, retry)


class Cache:
    """Values by key as Parquet: found before calling, added after; successes only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], "cache_key string, value string")
        return self.spark.read.schema("cache_key string, value string").parquet(self.path).dropDuplicates(["cache_key"])

    def add(self, rows: DataFrame) -> None:
        rows.select("cache_key", "value").write.mode("append").parquet(self.path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cached_calls(df: DataFrame, key: str, payload: str, function: Callable[[str], str], cache: Cache, name: str, version: str = "1", workers: int = 8, mode: str = "thread") -> DataFrame:
    """As :func:`call_rows`, but what the cache has isn't called, equal payloads are called once, and successes are added."""
    keyed = df.select(key, payload).withColumn("cache_key", cache_key(name, version, F.col(payload)))
    known = cache.read()
    wanted = keyed.join(known, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    # once, to a folder of this call: the results are read twice below, and what the cache had is kept with them
    fresh = written(call_rows(wanted.select("cache_key", payload), "cache_key", payload, function, workers, mode), "calls")
    known = written(known.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi"), "known")
    cache.add(fresh.where("ok"))
    old = known.select("cache_key", F.lit(True).alias("ok"), "value", F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error"))
    return keyed.select(key, "cache_key").join(old.unionByName(fresh), "cache_key").drop("cache_key")


def run_checkpointed(df: DataFrame, key: str, payload: str, function: Callable[[str], str], folder: str, every: int | None = None, resume: bool = False, reruns: int = 0, workers: int = 8, mode: str = "thread") -> DataFrame:
    """(key, ok, value, error_class, error, attempt) of all rows, written rank by rank so that a run can be taken up again.

    Rows go in order of key, ``every`` to a rank (all in one by default), and up to RANKS ranks at once; each is a Parquet
    folder under ``folder/ranks``, complete when it has its success mark. With ``resume`` rows that a complete
    rank has, rejected ones too, aren't called again; otherwise this run's own folder is emptied. Rejected
    rows are called again up to ``reruns`` times, or until none is left if negative; a row's last attempt counts.
    """
    spark = df.sparkSession
    ranks = f"{folder.rstrip('/')}/ranks"
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {RESULT}, attempt int"
    if not resume and _exists(spark, ranks):
        _delete(spark, ranks)

    def done() -> DataFrame:
        if not _exists(spark, ranks):
            return spark.createDataFrame([], schema)
        paths = [p for p in _list(spark, ranks) if _exists(spark, f"{p}/_SUCCESS")]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def call(rows: DataFrame, attempt: int) -> None:
        todo = rows.select(key, payload)
        parts = 1
        if every is not None:
            from ..operators.dataset import number_rows

            # rows are numbered and written by rank once; a rank then reads its own folder only
            numbered = number_rows(todo, key, name="_k").withColumn("_rank", F.floor(F.col("_k") / every).cast("int"))
            path = new_folder(spark, "ranks")
            numbered.write.partitionBy("_rank").parquet(path)
            todo = spark.read.schema(numbered.schema).parquet(path)
            parts = todo.agg(F.coalesce(F.max("_rank") + 1, F.lit(0))).first()[0]
        at = 1 + max((int(p.rsplit("/", 1)[-1]) for p in _list(spark, ranks)), default=-1) if _exists(spark, ranks) else 0

        def one(k: int) -> None:
            part = todo.where(F.col("_rank") == k) if every is not None else todo
            call_rows(part, key, payload, function, workers, mode).withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(f"{ranks}/{at + k:06d}")

        # a rank is a small job that waits more than it works, so several run at once; after a failure none begins
        with ThreadPoolExecutor(RANKS) as pool:
            jobs = [pool.submit(one, k) for k in range(parts)]
            try:
                for job in jobs:
                    job.result()
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise

    call(df.join(done().select(key).distinct(), key, "left_anti") if resume else df, 0)
    attempt = 0
    while reruns < 0 or attempt < reruns:
        last = latest(done(), key)
        failed = last.where("not ok").select(key)
        if failed.isEmpty():
            break
        attempt += 1
        call(df.join(failed, key, "left_semi"), attempt)
    return latest(done(), key)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Each row's last attempt."""
    newest = rows.groupBy(key).agg(F.max("attempt").alias("attempt"))
    return rows.join(newest, [key, "attempt"]).dropDuplicates([key])


def _list(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory())


@dataclass(frozen=True)
class Calls:
    """How a task calls its model: workers and mode in each task, a cache, and a folder of ranks of ``every`` rows from which a run can be resumed."""

    workers: int = 8
    mode: str = "thread"
    retry: Retry = Retry()
    cache: str | None = None
    folder: str | None = None
    every: int | None = None
    resume: bool = False
    reruns: int = 0

    def run(self, df: DataFrame, key: str, payload: str, function: Callable[[str], str], name: str, version: str = "1") -> DataFrame:
        """(key, ok, value, error_class, error) for each row of ``df``, called once and written: what reads it, however often, calls nothing.

        Keys are unique. ``name`` and ``version`` tell steps of a task apart in cache and folder.
        """
        if self.folder:
            got = run_checkpointed(df, key, payload, function, f"{self.folder.rstrip('/')}/{name}", self.every, self.resume, self.reruns, self.workers, self.mode).drop("attempt")
        elif self.cache:
            got = cached_calls(df, key, payload, function, Cache(df.sparkSession, self.cache), name, version, self.workers, self.mode)
        else:
            got = call_rows(df, key, payload, function, self.workers, self.mode)
        got = written(got, "answers")
        tried = 0
        while not self.folder and (self.reruns < 0 or tried < self.reruns):
            tried += 1
            failed = got.where("not ok").select(key)
            if failed.isEmpty():
                break
            again = call_rows(df.join(failed, key, "left_semi"), key, payload, function, self.workers, self.mode)
            got = written(got.where("ok").unionByName(again), "answers")
        return got

def embed(df: DataFrame, text: str, function: Callable[[Sequence[str]], Sequence[Sequence[float]]], name: str = "embedding", batch: int = 12) -> DataFrame:
    """``df`` with an embedding of each text, ``batch`` texts at a time; null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.dropna()
        out: list = []
        for k in range(0, len(some), batch):
            out += [list(map(float, v)) for v in function(some.iloc[k : k + batch].tolist())]
        filled = dict(zip(some.index, out))
        return pd.Series([filled.get(k) for k in texts.index], index=texts.index, dtype=object)

    return df.withColumn(name, run(F.col(text)))


def embed_stored(df: DataFrame, text: str, function: Callable[[Sequence[str]], Sequence[Sequence[float]]], folder: str, model: str, name: str = "embedding", batch: int = 12) -> DataFrame:
    """As :func:`embed`, but a text whose embedding by ``model`` is in ``folder`` isn't embedded again; new ones are added there, each text once."""
    spark = df.sparkSession
    kind = "cache_key string, value array<float>"
    keyed = df.withColumn("_key", cache_key(model, "embedding", F.col(text)))
    old = spark.read.schema(kind).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], kind)
    wanted = keyed.where(F.col(text).isNotNull()).select(F.col("_key").alias("cache_key"), F.col(text).alias("_text")).dropDuplicates(["cache_key"])
    fresh = written(embed(wanted.join(old, "cache_key", "left_anti"), "_text", function, "value", batch).select("cache_key", "value"), "embeddings")
    known = written(old.join(wanted.select("cache_key"), "cache_key", "left_semi").dropDuplicates(["cache_key"]), "known")
    fresh.write.mode("append").parquet(folder)
    every = known.unionByName(fresh)
    return keyed.join(every.select(F.col("cache_key").alias("_key"), F.col("value").alias(name)), "_key", "left").drop("_key")
