"""The tasks of the command line, as functions of a session and options."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .external.backend import get_backend
from .external.calls import Calls
from .functions import messages as M
from .functions.plain import log, part_name
from .operators import dataset, dedup, filters, sampling, stats, transforms
from .registry import DEDUPS, TRANSFORMS
from .sources import samples as S

TASKS: dict[str, Callable[..., Any]] = {}


def task(name: str):
    def add(function):
        TASKS[name] = function
        return function

    return add


def write(df: DataFrame, path: str) -> int:
    """By suffix: ``.json`` one array, ``.jsonl`` lines, else Parquet. The number of rows written is seen on the way."""
    if path.endswith(".json"):
        return S.write_json_array(df, path)
    df, seen = stats.counted(df)
    if path.endswith(".jsonl"):
        S.write_jsonl(df, path)
    else:
        df.write.mode("overwrite").parquet(path)
    return seen.get["n"]


def _read(spark: SparkSession, paths: Sequence[str], schema: str | None = None, *outputs: str | None) -> DataFrame:
    """The samples of ``paths``; sources and outputs are checked before anything is read."""
    S.check_paths(spark, paths, [p for p in outputs if p])
    return S.read_samples(spark, list(paths), schema)


def _calls(options: dict[str, Any]) -> Calls:
    """How to call a model, from the options of a task, which are taken out."""
    names = {"num_workers": "workers", "call_mode": "mode", "cache_dir": "cache", "checkpoint_dir": "folder", "checkpoint_interval": "every", "resume_from_checkpoint": "resume", "max_rerun_count": "reruns"}
    given = {own: options.pop(name, None) for name, own in names.items()}
    if given["resume"] and not given["folder"]:
        raise ValueError("a run is resumed from a checkpoint folder")
    return Calls(**{k: v for k, v in given.items() if v is not None})


def _renumber(df: DataFrame) -> DataFrame:
    return dataset.number_rows(df.drop("id").withColumnRenamed("pos", "_p"), "_p", name="id").withColumn("pos", F.col("id")).drop("_p")


@task("merge")
def merge(spark: SparkSession, source_file: Sequence[str], output_file: str, schema: str | None = None, shuffled: bool = False, seed: int = 42, dry_run: bool = False, **_: Any) -> None:
    whole = dataset.merge(_read(spark, source_file, schema, output_file))
    if dry_run:
        return
    write(dataset.shuffle(whole, seed) if shuffled else whole, output_file)


@task("sample")
def sample(spark: SparkSession, source_file: Sequence[str], output_file: str, ratio: float | None = None, num: int | None = None, seed: int = 42, schema: str | None = None, parity: bool = False, **_: Any) -> None:
    if len(source_file) != 1:
        raise ValueError("one source file")
    write(sampling.sample(_read(spark, source_file, schema, output_file), num, ratio, seed, parity=parity), output_file)


@task("split")
def split(spark: SparkSession, source_file: Sequence[str], output_dir: str, ratios: Sequence[float], randomly: bool = False, seed: int = 42, schema: str | None = None, **_: Any) -> list[str]:
    stem = source_file[0].rsplit("/", 1)[-1].rsplit(".", 1)[0]
    total = sum(ratios)
    out = [f"{output_dir.rstrip('/')}/{part_name(stem, r / total, k, len(ratios))}" for k, r in enumerate(ratios)]
    rows = _read(spark, source_file, schema, *out)
    for path, part in zip(out, sampling.split(rows, ratios, randomly, seed)):
        write(_renumber(part), path)
    return out


@task("sort")
def sort(spark: SparkSession, source_file: Sequence[str], output_file: str, key: str = "id", reverse: bool = False, schema: str | None = None, **_: Any) -> None:
    write(dataset.sort(_read(spark, source_file, schema, output_file), dataset.by_last_message(key), reverse), output_file)


@task("filter")
def filter_(spark: SparkSession, source_file: Sequence[str], output_file: str, filter_function: str, partial_kwargs: dict[str, Any] | None = None, dry_run: bool = False, schema: str | None = None, **_: Any) -> None:
    kept = write(filters.filter_samples(_read(spark, source_file, schema, output_file), filter_function, dry_run, **(partial_kwargs or {})), output_file)
    log.info("filtered by %s into %s: %d rows kept", filter_function, output_file, kept)


@task("dedup")
def dedup_(spark: SparkSession, source_file: Sequence[str], output_file: str, dedup_function: str = "exact_match", reference_file: Sequence[str] | None = None, threshold: float | None = None, embedder: str | None = None, schema: str | None = None, dry_run: bool = False, batch_size: int = 12, cache_dir: str | None = None, **_: Any) -> None:
    from .external.backend import get_embedder
    from .external.calls import embed, embed_stored

    source = _read(spark, source_file, schema, output_file).withColumn("text", M.to_str(F.col("messages")))
    own = reference_file is None or list(reference_file) == list(source_file)
    reference = None if own else _read(spark, reference_file, schema).withColumn("text", M.to_str(F.col("messages")))
    if dry_run:
        source = source.where(F.col("pos") < 4)
    options = {} if threshold is None else {"threshold": threshold}
    if dedup_function == "exact_match":
        left = dedup.exact_match(source, source if reference is None else reference)
    elif dedup_function == "embedding_similarity":
        model = get_embedder(embedder or "")
        with_vector = lambda df: embed_stored(df, "text", model, cache_dir, embedder or "", batch=batch_size) if cache_dir else embed(df, "text", model, batch=batch_size)
        left = dedup.embedding_similarity(with_vector(source), None if reference is None else with_vector(reference), **options).drop("embedding")
    elif dedup_function in DEDUPS:
        left = DEDUPS[dedup_function](source, reference, **options)
    else:
        raise ValueError(f"no dedup function {dedup_function}; there are {sorted(DEDUPS)}")
    write(_renumber(left.drop("text")), output_file)


@task("generate")
def generate(spark: SparkSession, source_file: Sequence[str], output_file: str, process_function: str, model: str | None = None, failure_file: str | None = None, dry_run: bool = False, schema: str | None = None, partial_kwargs: dict[str, Any] | None = None, max_tokens: int | None = None, **more: Any) -> None:
    """Rows through a transform. A transform that calls a model takes ``calls``: workers, cache, checkpoints, reruns."""
    if process_function not in TRANSFORMS:
        raise ValueError(f"no transform {process_function}; there are {sorted(TRANSFORMS)}")
    calls = _calls(more)
    rows = _read(spark, source_file, schema, output_file, failure_file)
    options = dict(partial_kwargs or {})
    if model is not None:
        options["backend"] = get_backend(model)
    if {"calls", "params"} & set(inspect.signature(TRANSFORMS[process_function]).parameters):
        options["calls"] = calls
        if max_tokens is not None:
            options["max_tokens"] = max_tokens
    done, rejected = TRANSFORMS[process_function](sampling.dry_run(rows) if dry_run else rows, **options)
    _write_both(done, rejected, output_file, failure_file)


def _write_both(done: DataFrame, rejected: DataFrame, output_file: str, failure_file: str | None) -> None:
    log.info("%d rows done, into %s", write(done, output_file), output_file)
    if failure_file:
        log.info("%d rows rejected, into %s", write(rejected, failure_file), failure_file)


@task("translate")
def translate(spark: SparkSession, source_file: Sequence[str], output_file: str, model: str, src_lang_code: str = "en", tgt_lang_code: str = "zh", failure_file: str | None = None, schema: str | None = None, dry_run: bool = False, max_tokens: int | None = None, **more: Any) -> None:
    calls = _calls(more)
    rows = _read(spark, source_file, schema, output_file, failure_file)
    params = {} if max_tokens is None else {"max_tokens": max_tokens}
    done, rejected = transforms.translate(sampling.dry_run(rows) if dry_run else rows, get_backend(model), src_lang_code, tgt_lang_code, calls=calls, **params)
    _write_both(done, rejected, output_file, failure_file)


@task("analyze")
def analyze(spark: SparkSession, source_file: Sequence[str], item: str = "length", bins: Sequence[int] | None = None, tokenizer: str | None = None, schema: str | None = None, **_: Any) -> list[tuple]:
    """Rows of a histogram of lengths (in characters, or tokens by a rank file) or rounds."""
    from .functions.tokens import count_tokens

    rows = _read(spark, source_file, schema)
    if item == "length":
        out = stats.length_histogram(rows, M.to_str(F.col("messages")), bins or stats.BINS, count_tokens(tokenizer) if tokenizer else F.length)
    elif item == "rounds":
        out = stats.rounds_histogram(rows, bins)
    else:
        raise ValueError(f"neither length nor rounds: {item}")
    return [tuple(r) for r in out.orderBy(out.columns[0]).collect()]


@task("watch")
def watch(spark: SparkSession, source_file: Sequence[str], start: int = 0, num: int = 1, pattern: str | None = None, last_only: bool = False, schema: str | None = None, **_: Any) -> list[str]:
    """Samples as text from a place on, or the next that a pattern is found in, from there to the end and then from the beginning, marked."""
    from .functions import text as T

    rows = _read(spark, source_file, schema)
    messages = F.col("messages")
    if pattern is not None:
        rows = rows.where(M.search(messages, pattern, last_only)).orderBy(F.col("pos") < start, "pos")
        messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), T.highlight(m["content"], pattern).alias("content")))
    else:
        rows = rows.where(F.col("pos") >= start).orderBy("pos")
    return [r[0] for r in rows.limit(num).select(M.to_str(messages)).collect()]


@task("chat")
def chat(spark: SparkSession, model: str, read: Callable[[str], str] = input, say: Callable[[str], None] = print, **params: Any) -> list[dict[str, str]]:
    """A talk with a model until an empty line; ``clear`` begins anew."""
    from .external.backend import Retry, chat_once

    backend, history = get_backend(model), []
    while text := read("> ").strip():
        if text == "clear":
            history = []
            continue
        history.append({"role": "user", "content": text})
        answer = chat_once(backend, history, {k: v for k, v in params.items() if v is not None}, Retry())
        history.append({"role": "assistant", "content": answer})
        say(answer)
    return history
