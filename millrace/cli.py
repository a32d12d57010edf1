"""Command line: ``python -m millrace.cli TASK --option value``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from .functions.plain import parse_kwargs, set_up_log
from .registry import load_file
from .tasks import TASKS

#: How a task calls a model.
_CALLS: tuple[tuple[str, dict], ...] = (
    ("--num-workers", {"type": int, "help": "calls at a time in each task"}),
    ("--call-mode", {"choices": ("thread", "coroutine", "serial")}),
    ("--cache-dir", {"help": "answers by request, for later runs"}),
    ("--checkpoint-dir", {"help": "answers rank by rank, to resume from"}),
    ("--checkpoint-interval", {"type": int, "help": "rows of a rank"}),
    ("--resume-from-checkpoint", {"action": "store_true"}),
    ("--max-rerun-count", {"type": int, "help": "how often rejected rows are called again; without end if negative"}),
    ("--max-tokens", {"type": int}),
)
_OPTIONS: dict[str, tuple[tuple[str, dict], ...]] = {
    "merge": (("--shuffled", {"action": "store_true"}),),
    "sample": (("--ratio", {"type": float}), ("--num", {"type": int}), ("--parity", {"action": "store_true"})),
    "split": (("--output-dir", {"required": True}), ("--ratios", {"type": float, "nargs": "+", "required": True}), ("--randomly", {"action": "store_true"})),
    "sort": (("--key", {"default": "id"}), ("--reverse", {"action": "store_true"})),
    "filter": (("--filter-function", {"required": True}), ("--partial-kwargs", {"type": parse_kwargs})),
    "dedup": (("--dedup-function", {"default": "exact_match"}), ("--reference-file", {"nargs": "+"}), ("--threshold", {"type": float}), ("--embedder", {}), ("--batch-size", {"type": int, "default": 12}), ("--cache-dir", {"help": "embeddings by text, for later runs"})),
    "generate": (("--process-function", {"required": True}), ("--model", {}), ("--failure-file", {}), ("--partial-kwargs", {"type": parse_kwargs}), *_CALLS),
    "translate": (("--model", {"required": True}), ("--src-lang-code", {"default": "en"}), ("--tgt-lang-code", {"default": "zh"}), ("--failure-file", {}), *_CALLS),
    "analyze": (("--item", {"default": "length"}), ("--bins", {"type": int, "nargs": "+"}), ("--tokenizer", {})),
    "watch": (("--start", {"type": int, "default": 0}), ("--num", {"type": int, "default": 1}), ("--pattern", {}), ("--last-only", {"action": "store_true"})),
    "chat": (("--model", {"required": True}), ("--temperature", {"type": float}), ("--max-tokens", {"type": int})),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    tasks = top.add_subparsers(dest="task", required=True)
    for name in TASKS:
        one = tasks.add_parser(name)
        if name != "chat":
            one.add_argument("--source-file", nargs="+", required=True)
            one.add_argument("--schema")
            one.add_argument("--dry-run", action="store_true")
        if name not in ("split", "analyze", "watch", "chat"):
            one.add_argument("--output-file", required=True)
        one.add_argument("--seed", type=int, default=42)
        one.add_argument("--functions", help="a Python file that registers own predicates and transforms")
        one.add_argument("--log-file")
        one.add_argument("--verbose", action="store_true")
        for flag, how in _OPTIONS[name]:
            one.add_argument(flag, **how)
    return top


def main(arguments: Sequence[str] | None = None, spark=None):
    from pyspark.sql import SparkSession

    given = vars(parser().parse_args(arguments))
    set_up_log(given.pop("log_file"), given.pop("verbose"))
    if path := given.pop("functions"):
        load_file(path)
    session = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    name = given.pop("task")
    if name == "chat":
        given.pop("seed")
    got = TASKS[name](session, **given)
    if got is not None and name != "chat":
        for row in got:
            print(row if isinstance(row, str) else json.dumps(row, ensure_ascii=False))
    return got


if __name__ == "__main__":
    main()
