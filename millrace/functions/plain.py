"""Helpers of the driver: keyword strings, names, times, cache keys."""

from __future__ import annotations

import ast
import functools
import logging
import time
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.column import Column

log = logging.getLogger("millrace")
_OPEN, _SHUT = "([{", ")]}"


def parse_kwargs(text: str) -> dict[str, Any]:
    """``a=1, b=[x, 'y,z']`` as a dict: commas within quotes or brackets don't separate; values are Python literals, else strings."""
    pieces, deep, quote = [""], 0, ""
    for c in text or "":
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in _OPEN or c in _SHUT:
            deep += 1 if c in _OPEN else -1
        elif c == "," and not deep:
            pieces.append("")
            continue
        pieces[-1] += c
    out: dict[str, Any] = {}
    for piece in filter(str.strip, pieces):
        name, equals, value = piece.partition("=")
        if not equals:
            raise ValueError(f"not name=value: {piece.strip()}")
        try:
            out[name.strip()] = ast.literal_eval(value.strip())
        except (ValueError, SyntaxError):
            out[name.strip()] = value.strip()
    return out


def timestamp(at: datetime | None = None) -> str:
    """Year to second in fourteen digits."""
    return (at or datetime.now()).strftime("%Y%m%d%H%M%S")


def parse_timestamp(text: Column) -> Column:
    """The time of fourteen digits."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def format_timestamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMddHHmmss")


def cache_key(function: str, version: str, *values: Column) -> Column:
    """A digest of a function's name and version and of its arguments; two functions never share one."""
    return F.sha2(F.to_json(F.struct(F.lit(function).alias("f"), F.lit(version).alias("v"), *[v.alias(f"x{k}") for k, v in enumerate(values)])), 256)


def timed(function: Callable) -> Callable:
    """Logs how long each call takes."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", function.__name__, time.perf_counter() - began)

    return run


def set_up_log(path: str | None = None, verbose: bool = False, keep: int = 5) -> None:
    """Logs to the console and, if a path is given, to a file that is turned over."""
    from logging.handlers import RotatingFileHandler

    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=1 << 24, backupCount=keep))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = handlers


def part_name(stem: str, ratio: float, part: int, parts: int) -> str:
    """The name of a split's part."""
    return f"{stem}_{parts}.ratio_{ratio:.2f}.part_{part}.json"
