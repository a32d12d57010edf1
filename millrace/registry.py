"""Predicates and transforms by name, own ones included."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

PREDICATES: dict[str, Callable] = {}
TRANSFORMS: dict[str, Callable] = {}
DEDUPS: dict[str, Callable] = {}


def _into(table: dict[str, Callable]):
    def named(name: str):
        def add(function: Callable) -> Callable:
            table[name] = function
            return function

        return add

    return named


#: ``@predicate("name")``: a function from keyword arguments to a Column over canonical rows, or from a frame to a frame with ``keep``.
predicate = _into(PREDICATES)
#: ``@transform("name")``: a function from a frame (and keyword arguments) to (done, rejected).
transform = _into(TRANSFORMS)
#: ``@dedup("name")``: a function from source and reference to what stays.
dedup = _into(DEDUPS)


def load_file(path: str) -> None:
    """Runs a Python file that registers functions."""
    spec = importlib.util.spec_from_file_location("millrace_user_functions", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"not a Python file: {path}")
    spec.loader.exec_module(importlib.util.module_from_spec(spec))
