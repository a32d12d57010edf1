"""Running code in a process of its own with limits. This keeps accidents in, not attackers; it is off unless asked for."""

from __future__ import annotations

import ast
import os
import resource
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import BooleanType

RESULT = "timeout boolean, exit_code int, stdout string, stderr string"
_OUTPUT = 2048
_MEMORY = 1 << 30


def _limits(seconds: float) -> None:
    os.setsid()
    resource.setrlimit(resource.RLIMIT_AS, (_MEMORY, _MEMORY))
    resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 2))
    resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 22, 1 << 22))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))


def run_code(code: str, timeout: float = 15.0, output: int = _OUTPUT) -> tuple[bool, int, str, str]:
    """(timeout, exit code, output, errors) of a Python program, its streams cut at ``output`` bytes; the whole process group ends at the timeout."""
    with tempfile.TemporaryDirectory() as folder, open(f"{folder}/out", "wb") as out, open(f"{folder}/err", "wb") as err:
        os.mkdir(f"{folder}/work")
        process = subprocess.Popen([sys.executable, "-I", "-c", code], cwd=f"{folder}/work", stdin=subprocess.DEVNULL, stdout=out, stderr=err, env={"PATH": os.defpath, "PYTHONHASHSEED": "0"}, preexec_fn=lambda: _limits(timeout))
        late = False
        try:
            process.wait(timeout)
        except subprocess.TimeoutExpired:
            late = True
        finally:
            try:
                os.killpg(process.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            process.wait()
        texts = []
        for name in ("out", "err"):
            with open(f"{folder}/{name}", "rb") as f:
                texts.append(f.read(output).decode("utf-8", "replace"))
    return late, -1 if late else process.returncode, texts[0], texts[1]


def run_column(df: DataFrame, code: str, name: str = "run", timeout: float = 15.0, allow: bool = False) -> DataFrame:
    """``df`` with a struct (timeout, exit_code, stdout, stderr) for the program in each row; null for a null program. It must be allowed by name."""
    if not allow:
        raise PermissionError("running code from data must be allowed: allow=True")

    def run(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in codes:
            rows = [(None, None, None, None) if c is None else run_code(c, timeout) for c in batch]
            yield pd.DataFrame(rows, columns=["timeout", "exit_code", "stdout", "stderr"]).astype({"exit_code": "Int32", "timeout": "boolean"})

    return df.withColumn(name, F.pandas_udf(run, RESULT).asNondeterministic()(F.col(code)))


def status(run: Column) -> Column:
    """``timeout``, ``ok``, ``syntax_error``, ``assertion_error`` or ``error``."""
    last = F.regexp_extract(run["stderr"], r"(?m)^([A-Za-z_.]*(?:Error|Exception|Interrupt|Exit))\b[^\n]*\s*\z", 1)
    return F.when(run["exit_code"].isNull(), None).when(run["timeout"], "timeout").when(run["exit_code"] == 0, "ok").when(last.isin("SyntaxError", "IndentationError", "TabError"), "syntax_error").when(last == "AssertionError", "assertion_error").otherwise("error")


@F.pandas_udf(BooleanType())
def has_syntax_error(codes: pd.Series) -> pd.Series:
    """Whether Python can't parse the code; null for null."""

    def bad(code: str) -> bool:
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return True
        return False

    return codes.map(bad, na_action="ignore").astype("boolean")


@F.pandas_udf(BooleanType())
def same_literal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts are equal as Python literals; texts that aren't literals are compared as they are, without white space around them."""

    def value(text: str):
        try:
            return ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return text.strip()

    return pd.Series([None if x is None or y is None else bool(value(x) == value(y)) for x, y in zip(a, b)], dtype="boolean")
