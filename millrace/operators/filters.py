"""Filters over canonical rows, by named predicates. A filter keeps the rows for which its predicate is true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as T
from ..functions import tokens
from ..registry import PREDICATES, predicate
from ..sandbox import has_syntax_error, run_column, same_literal
from .sampling import dry_run as few


def _answer(strict: bool = True):
    """The last message's text; with ``strict`` a row whose last message isn't an assistant's fails the job."""
    end = M.last(F.col("messages"))
    ok = M.role(end) == "assistant"
    return F.when(ok, end["content"]).otherwise(F.raise_error(F.lit("the last message isn't the assistant's")) if strict else F.lit(None))


@predicate("has_python_code")
def has_python_code(strict: bool = True):
    return T.has_code_block(_answer(strict))


@predicate("is_pot_output_regular")
def is_pot_output_regular(strict: bool = True):
    parts = T.program_parts(_answer(strict))
    body = T.program_output(_answer(strict))
    wrong = F.raise_error(F.lit("not a program-of-thought answer")) if strict else F.lit(False)
    return F.when(parts.isNotNull(), body != "").otherwise(wrong)


@predicate("is_multi_step")
def is_multi_step():
    m = F.col("messages")
    return (F.size(m) == 2) & F.coalesce(M.role(M.last(m)) == "assistant", F.lit(False)) & (T.count_steps(M.last(m)["content"]) > 1)


@predicate("is_single_turn")
def is_single_turn(legacy: bool = False):
    return M.is_single_turn(F.col("messages"), legacy)


@predicate("is_overlong")
def is_overlong(threshold: int = 4096, tokenizer: str | None = None, template: bool = True):
    """More tokens than ``threshold`` in the templated text, or in its ``role: content`` lines; ``tokenizer`` is a rank file, else tokens are approximate."""
    m = F.col("messages")
    body = M.chat_template(m) if template else M.to_str(m)
    return (tokens.count_tokens(tokenizer) if tokenizer else tokens.approximate_tokens)(body) > threshold


@predicate("has_syntax_error")
def syntax_error(strict: bool = True):
    code = T.extract_code(M.last(F.col("messages"))["content"])
    return has_syntax_error(F.coalesce(code, F.raise_error(F.lit("no code")).cast("string")) if strict else code)


def can_python_code_run(df: DataFrame, timeout: float = 2.0, allow: bool = False) -> DataFrame:
    """``df`` with ``keep``: whether the code of the last message runs to its end in time."""
    ran = run_column(df.withColumn("_code", T.extract_code(M.last(F.col("messages"))["content"])), "_code", "_run", timeout, allow)
    return ran.withColumn("keep", F.coalesce((F.col("_run.exit_code") == 0) & ~F.col("_run.timeout"), F.lit(False))).drop("_code", "_run")


def python_code_run_result_correct(df: DataFrame, timeout: float = 5.0, allow: bool = False) -> DataFrame:
    """``df`` with ``keep``: whether the code prints what the output fence says, as literals."""
    end = M.last(F.col("messages"))["content"]
    ran = run_column(df.withColumn("_code", T.extract_code(end)), "_code", "_run", timeout, allow)
    ok = (F.col("_run.exit_code") == 0) & same_literal(F.col("_run.stdout"), T.extract_output(end))
    return ran.withColumn("keep", F.coalesce(ok, F.lit(False))).drop("_code", "_run")


#: Predicates that need a pass of their own: from a frame to a frame with ``keep``.
FRAMES = {"can_python_code_run": can_python_code_run, "python_code_run_result_correct": python_code_run_result_correct}


def filter_samples(df: DataFrame, name: str, dry_run: bool = False, **kwargs) -> DataFrame:
    """Rows for which the named predicate holds; ``dry_run`` tries 16 of them."""
    df = few(df) if dry_run else df
    if name in FRAMES:
        return FRAMES[name](df, **kwargs).where("keep").drop("keep")
    if name not in PREDICATES:
        raise ValueError(f"no predicate {name}; there are {sorted([*PREDICATES, *FRAMES])}")
    return df.where(PREDICATES[name](**kwargs))
