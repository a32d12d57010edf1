"""Labels out of model answers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

LANGUAGES = tuple("Bash|C|C#|C++|Fortran|Go|HTML|Java|JavaScript|Kotlin|LaTeX|LISP|Lua|MATLAB|Objective-C|Pascal|Perl|PHP|Python|R|Ruby|Rust|SQL|Swift|TypeScript|Visual Basic|Other".split("|"))
CODING_TASKS = tuple("Generation|Completion|Explanation|QA|Translation|Debug|Optimization|Style_Polish|Unit_Test_Generation|Other".split("|"))
FAILED = None


def ratio(a: str, b: str) -> int:
    """Likeness from 0 to 100."""
    return int(round(100 * difflib.SequenceMatcher(None, a, b).ratio())) if a and b else 0


def closest(answer: str, labels: tuple[str, ...], longest: int = 42, least: int = 50) -> str | None:
    """The label most like the answer, the first of equals; ``other`` if the answer doesn't contain it; None if the answer is ``longest`` long or no label is more than ``least`` like it."""
    own = answer.strip().lower()
    if len(own) >= longest:
        return FAILED
    scores = [ratio(own, x.lower()) for x in labels]
    best = max(range(len(labels)), key=lambda k: scores[k])
    if scores[best] <= least:
        return FAILED
    return labels[best].lower() if labels[best].lower() in own else "other"


def parse_label(labels: tuple[str, ...], name: str):
    """A function from an answer column to its label: what follows ``name: `` in the last such line, by :func:`closest`; null where that fails."""

    @F.pandas_udf("string")
    def parse(answers: pd.Series) -> pd.Series:
        found = answers.str.extract(rf"(?s)\A(?:.*)\n{name}: (.*)", expand=False)
        known = {a: closest(a, labels) for a in found.dropna().unique()}
        return pd.Series([known.get(a) if isinstance(a, str) else None for a in found], dtype=object)

    return parse
