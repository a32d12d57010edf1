"""Text functions as Column expressions: fences, program-of-thought parts, think blocks, search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

_SPACE = r"[\s\x1c-\x1f]"
_FENCE = r"(?sU)```(\s*)(\S*)?\n(.*?)```"
_OUTPUT = r"(?s)```output\n(.*?)```"
_STEP = r"(?s)```python\n(.*?)```[\n]*```output\n(.*?)```"
_THINK = r"(?s)<think>(.*?)</think>"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without white space of any script at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def extract_code(text: Column) -> Column:
    """Body of the first fenced block of any language; null without one, empty for an empty block."""
    return F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 3))


def extract_output(text: Column) -> Column:
    """Body of the first output block, or null."""
    return F.when(text.rlike(_OUTPUT), F.regexp_extract(text, _OUTPUT, 1))


def remove_output(text: Column) -> Column:
    """Without any output block; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?s)```output\n.*?```", ""), F.lit(""))


def has_code_block(text: Column) -> Column:
    """Whether the first fenced block has more than white space."""
    return F.coalesce(strip(extract_code(text)) != "", F.lit(False))


def count_steps(text: Column) -> Column:
    """Python blocks that an output block follows at once."""
    return F.regexp_count(text, F.lit(_STEP))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before_last(text: Column, mark: str) -> Column:
    """What stands before the last occurrence of a mark, or null."""
    return F.when(F.contains(text, F.lit(mark)), F.left(text, F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)))


def program_parts(text: Column) -> Column:
    """Struct (comprehension, code, output, summary) of a program-of-thought answer, each stripped; null if the text isn't one.

    From the end: the last closing fence, before it the last output fence that follows a closed block, and
    before that the last Python fence. Marks are found as they stand, without a pattern, so the time is
    linear in the text.
    """
    code, join, close = "\n```python\n", "\n```\n\n```output\n", "\n```\n"

    def cut(x: Column) -> Column:
        return let(
            _before_last(x, close),
            lambda r: let(
                # the fence may not run into the last one
                _before_last(r, join),
                lambda q: let(
                    _before_last(q, code),
                    lambda p: F.when(
                        p.isNotNull(),
                        F.struct(
                            strip(p).alias("comprehension"),
                            strip(F.substr(x, F.length(p) + 1, F.length(q) - F.length(p) + len(close))).alias("code"),
                            strip(F.substr(x, F.length(q) + len(close) + 1, F.length(r) - F.length(q))).alias("output"),
                            strip(F.substr(x, F.length(r) + len(close) + 1)).alias("summary"),
                        ),
                    ),
                ),
            ),
        )

    return let(text, cut)


def program_output(text: Column) -> Column:
    """What stands in the output fence of a program-of-thought answer, stripped; null if the text isn't one."""
    return strip(F.regexp_replace(F.regexp_replace(program_parts(text)["output"], r"\A```output\n", ""), r"```\z", ""))


def render_think(text: Column) -> Column:
    """Think blocks as quoted lines."""
    bodies = F.regexp_extract_all(text, F.lit(_THINK), 1)
    rests = F.split(text, r"(?s)<think>.*?</think>", -1)
    quoted = F.transform(bodies, lambda b: F.when(strip(b) == "", "").otherwise(F.array_join(F.transform(F.split(strip(b), _LINE_END), lambda line: F.concat(F.lit("> "), line)), "\n")))
    return F.concat(F.element_at(rests, 1), F.array_join(F.zip_with(quoted, F.slice(rests, 2, F.greatest(F.size(rests) - 1, F.lit(0))), lambda q, r: F.concat(q, r)), ""))


def question_parts(text: Column, as_written: bool = False) -> Column:
    """Struct (question, answer, ground_truth) of a labelled text, null if any is missing; ``as_written`` keeps one character of the last."""
    question = r"(?s)question:\s*(.*?)(?=\nanswer:)"
    answer = r"(?s)answer:\s*(.*?)(?=\nground_truth:)"
    truth = r"(?s)ground_truth:\s*(.+?)" if as_written else r"(?s)ground_truth:\s*(.+)"
    ok = text.rlike(question) & text.rlike(answer) & text.rlike(truth)
    return F.when(ok, F.struct(*[strip(F.regexp_extract(text, p, 1)).alias(n) for p, n in ((question, "question"), (answer, "answer"), (truth, "ground_truth"))]))


def replace_from_right(text: Column, old: str, new: str, count: int = -1) -> Column:
    """With the last ``count`` occurrences of ``old`` replaced, all by default."""
    if count < 0:
        return F.replace(text, F.lit(old), F.lit(new))
    parts = F.split(text, r"\Q" + old + r"\E", -1)
    kept = F.greatest(F.size(parts) - count, F.lit(1))
    head = F.array_join(F.slice(parts, 1, kept), old)
    tail = F.slice(parts, kept + 1, F.size(parts))
    return F.concat(head, F.array_join(F.transform(tail, lambda p: F.concat(F.lit(new), p)), ""))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; eleventh to twentieth end with th."""
    last = n % 10
    suffix = F.when((n % 100).between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def prefix_match(prefix: Column, text: Column) -> Column:
    """Whether the text begins with the prefix; white space around them and case don't count."""
    return F.startswith(F.lower(strip(text)), F.lower(strip(prefix)))


def digest(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, a dot standing for line ends too."""
    return text.rlike("(?s)" + pattern)


def highlight(text: Column, pattern: str) -> Column:
    """All matches replaced by the text of the first one, marked."""
    first = F.regexp_extract(text, "(?s)" + pattern, 0)
    quoted = F.regexp_replace(first, r"([\\$])", r"\\$1")
    marked = F.concat(F.lit("==**__"), quoted, F.lit("__**=="))
    return F.when(matches(text, pattern), F.regexp_replace(text, F.lit("(?s)" + pattern), marked)).otherwise(text)
