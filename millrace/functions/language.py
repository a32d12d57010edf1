"""Language by decisive letters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

NAMES = {"de": "German", "en": "English", "fr": "French", "jp": "Japanese", "kr": "Korean", "ru": "Russian", "zh": "Chinese"}
_SCRIPTS = (("zh", r"[\x{4e00}-\x{9fff}]"), ("jp", r"[\x{3040}-\x{30ff}]"), ("kr", r"[\x{ac00}-\x{d7af}]"), ("ru", r"[\x{0400}-\x{04ff}]"))
_ANY = "[" + "".join(p[1:-1] for _, p in _SCRIPTS) + "]"
_GERMAN = "[äöüßÄÖÜ]"
_FRENCH = "[éèêëàâîïôûùçÉÈÊËÀÂÎÏÔÛÙÇ]"


def detect_language(text: Column, relaxed: bool = False) -> Column:
    """Code of the text's language: by its first character of a script of its own, else German before French letters, else ``en`` if it is all letters a to z, else ``unknown``.

    ``relaxed`` calls a text English if it has a letter and all its letters are from a to z.
    """
    first = F.regexp_extract(text, _ANY, 0)
    code = F.when(text.isNull(), None)
    for name, pattern in _SCRIPTS:
        code = code.when(first.rlike(pattern), name)
    english = (text.rlike("[a-zA-Z]") & ~text.rlike(r"(?U)[\p{L}&&[^a-zA-Z]]")) if relaxed else text.rlike(r"\A[a-zA-Z]+\z")
    return code.when(text.rlike(_GERMAN), "de").when(text.rlike(_FRENCH), "fr").when(english, "en").otherwise("unknown")


def language_name(code: Column) -> Column:
    """English name of a code, or null."""
    return F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[code]
