"""Sample schemas: what each looks like, how it becomes messages, and the text by which it is compared.

Raw samples are JSON strings. The first schema in order that fits is taken, as a registry of rules: a
list of messages, or an object with the right string fields. ``most_specific`` looks for the schema
with most fields instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .functions import messages as M

MESSAGE = "struct<role:string,content:string,extras:map<string,string>>"
CANONICAL = f"id bigint, pos bigint, messages array<{MESSAGE}>, extras map<string,string>"
GENERIC_ROLES = ("system", "user", "assistant", "human")
OAI_ROLES = ("system", "user", "assistant")
_SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Schema:
    """A named schema: its string fields, those of a question and an answer, and how it reads as text."""

    name: str
    fields: tuple[str, ...] = ()
    user: str = ""
    assistant: str = ""
    text: Callable[[Callable[[str], Column]], Column] | None = None
    roles: tuple[str, ...] = ()
    options: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exactly: int = 0
    wrapped: bool = True  # messages stand in a field, not in a bare list

    def column(self, raw: Column, name: str) -> Column:
        return F.get_json_object(raw, f"$.{name}")

    def fits(self, raw: Column) -> Column:
        """Whether a raw sample is of this schema: strings where strings belong, none coerced."""
        variant = F.try_parse_json(raw)
        is_string = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")) == "STRING", F.lit(False))
        ok = F.lit(True)
        for name in self.fields:
            ok = ok & is_string(name)
        for name, values in self.options.items():
            ok = ok & F.coalesce(F.try_variant_get(variant, f"$.{name}", "string").isin(*values), F.lit(False))
        if self.roles:
            ok = ok & _fit_messages(raw, self)
        else:
            ok = ok & F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
        return F.coalesce(ok, F.lit(False))

    def messages(self, raw: Column) -> Column:
        if self.roles:
            return parse_messages(messages_of(raw))
        user = F.coalesce(*[self.column(raw, n) for n in self.user.split("|")])
        return F.array(M.message("user", user), M.message("assistant", self.column(raw, self.assistant)))

    def to_str(self, raw: Column) -> Column:
        if self.text is not None:
            return self.text(lambda name: self.column(raw, name))
        return M.to_str(self.messages(raw))


def messages_of(raw: Column) -> Column:
    """The JSON list of messages of a sample: itself if it is a list, else its field."""
    return F.when(F.ltrim(raw).startswith("["), raw).otherwise(F.get_json_object(raw, "$.messages"))


def parse_messages(listed: Column) -> Column:
    """Messages from a JSON list; fields beside role and content become extras, nulls are dropped."""
    items = F.from_json(listed, "array<map<string,string>>")
    rest = lambda m: F.map_filter(m, lambda k, v: ~k.isin("role", "content") & v.isNotNull())
    return F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), rest(m).alias("extras")))


def _fit_messages(raw: Column, schema: Schema) -> Column:
    variants = F.from_json(messages_of(raw), "array<string>")
    one = lambda m: F.try_parse_json(m)
    text = lambda m, name: F.coalesce(F.schema_of_variant(F.try_variant_get(one(m), f"$.{name}", "variant")) == "STRING", F.lit(False))
    ok = lambda m: text(m, "content") & text(m, "role") & F.coalesce(F.try_variant_get(one(m), "$.role", "string").isin(*schema.roles), F.lit(False))
    size = F.size(variants)
    where = F.ltrim(raw).startswith("{") | F.lit(schema.name != "numina") & F.ltrim(raw).startswith("[")
    if not schema.wrapped:
        where = F.ltrim(raw).startswith("[")
    return where & F.coalesce((size == schema.exactly) if schema.exactly else (size >= 1), F.lit(False)) & F.coalesce(F.forall(variants, ok), F.lit(False))


def _lines(*names: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.concat_ws("\n", *[get(n) for n in names])


SCHEMAS: dict[str, Schema] = {
    s.name: s
    for s in (
        Schema("generic", roles=GENERIC_ROLES),
        Schema("gsm8k_en", ("question", "answer_only", "answer", "split"), "question", "answer", _lines("question", "answer"), options={"split": _SPLITS}),
        Schema("gsm8k_zh", ("question", "answer_only", "answer", "split", "question_zh", "answer_zh"), "question_zh", "answer_zh", _lines("question_zh", "answer_zh"), options={"split": _SPLITS}),
        Schema("leetcode", ("problem_ID", "problem_cn", "problem_en", "answer"), "problem_en", "answer", lambda get: F.concat(F.lit("Human:\n"), get("problem_en"), F.lit("\nAssistant:\n"), get("answer"))),
        Schema("leetcode_cn", ("problem_ID", "problem_cn", "problem_en", "answer"), "problem_cn", "answer", lambda get: F.concat(F.lit(" "), get("problem_cn"), F.lit(" "), get("answer"))),
        Schema("math_en", ("problem", "level", "type", "solution"), "problem", "solution", _lines("problem", "solution")),
        Schema("math_zh", ("problem", "level", "type", "solution"), "problem", "solution", _lines("problem", "solution")),
        Schema("meta_math_qa_en", ("query", "response", "type"), "query", "response", _lines("query", "response")),
        Schema("meta_math_qa_zh", ("query", "response", "type", "query_zh", "response_zh"), "query_zh", "response_zh", _lines("query_zh", "response_zh")),
        Schema("numina", ("problem", "solution"), "problem", "solution", lambda get: F.concat(F.lit("problem: "), get("problem"), F.lit("\nsolution: "), get("solution"), F.lit("\n")), roles=GENERIC_ROLES, exactly=2),
        Schema("oai", roles=OAI_ROLES, wrapped=False),
    )
}
#: Schemas that detection tries, in order; ``leetcode_cn`` is a reading of ``leetcode``, taken only by name.
DETECTED = tuple(n for n in SCHEMAS if n != "leetcode_cn")


def register(schema: Schema) -> None:
    """Adds a schema, which detection tries last."""
    global DETECTED
    SCHEMAS[schema.name] = schema
    DETECTED = tuple(dict.fromkeys((*DETECTED, schema.name)))


def detected(raw: Column, mode: str = "first_match") -> Column:
    """Name of the schema of a raw sample, null if none fits."""
    names = DETECTED if mode == "first_match" else tuple(sorted(DETECTED, key=lambda n: -len(SCHEMAS[n].fields) - bool(SCHEMAS[n].exactly) - (not SCHEMAS[n].wrapped)))
    code = F.lit(None).cast("string")
    for name in reversed(names):
        code = F.when(SCHEMAS[name].fits(raw), name).otherwise(code)
    return code


def detect_schema(raw: DataFrame, mode: str = "first_match") -> str:
    """The schema of a frame of raw samples (pos, raw) by its first; ``generic`` for none. No match raises TypeError."""
    first = raw.orderBy("pos").limit(1).select(detected(F.col("raw"), mode).alias("name")).collect()
    if not first:
        return "generic"
    if first[0]["name"] is None:
        raise TypeError("the first sample fits no schema")
    return first[0]["name"]


def oai_to_str(messages: Column, skip_first: bool = True) -> Column:
    """Messages as text without the first, whatever it is."""
    return M.to_str(F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))) if skip_first else messages)


def to_canonical(raw: DataFrame, name: str, on_error: str = "fail") -> DataFrame:
    """(id, pos, messages, extras, text) from (pos, raw) by a named schema.

    A row that doesn't fit fails the job when it is read (``fail``), goes (``drop``), or stays with null
    messages (``null``).
    """
    schema = SCHEMAS[name]
    fits = schema.fits(F.col("raw"))
    if on_error == "drop":
        raw = raw.where(fits)
    checked = F.col("raw")
    if on_error == "fail":
        checked = F.when(fits, F.col("raw")).otherwise(F.raise_error(F.concat(F.lit(f"not a {name} sample: "), F.substring("raw", 1, 200))))
    elif on_error == "null":
        checked = F.when(fits, F.col("raw"))
    rows = raw.select("pos", checked.alias("raw"))
    everything = F.from_json(F.when(F.ltrim("raw").startswith("{"), F.col("raw")), "map<string,string>")
    own = ("messages", *(() if name in ("generic", "numina") else schema.fields))
    extras = F.map_filter(everything, lambda k, v: ~k.isin(*own) & v.isNotNull()) if name in ("generic", "numina") else F.lit(None).cast("map<string,string>")
    text = oai_to_str(schema.messages(F.col("raw"))) if name == "oai" else schema.to_str(F.col("raw"))
    return rows.select(F.col("pos").alias("id"), "pos", schema.messages(F.col("raw")).alias("messages"), extras.alias("extras"), text.alias("text"))
