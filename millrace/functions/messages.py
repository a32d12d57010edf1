"""Functions over arrays of messages (role, content, extras). ``human`` and ``user`` are one role; case doesn't count."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def role(message: Column, legacy: bool = False) -> Column:
    """The role in lower case; ``legacy`` keeps ``human`` and ``user`` apart."""
    low = F.lower(message["role"])
    return low if legacy else F.when(low == "human", "user").otherwise(low)


def roles(messages: Column, legacy: bool = False) -> Column:
    return F.transform(messages, lambda m: role(m, legacy))


def count_role(messages: Column, name: str, legacy: bool = False) -> Column:
    return F.size(F.filter(roles(messages, legacy), lambda r: r == name))


def at(messages: Column, k: int) -> Column:
    """The message at a place from 1 on, or from the end if negative; null if there is none."""
    return F.get(messages, F.lit(k - 1) if k > 0 else F.size(messages) + k)


def last(messages: Column) -> Column:
    return at(messages, -1)


def to_str(messages: Column) -> Column:
    """``role: content`` lines: the text by which samples are compared."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def chat_template(messages: Column, prompt: bool = False) -> Column:
    """Messages in start and end marks, with an open assistant turn if ``prompt``."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(turns, F.lit("<|im_start|>assistant\n")) if prompt else turns


def is_single_turn(messages: Column, legacy: bool = False) -> Column:
    """Two or three different roles, at most one system message, one assistant message, one or two human ones."""
    human = "human" if legacy else "user"
    kinds = F.size(F.array_distinct(roles(messages, legacy)))
    n = lambda name: count_role(messages, name, legacy)
    return kinds.between(2, 3) & (n("system") <= 1) & (n("assistant") == 1) & n(human).between(1, 2)


def search(messages: Column, pattern: str, last_only: bool = False) -> Column:
    """Whether any message has the pattern; ``last_only`` looks at the last alone."""
    found = lambda m: m["content"].rlike("(?s)" + pattern)
    return F.coalesce(found(last(messages)) if last_only else F.exists(messages, found), F.lit(False))


def replace_last(messages: Column, content: Column) -> Column:
    """With the content of the last message replaced."""
    end = last(messages)
    own = F.struct(end["role"].alias("role"), content.alias("content"), end["extras"].alias("extras"))
    return F.concat(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), F.array(own))


def message(role_: str, content: Column) -> Column:
    """A message without extras."""
    return F.struct(F.lit(role_).alias("role"), content.alias("content"), F.lit(None).cast("map<string,string>").alias("extras"))


def tag_first(messages: Column, name: str, value: Column) -> Column:
    """With a tag added to the first message's extras; one of the same name is replaced."""
    first = at(messages, 1)
    old = F.map_filter(F.coalesce(first["extras"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k != name)
    own = F.struct(first["role"].alias("role"), first["content"].alias("content"), F.map_concat(old, F.create_map(F.lit(name), value)).alias("extras"))
    return F.concat(F.array(own), F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))))
