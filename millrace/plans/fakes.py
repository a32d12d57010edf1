"""Models without a network for the queries: what they answer follows from a digest of what they are asked, so that SQL can tell it too."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import partial

from ..external.backend import CallError, FakeBackend

Messages = Sequence[Mapping[str, str]]


def number(text: str) -> int:
    """The first 32 bits of a text's digest."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def _label(names: tuple[str, ...], line: str, divide: int, messages: Messages) -> str:
    k = number(messages[-1]["content"]) // divide % (len(names) + 1)
    return f"so\n{line}: {names[k]}" if k < len(names) else "none of them"


def labelling(names: Sequence[str], line: str, divide: int = 1, name: str = "fake-label") -> FakeBackend:
    """Names one of ``names`` in a line, or none."""
    return FakeBackend(name, partial(_label, tuple(names), line, divide))


def _shell(messages: Messages) -> str:
    n = number(messages[-1]["content"])
    return f"```bash\necho {n}\n```" if n % 3 else "I can't"


def _translation(messages: Messages) -> str:
    n = number(messages[-1]["content"])
    return ("question: one\nanswer: two\nground_truth: three\n", f"question: 问{n}\nanswer: 答{n}\nground_truth: 真\n", f"问{n}", f"question: 问{n}\nanswer: 答\nground_truth: 真{n}\n")[n % 4]


SHELL = FakeBackend("fake-shell", _shell)
TRANSLATOR = FakeBackend("fake-translator", _translation)


def shell_status(code: str) -> str:
    """A runner: half of the programs succeed."""
    return "Success" if number(code) % 2 else "Failed"


def fails_for_some(text: str) -> str:
    """A call that fails for a third of the texts."""
    n = number(text)
    if n % 3 == 0:
        raise CallError(f"no {n}")
    return str(n)


def lengths(texts: Sequence[str]) -> list[list[float]]:
    """An embedding: a text's length, and how many times it has an e."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


async def answer_later(text: str) -> str:
    """A coroutine with the answer of :func:`number`."""
    return str(number(text))
