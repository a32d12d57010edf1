"""Model backends: a chat model is a function from messages and parameters to a response."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, Protocol

Message = Mapping[str, str]


class CallError(Exception):
    """A call that failed for good: the row is rejected, the job goes on."""


class RetryableError(CallError):
    """A call that may work when tried again."""


class Backend(Protocol):
    """What a chat model must offer; it is pickled to workers, so it opens connections there."""

    name: str

    def chat(self, messages: Sequence[Message], params: Mapping[str, Any]) -> dict[str, Any]: ...


def answer_of(response: Mapping[str, Any]) -> str:
    """The text of a chat or completion response."""
    try:
        first = response["choices"][0]
        return first["message"]["content"] if "message" in first else first["text"]
    except (KeyError, IndexError, TypeError) as e:
        raise CallError(f"no answer in the response: {e!r}") from e


@dataclass(frozen=True)
class HttpBackend:
    """An endpoint of the usual chat-completions form. The key is read on the worker from the environment variable named, and never logged."""

    name: str
    base_url: str
    key_variable: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)
    timeout: float = 960.0
    completion: bool = False

    def chat(self, messages: Sequence[Message], params: Mapping[str, Any]) -> dict[str, Any]:
        import os

        body: dict[str, Any] = {"model": self.name, **self.params, **params}
        if self.completion:
            body["prompt"] = "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages) + "<|im_start|>assistant\n"
        else:
            body["messages"] = [dict(m) for m in messages]
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        url = f"{self.base_url.rstrip('/')}/{'completions' if self.completion else 'chat/completions'}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise (RetryableError if e.code == 429 or e.code >= 500 else CallError)(f"HTTP {e.code}") from e
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
            raise RetryableError(repr(e)) from e


@dataclass(frozen=True)
class HttpRunner:
    """A service that runs code: posts code and language, and gives the status that it says."""

    base_url: str
    language: str = "bash"
    timeout: float = 60.0

    def __call__(self, code: str) -> str:
        body = json.dumps({"code": code, "language": self.language}).encode()
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/run_code", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return str(json.load(r)["status"])
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError, KeyError, TypeError) as e:
            raise RetryableError(repr(e)) from e


@dataclass
class FakeBackend:
    """A model without a network: its answer is a pure function of the messages. ``failures`` has, by text of the last message, how many first attempts fail in each worker."""

    name: str = "fake"
    answer: Callable[[Sequence[Message]], str] | None = None
    failures: Mapping[str, int] = field(default_factory=dict)
    unexpected: frozenset[str] = frozenset()
    _seen: dict[str, int] = field(default_factory=dict)

    def chat(self, messages: Sequence[Message], params: Mapping[str, Any]) -> dict[str, Any]:
        last = messages[-1]["content"] if messages else ""
        if last in self.unexpected:
            raise RuntimeError("unexpected")
        self._seen[last] = self._seen.get(last, 0) + 1
        if self._seen[last] <= self.failures.get(last, 0):
            raise RetryableError("not yet")
        text = self.answer(messages) if self.answer else "echo:" + hashlib.sha256(last.encode()).hexdigest()[:16]
        return {"choices": [{"message": {"role": "assistant", "content": text}}], "usage": {"total_tokens": sum(len(m["content"].split()) for m in messages)}}


_backends: dict[str, Backend] = {}
_embedders: dict[str, Callable[[Sequence[str]], Sequence[Sequence[float]]]] = {}


def register_backend(backend: Backend) -> None:
    """Makes a chat model known by its exact name."""
    if not getattr(backend, "name", ""):
        raise ValueError("a backend needs a name")
    _backends[backend.name] = backend


def register_embedder(prefix: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> None:
    """Makes an embedding model known for all names with a prefix."""
    _embedders[prefix] = embed


def get_backend(name: str) -> Backend:
    if name not in _backends:
        raise ValueError(f"no chat model {name}; there are {sorted(_backends)}")
    return _backends[name]


def get_embedder(name: str) -> Callable[[Sequence[str]], Sequence[Sequence[float]]]:
    for prefix in sorted(_embedders, key=len, reverse=True):
        if name.startswith(prefix):
            return _embedders[prefix]
    raise ValueError(f"no embedding model {name}; there are {sorted(_embedders)}")


register_backend(FakeBackend())


@dataclass(frozen=True)
class Retry:
    """Attempts, and waits that double with jitter."""

    attempts: int = 10
    first: float = 0.5
    most: float = 1800.0
    jitter: float = 2.0

    def call(self, function: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        for k in range(self.attempts):
            try:
                return function()
            except RetryableError:
                if k == self.attempts - 1:
                    raise
                sleep(min(self.most, self.first * 2**k + random.uniform(0, self.jitter)))
        raise CallError("no attempts")


def chat_once(backend: Backend, messages: Sequence[Message], params: Mapping[str, Any], retry: Retry) -> str:
    """The answer, after retries; parameters of one call never reach another."""
    own = MappingProxyType(dict(params))
    return retry.call(lambda: answer_of(backend.chat(messages, own)))


