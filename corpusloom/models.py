"""Embedders and analysers: interfaces, offline defaults that give the same output everywhere, and the retry rules.

An embedder has `dim` and `call(texts) -> vectors`; an analyser has `name` and `call(prompt, system) -> text`.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

LIMIT = 8000
EMPTY = "(empty)"
_THINK = re.compile(r"<think>.*?</think>\s*", re.DOTALL)
_DIRECTIVE = re.compile(r"\s*/no_think\s*$")


def sanitised(text: str | None, limit: int = LIMIT) -> str:
    return (text or "").strip()[:limit] or EMPTY


class DimensionError(ValueError):
    pass


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashed words and word pairs, of unit length. It has no notion of meaning."""

    dim: int = 256

    def call(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        words = [w for x in re.findall(r"[A-Za-z0-9_]+", text) for w in (x.lower(), *(p.lower() for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", x)))]
        out = [0.0] * self.dim
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else [1.0] + [0.0] * (self.dim - 1)


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding engine behind POST {model, input} -> {embeddings}."""

    url: str
    model: str
    dim: int
    timeout_s: float = 60

    def call(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout_s) as r:
            return json.load(r)["embeddings"]


def embed(model, texts: list[str]) -> list[list[float]]:
    """Vectors in the order of the texts. A failed batch is halved, left half first, down to single texts, whose failure is raised. A wrong length isn't tried again."""
    if not texts:
        return []

    def attempt(part: list[str]) -> list[list[float]]:
        try:
            found = model.call(part)
            if len(found) != len(part):
                raise RuntimeError(f"{len(found)} vectors for {len(part)} texts")
        except DimensionError:
            raise
        except Exception:
            if len(part) == 1:
                raise
            half = len(part) // 2
            return attempt(part[:half]) + attempt(part[half:])
        if bad := next((len(v) for v in found if len(v) != model.dim), None):
            raise DimensionError(f"vector of {bad}, not {model.dim}")
        return found

    return attempt([sanitised(t) for t in texts])


@dataclass(frozen=True)
class ExtractiveAnalyser:
    """Answers with the prompt's own facts: its first lines, cut to a length."""

    name: str = "extractive"
    chars: int = 400

    def call(self, prompt: str, system: str | None = None) -> str:
        facts = [x.strip("- ").strip() for x in _DIRECTIVE.sub("", prompt).split("\n") if x.strip() and not x.startswith(("Write ", "Output "))]
        return "; ".join(facts)[: self.chars]


@dataclass(frozen=True)
class HttpAnalyser:
    """An engine behind a chat-completions endpoint. Directives for local engines are taken off the prompt."""

    name: str
    url: str
    token: str = ""
    timeout_s: float = 120

    def call(self, prompt: str, system: str | None = None) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": _DIRECTIVE.sub("", prompt)}]
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.name, "messages": messages, "stream": False}).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
            return json.load(r)["choices"][0]["message"]["content"]


def generate(model, prompt: str, system: str | None = None) -> str:
    return _THINK.sub("", model.call(prompt, system) or "").strip()


#: Analysers by the prefix of a model's name.
ENGINES: dict[str, Callable[[str], object]] = {"extractive": lambda name: ExtractiveAnalyser(name)}


def analyser(name: str):
    """The analyser of a model's name; a name that no engine knows is a mistake of the settings, and raises."""
    for prefix, make in ENGINES.items():
        if name.startswith(prefix):
            return make(name)
    raise ValueError(f"no engine for the model {name!r}; known prefixes: {', '.join(ENGINES)}")
