"""Plug-ins for language and embedding models, with deterministic defaults.

A summariser or embedder is any object with the method of the protocol. It is
created once per task by a factory, so clients and connections live as long as
the task; a limiter spaces its calls, and a failing call marks its row.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import PROMPTS


class Summarizer(Protocol):
    def summarize(self, prompt: str) -> str: ...


class ImageSummarizer(Protocol):
    def describe(self, prompt: str, image: str) -> str: ...


class Embedder(Protocol):
    model: str

    def embed(self, text: str) -> Any: ...


class Prefix:
    """The default summariser: the first ``size`` characters, stripped. Idempotent."""

    def __init__(self, size: int = 300) -> None:
        self.size = size

    def summarize(self, prompt: str) -> str:
        return prompt[: self.size].strip()


class HashedWords:
    """The default embedder: signed counts of hashed words, of length 1."""

    model = "hashed-words"

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.size
        for word in re.findall(r"[一-鿿぀-ヿ]|\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else []


class Limiter:
    """At most ``per_minute`` calls a minute from one task."""

    def __init__(self, per_minute: float | None) -> None:
        self.pause = 60 / per_minute if per_minute else 0.0
        self.next = 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.pause


def prompt_text(content: str, lang: str, collapse_all: bool = False) -> str:
    """The prompt for a text; an unknown language is an error."""
    if lang not in PROMPTS:
        raise ValueError(f"Unsupported language: {lang}")
    before, after = PROMPTS[lang]
    return before + (" ".join(content.split()) if collapse_all or lang == "zh" else content) + after


def route(client: Any, routes: dict[type, Callable[..., Any]], *args: Any) -> Any:
    """Call the function registered for the client's type; an unknown type is an error."""
    for kind, function in routes.items():
        if isinstance(client, kind):
            return function(client, *args)
    raise ValueError(f"Unsupported client: {type(client).__name__}")


IMAGE_LINK = re.compile(r"[^\s]+\.(jpg|jpeg|png|gif|bmp|webp)")


def image_prompt(link: str, lang: str = "zh") -> str:
    """Check an image link and make its prompt; a link of another kind is an error."""
    if not IMAGE_LINK.match(link):
        raise ValueError(f"Invalid image link: {link}")
    return prompt_text(link, lang)


def image_path(root: str, node: dict) -> str:
    """The file an image node points to, below ``root``; a node without a link, or a link of another kind, is an error."""
    try:
        link = node["c"][2][0]
    except (KeyError, IndexError, TypeError):
        raise ValueError(f"Invalid image node: {node}") from None
    if not isinstance(link, str) or not IMAGE_LINK.fullmatch(link):
        raise ValueError(f"Invalid image link: {link}")
    return posixpath.normpath(posixpath.join(root, link))


def vectors_of(payload: Any) -> list[list[float]] | None:
    """The vectors of a response: a list, a list of lists, or an object holding one; else null."""
    if not isinstance(payload, (list, dict)) and payload is not None:
        payload = getattr(payload, "embeddings", None) or getattr(payload, "embedding", None)
    if isinstance(payload, dict):
        payload = payload.get("embeddings") or payload.get("embedding")
    if not isinstance(payload, list) or not payload:
        return None
    if all(isinstance(x, list) for x in payload):
        return [[float(v) for v in x] for x in payload if x] or None
    return [[float(v) for v in payload]]


def embed_with_retry(embedder: Embedder, text: str) -> list[float] | None:
    """The first vector, asking once more if the first answer holds none."""
    for _ in range(2):
        if (found := vectors_of(embedder.embed(text))) is not None:
            return found[0]
    return None


def with_context(function: Callable[..., Any], context: Callable[..., str]) -> Callable[..., Any]:
    """Errors other than ``ValueError`` become one that names its context."""

    def call(*args: Any, **kwargs: Any) -> Any:
        try:
            return function(*args, **kwargs)
        except ValueError:
            raise
        except Exception as e:
            raise ValueError(f"{context(*args, **kwargs)}: {e}") from e

    return call


def summary_column(text: Column, lang: Column, factory: Callable[[], Summarizer] = Prefix, prompts: bool = False, per_minute: float | None = None) -> Column:
    """(summary, exception) of each text by a plug-in; null texts give null."""

    @F.pandas_udf("struct<summary:string,exception:string>")
    def summarise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model, limiter = factory(), Limiter(per_minute)
        for texts, langs in batches:
            out = []
            for x, k in zip(texts, langs):
                try:
                    limiter.wait()
                    out.append((None if x is None else model.summarize(prompt_text(x, k) if prompts else x), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["summary", "exception"])

    return summarise(text, lang)


def embedding_column(text: Column, factory: Callable[[], Embedder] = HashedWords, per_minute: float | None = None) -> Column:
    """The vector of each text, null for null and empty texts and where two tries give none."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, limiter = factory(), Limiter(per_minute)
        for texts in batches:
            out = []
            for x in texts:
                limiter.wait()
                out.append(embed_with_retry(model, x) if x else None)
            yield pd.Series(out, dtype=object)

    return embed(text)
