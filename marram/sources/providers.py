"""Models as providers, with stand-ins that give the same answer every time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
#: Prompts of one call of a batched provider.
PROMPTS = 16
_embedders: dict[str, Callable[[], Embedder]] = {}


def register_embedder(name: str, load: Callable[[], Embedder]) -> None:
    """``load`` makes the embedder, once per worker."""
    _embedders[name] = load


def hash_embedder(width: int = 64) -> Embedder:
    """Signed word hashes, scaled to length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(width)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1 if h >> 63 else -1
            length = math.sqrt(float(v @ v))
            out.append((v / length if length else v).tolist())
        return out

    return embed


register_embedder("hash", hash_embedder)


def embed(text: Column, name: str = "hash", batch: int = 64, prefix: str = "") -> Column:
    """Vectors of a text column (P19): the model loads once per worker and sees ``batch`` texts a call."""
    load = _embedders[name]

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            texts = [prefix + (t or "").strip() for t in s]
            yield pd.Series([v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])])

    return run(text)


def batched(provider: Callable) -> Callable:
    """Marks a provider that takes a list of prompts and gives a list of as many answers."""
    provider.batched = True
    return provider


def asked(provider: Callable, prompts: list, settings: dict | None = None, most: int = PROMPTS) -> list:
    """The provider's answers: of a batched one, at most ``most`` prompts a call; of another one, one by one."""
    settings = settings or {}
    if not getattr(provider, "batched", False):
        return [provider(p, **settings) for p in prompts]
    out: list = []
    for at in range(0, len(prompts), most):
        part = prompts[at : at + most]
        answers = list(provider(part, **settings))
        if len(answers) != len(part):
            raise ValueError(f"a provider gave {len(answers)} answers to {len(part)} prompts")
        out += answers
    return out


def answers(provider: Callable, prompt: Column, /, **settings) -> Column:
    """A provider's answers to a column of prompts."""
    run = F.pandas_udf(lambda prompts: pd.Series(asked(provider, prompts.tolist(), settings), dtype=object), "string")
    return run(prompt)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the query's words in the text: stands in for a cross-encoder."""
    out = []
    for query, text in pairs:
        q, t = set((query or "").lower().split()), set((text or "").lower().split())
        out.append(len(q & t) / len(q) if q else 0.0)
    return out
