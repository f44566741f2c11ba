"""Hooks for models: text and embedding providers as batched functions, one client a worker, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RETRIED = (408, 409, 425, 429, 500, 502, 503, 504)  # Fixed values: HTTP codes worth another try


def with_retries(call: Callable, attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, tried again after a growing, jittered wait where it raises something with a status in RETRIED."""

    def tried(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception as x:  # noqa: BLE001 - the status decides
                if getattr(x, "status", None) not in RETRIED or k + 1 == attempts:
                    raise
                sleep(base * 2**k * (1 + random.random()))

    return tried


def hashed_embedding(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """A bag of hashed words at length 1; the offline stand-in for an embedding model."""
    out = []
    for t in texts:
        v = np.zeros(dimension)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed(c: Column, client: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, batch: int = 64) -> Column:
    """Embeddings of a text column by a client that each worker makes once; null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client() if client else hashed_embedding
        for s in batches:
            out: list = [None] * len(s)
            places = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(places), batch):
                some = places[k : k + batch]
                for i, v in zip(some, ask([s.iloc[i] for i in some]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return run(c)


def generate(c: Column, client: Callable[[], Callable[[str], str]] | None = None) -> Column:
    """Replies to a prompt column; without a client the prompts' first lines, which keeps a pipeline whole offline."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = with_retries(client()) if client else lambda t: t.split("\n", 1)[0]
        for s in batches:
            yield s.map(lambda t: None if t is None else ask(t))

    return run(c)
