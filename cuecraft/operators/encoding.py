"""Encoders: texts to dense, sparse and multi-vectors, one row for a row, without a shuffle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuecraft.functions.text import TOKEN

PARTS = {"dense": "array<double>", "sparse": "map<string,double>", "colbert": "array<array<double>>"}
_ARROW = {"dense": pa.list_(pa.float64()), "sparse": pa.map_(pa.string(), pa.float64()), "colbert": pa.list_(pa.list_(pa.float64()))}
_TOKEN = re.compile(TOKEN)


class Encoder(Protocol):
    """What a model has to offer: ``key`` and the wanted parts of the encoding of ``text``, other columns left out."""

    def encode(self, df: DataFrame, key: str, text: str, parts: Sequence[str]) -> DataFrame: ...


class HashEncoder:
    """Deterministic stand-in: lexical weights are term frequencies to length one, dense vectors signed feature hashes of
    them, multi-vectors one hashed vector for each distinct token in order."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, df: DataFrame, key: str, text: str, parts: Sequence[str] = tuple(PARTS)) -> DataFrame:
        """Null texts count as empty. A text without tokens has an empty map and list, and no dense vector."""
        size, kind = self.size, df.schema[key].dataType.simpleString()

        def run(batches):
            place = lru_cache(maxsize=200_000)(lambda t: _place(t, size))
            for batch in batches:
                counts = [Counter(_TOKEN.findall((t or "").lower())) for t in batch.column(1).to_pylist()]
                made = {"dense": lambda: [_dense(c, place, size) for c in counts], "sparse": lambda: [_sparse(c) for c in counts], "colbert": lambda: [_each(c, place, size) for c in counts]}
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[p](), type=_ARROW[p]) for p in parts)], names=[key, *parts])

        return df.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{p} {PARTS[p]}" for p in parts)]))


def _place(token: str, size: int) -> tuple[int, float]:
    h = int(md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return h % size, 1.0 if h // size % 2 == 0 else -1.0


def _dense(counts: Counter, place, size: int) -> np.ndarray | None:
    out = np.zeros(size)
    for token, n in counts.items():
        slot, sign = place(token)
        out[slot] += sign * n
    return out if out.any() else None


def _sparse(counts: Counter) -> list[tuple[str, float]]:
    length = sum(n * n for n in counts.values()) ** 0.5
    return [(t, n / length) for t, n in counts.items()]


def _each(counts: Counter, place, size: int) -> list[np.ndarray]:
    out = []
    for token in counts:
        slot, sign = place(token)
        v = np.zeros(size)
        v[slot] = sign
        out.append(v)
    return out
