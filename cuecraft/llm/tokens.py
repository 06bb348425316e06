"""Problem 7: encoding of whole texts with a public tokenizer, and decoding back.

The vocabulary file is a parameter; it is read by path on every executor and never copied. Encoding runs in Arrow
batches, one native thread per task. Empty and null texts give an empty list of ids; strings that look like special
tokens are ordinary text. With ``spans``, each token comes with the characters it covers: byte-level tokens may split a
character, and then both halves name it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.llm.arrow import map_arrow
from cuecraft.session import worker_threads

#: Folder of the public tokenizers; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("CUECRAFT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
_CHARS_AT_ONCE = 300_000


def vocabulary(name: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def load(path: str):
    worker_threads()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def encode_texts(texts: list[str | None], path: str, take: Callable, offsets: bool = False) -> list:
    """What ``take`` makes of the encoding of each text; null counts as empty. Offsets are worked out only if asked for.

    Native calls get a bounded number of characters at once, and their encodings are let go after each.
    """
    tokenizer, out, part, size = load(path), [], [], 0
    batch = tokenizer.encode_batch if offsets else getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size > _CHARS_AT_ONCE:
            out += [take(x) for x in batch(part, add_special_tokens=False)]
            part, size = [], 0
    return out + ([take(x) for x in batch(part, add_special_tokens=False)] if part else [])


def _int_list(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    parts = [np.asarray(x, dtype=np.int32) for x in lists]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)))


def encode(df: DataFrame, key: str, text: str, path: str | None = None, spans: bool = False) -> DataFrame:
    """``key, ids`` of every row, with ``spans`` also ``starts`` and ``ends`` (code points, end exclusive).

    One row out for a row in, whatever the text: null and empty texts get empty lists, repeated rows stay, an empty
    table stays empty. Other columns are not read.
    """
    path = path or vocabulary()
    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def parts(x) -> tuple:
        ids = np.array(x.ids, dtype=np.int32)
        return (ids, [a for a, _ in x.offsets], [b for _, b in x.offsets]) if spans else (ids,)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [key, "ids"] + (["starts", "ends"] if spans else [])
        found = encode_texts(batch.column(1).to_pylist(), path, parts, spans)
        columns = [batch.column(0), *(_int_list([x[i] for x in found]) for i in range(len(names) - 1))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["_k"].dataType.simpleString()
    extra = ", starts array<int>, ends array<int>" if spans else ""
    return map_arrow(source, run, f"`{key}` {kind}, ids array<int>{extra}")


def count(df: DataFrame, key: str, text: str, *carry: str, path: str | None = None) -> DataFrame:
    """``key, n_tokens`` and the ``carry`` columns of every row; null and empty texts have 0 tokens."""
    path = path or vocabulary()
    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pa.array(encode_texts(batch.column(1).to_pylist(), path, len), type=pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, *batch.columns[2:]], names=[key, "n_tokens", *carry])

    fields = [(key, source.schema["_k"])] + [("n_tokens", None)] + [(c, source.schema[f"_c{i}"]) for i, c in enumerate(carry)]
    return map_arrow(source, run, ", ".join(f"`{n}` {f.dataType.simpleString() if f else 'int'}" for n, f in fields))


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others are counted on from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def bytes_of_ids(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_of_character()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode_ids(ids: list[int] | None, path: str, errors: str = "replace") -> str:
    """The text of the ids. Bytes of all tokens are joined before they are decoded, so characters split between tokens
    come back whole; half characters at a cut give the replacement character."""
    table = bytes_of_ids(path)
    return b"".join(table[i] if 0 <= i < len(table) else b"" for i in ids or ()).decode("utf-8", errors)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """``key, text`` of every row; null ids give an empty text."""
    path = path or vocabulary()
    source = df.select(F.col(key).alias("_k"), F.col(ids).alias("_i"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [decode_ids(x, path) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    return map_arrow(source, run, f"`{key}` {source.schema['_k'].dataType.simpleString()}, text string")
