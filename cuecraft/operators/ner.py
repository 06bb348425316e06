"""Annotation of concepts: prompt, answer lines, a gazetteer stand-in and retries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuecraft.schema import ENTITY_LABELS

#: ``{index}. {text} | {True|False} | {LABEL} | {reason}``
LINE = r"(?m)^\s*\d+\.\s*(.+?)\s*\|\s*(True|False)\s*\|\s*(\S+)\s*\|.*$"
NO_LABEL = "==NONE=="


# Stop words of the stand-in language detection.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "wir", "für"), "en": ("the", "and", "is", "of", "we", "that", "for", "not"),
    "fr": ("le", "la", "les", "et", "est", "que", "nous", "pour"), "es": ("el", "los", "y", "es", "que", "en", "para", "una"),
}


def prompt_head(definitions: dict[str, str], examples: list[dict]) -> str:
    lines = ["Name the concepts of the text, one in a line: number. words | True or False | label | reason.", f"Labels: {', '.join(definitions)}."]
    lines += [f"{label}: {meaning}" for label, meaning in definitions.items()]
    for example in examples:
        lines += ["", f"Text: {example['text']}"]
        lines += [f"{i}. {s['text']} | {s['is_entity']} | {s['label']} | {s['reason']}" for i, s in enumerate(example["spans"], 1)]
    return "\n".join([*lines, "", "Text: "])


def prompt(definitions: dict[str, str], examples: list[dict], text: Column) -> Column:
    """The annotation prompt: labels with their meanings, worked examples, then the text of the row."""
    return F.concat(F.lit(prompt_head(definitions, examples)), text)


def parse_answer(answer: Column, labels: tuple[str, ...] = ENTITY_LABELS) -> Column:
    """Accepted spans of an annotator's answer: an array of ``text, label`` in line order; other lines are left out."""
    part = lambda i: F.regexp_extract_all(answer, F.lit(LINE), F.lit(i))
    rows = F.arrays_zip(part(1).alias("text"), part(2).alias("ok"), part(3).alias("label"))
    kept = F.filter(rows, lambda r: (r["ok"] == "True") & r["label"].isin(*labels))
    return F.transform(kept, lambda r: F.struct(F.lower(r["text"]).alias("text"), r["label"].alias("label")))


def annotated(chunks: DataFrame, annotator: Callable[[str], list[tuple[str, str]]], attempts: int = 3) -> DataFrame:
    """The chunks with ``spans`` (array of ``text, label``) in place of their text, and ``failed``: the error of the last
    attempt if all of them failed, else null. All other columns ride along."""
    rest = [f for f in chunks.schema if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]))), T.StructField("failed", T.StringType())])
    span = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, failed = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                error = None
                for _ in range(attempts):
                    try:
                        found = annotator(text or "")
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        continue
                    error = None
                    break
                spans.append([] if error else [{"text": s.lower(), "label": label} for s, label in found])
                failed.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, type=span), pa.array(failed, type=pa.string())], names=[f.name for f in schema])

    return chunks.select(*(f.name for f in rest), "text").mapInArrow(run, schema)


def mentions(spans: DataFrame, *carry: str) -> DataFrame:
    """One row a span: ``order`` (the carried columns and the number in the chunk), ``text, label, loc``."""
    rows = spans.select(*spans.columns, F.posexplode("spans").alias("_at", "_s"))
    return rows.select(F.struct(*(c for c in carry if c != "loc"), F.col("_at")).alias("order"), F.col("_s.text").alias("text"), F.col("_s.label").alias("label"), "loc")


def failures(spans: DataFrame) -> int:
    """How many chunks no attempt could annotate."""
    return spans.where("failed IS NOT NULL").count()


def annotate(chunks: DataFrame, annotator: Callable[[str], list[tuple[str, str]]], attempts: int = 3) -> DataFrame:
    """Mentions of all chunks: ``chunk_id, no, text, label, loc``. A chunk whose annotation fails ``attempts`` times gives
    none; ``annotated`` tells which. The annotator is a function of the text; repeated chunks give their mentions each."""
    rows = annotated(chunks.select("chunk_id", "loc", "text"), annotator, attempts).select("chunk_id", "loc", F.posexplode("spans").alias("no", "s"))
    return rows.select("chunk_id", "no", "s.text", "s.label", "loc")


def chat_annotator(chat: Callable[[str], str], definitions: dict[str, str], examples: list[dict], labels: tuple[str, ...] = ENTITY_LABELS) -> Callable[[str], list[tuple[str, str]]]:
    """An annotator that asks a chat model by the prompt and reads its answer's lines."""
    head, line = prompt_head(definitions, examples), re.compile(LINE)
    return lambda text: [(m[1].lower(), m[3]) for m in line.finditer(chat(head + text)) if m[2] == "True" and m[3] in labels]


def head_language(chunks: DataFrame, order: str, text: str, stop_words: dict[str, tuple[str, ...]] | None = None) -> str:
    """The language of the first two chunks, by the stand-in detection."""
    head = chunks.orderBy(order).limit(2).select(text).collect()
    joined = " ".join(r[0] or "" for r in head)
    one = chunks.sparkSession.createDataFrame([(joined,)], "t string").select(language(F.col("t"), stop_words or STOP_WORDS).alias("l")).first()
    return one["l"]


def gazetteer(names: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """Stand-in annotator: the longest names of a list that occur in the text as whole words, left to right."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)", re.I) if names else None
    labels = {n.casefold(): label for n, label in names.items()}
    return lambda text: [(m[0], labels[m[0].casefold()]) for m in pattern.finditer(text)] if pattern else []


def language(text: Column, stop_words: dict[str, tuple[str, ...]], default: str = "en") -> Column:
    """Stand-in language detection: the language with most stop words in the text, the default where none has any."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    hits = lambda stop: F.size(F.filter(words, lambda w: w.isin(*stop)))
    counts = [F.struct(hits(stop).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, stop) in enumerate(stop_words.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"]).otherwise(default)
