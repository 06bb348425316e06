"""Text expressions; white space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the built-in encoders.
TOKEN = r"([0-9a-zà-ÿ]+)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.split(strip(c), r"(?U)\s+")


def word_count(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(words(c)))


def period_parts(c: Column) -> Column:
    """Parts of a cue: cut at white space after a full stop; a trailing empty part stays."""
    return F.split(c, r"(?U)(?<=\.)\s+", -1)


def sentence_parts(c: Column) -> Column:
    """Sentences of a text by terminators before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def suffix(path: Column) -> Column:
    """The last suffix of a path, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"[^/\\.](\.[^./\\]+)$", 1)


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(suffix(path) == "", name).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def or_unknown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise("unknown")


def content_id(*columns: Column) -> Column:
    """A repeatable id of a row's content, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns)), 256), 1, 32)


def fill_prompt(template: str, **slots: Column) -> Column:
    """The template with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, c in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out
