"""Bounded samples of rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def sample_rows(table: DataFrame, wanted: DataFrame, column: str, rows: int) -> DataFrame:
    """Distinct rows of ``wanted``, which is a part of ``table``, by the hash of ``column``: of about ``rows`` rows of the
    whole table those that are wanted; of a table that has no more, all.

    The table is counted without reading a column, so Parquet answers from its footers, and ``wanted`` is read once.
    Each task keeps its part of the sample, so what reaches the driver doesn't grow with the table. Rows that repeat
    come once, so that a text with many copies can't swell the sample.
    """
    there = table.select().count()
    if there > rows:
        wanted = wanted.where(F.pmod(F.xxhash64(column), F.lit(_PARTS)) < int(_PARTS * rows / there))
    return wanted.dropDuplicates()


def sample_groups(table: DataFrame, group: str, wanted: DataFrame, column: str, rows: int) -> DataFrame:
    """The same with about ``rows`` rows of each group; groups are few. Counting reads the group's column only."""
    counts = {r[group]: r["n"] for r in table.groupBy(group).agg(F.count("*").alias("n")).collect()}
    parts = {g: int(_PARTS * min(1.0, rows / n)) for g, n in counts.items() if g is not None}
    if not parts:
        return wanted.dropDuplicates()
    most = F.create_map(*(F.lit(x) for item in parts.items() for x in item))[F.col(group)]
    return wanted.where(F.pmod(F.xxhash64(column), F.lit(_PARTS)) < most).dropDuplicates()
