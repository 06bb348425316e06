"""Joins to lookup tables: broadcast up to a counted size, salted shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lookup of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
SALTS = 32


def lookup_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``left`` to the narrow lookup ``right``, which has at most one row for a key.

    The lookup is counted first. A larger one is joined by shuffle: its rows are repeated once per salt, so that a
    key that holds a large share of ``left`` is spread over ``SALTS`` tasks, and rows without key skip the join.
    """
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), key, "left")
    salted = left.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The planner's estimate doesn't see that rows are repeated, and takes millions of them for a small table: without
    # the hint it may send them all through the driver to broadcast them.
    joined = salted.join(repeated.hint("merge"), [key, "_salt"], "left").drop("_salt")
    rest = left.where(F.col(key).isNull())
    for field in right.schema.fields:
        if field.name != key:
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return joined.unionByName(rest.select(joined.columns))


def pick_join(large: DataFrame, picked: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a large table with the rows that were picked from it, such as hits. They are kept and counted first;
    up to ``broadcast_rows`` the large table isn't shuffled."""
    from cuecraft.session import materialize

    picked = materialize(picked)
    return large.join(F.broadcast(picked) if picked.count() <= broadcast_rows else picked, key)
