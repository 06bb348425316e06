"""Numbers of rows within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, *order: str, name: str = "no") -> DataFrame:
    """The rows with their number in the group, from 1, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
