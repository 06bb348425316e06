"""Exact self-join of vectors by cosine, in cells around pivots.

Pivots are a bounded sample of the vectors. Every vector lies in the cell of its nearest pivot. Two cells can hold a similar
pair only if the angle between their pivots is at most the sum of their radii and the angle of the threshold (triangle
inequality). Cells are cut into blocks of a bounded size, and only blocks of such cells meet, each two as one matrix
product. What a product holds is bounded by two blocks, the driver sees one row a cell, and equal vectors are joined once,
by their first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.session import materialize

#: Pivots at most, and vectors of a block.
PIVOTS, BLOCK = 1_024, 2_000
_SLACK = 1e-9


def with_vector_key(rows: DataFrame, seq: str, vector: str) -> DataFrame:
    """``seq, v, h``: vectors to length one and a key that equal ones share; both null for null, empty and zero vectors."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = rows.select(F.col(seq).cast("bigint").alias(seq), F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).alias("v"))
    return unit.select(seq, "v", F.sha2(F.to_json(F.struct("v")), 256).alias("h")).select(seq, "v", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"))


def distinct_vectors(rows: DataFrame, seq: str, vector: str) -> DataFrame:
    """``h, rep, v``: vectors to length one, each once, under its first ``seq``."""
    keyed = with_vector_key(rows, seq, vector).where("h IS NOT NULL")
    return keyed.groupBy("h").agg(F.min(seq).alias("rep"), F.first("v").alias("v"))


def similar_pairs(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``a, b, score`` with ``a < b`` of all pairs of ``rep, v`` (length one) whose cosine is at least the threshold."""
    vectors = materialize(vectors.select("rep", "v"))
    there = vectors.count()
    spark = vectors.sparkSession
    if there < 2:
        return spark.createDataFrame([], "a bigint, b bigint, score double")
    wanted = min(pivots, max(1, math.isqrt(there) // 2))
    picked = vectors.orderBy(F.xxhash64("rep")).limit(wanted).select("v").collect()  # ``pivots`` rows at most
    held = spark.sparkContext.broadcast(np.array([r["v"] for r in picked], dtype=np.float64))

    def place(batches):
        p = held.value
        for pdf in batches:
            m = np.array(pdf["v"].tolist(), dtype=np.float64)
            if not len(m):
                continue
            s = np.clip(m @ p.T, -1.0, 1.0)
            cell = s.argmax(axis=1)
            yield pd.DataFrame({"rep": pdf["rep"], "v": pdf["v"], "cell": cell.astype(np.int32), "angle": np.arccos(s[np.arange(len(m)), cell])})

    placed = materialize(vectors.mapInPandas(place, "rep bigint, v array<double>, cell int, angle double"))
    # Cells by size, cut at random into blocks; a hot cell has many. One row a cell comes to the driver.
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    between = np.arccos(np.clip(held.value @ held.value.T, -1.0, 1.0))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + _SLACK
    parts = {c: -(-r["n"] // block) for c, r in cells.items()}
    near = [(x, parts[x], y, parts[y]) for x in cells for y in cells if x == y or between[x, y] <= cells[x]["radius"] + cells[y]["radius"] + reach]
    table = spark.createDataFrame(near, "cell int, own int, other int, parts int")  # the square of the pivots at most
    part = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")
    sent = placed.select("rep", "v", "cell").join(F.broadcast(table), "cell").select("rep", "v", "cell", part.alias("part"), "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("there"))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("there").alias("p"))
    sent = sent.select("rep", "v", "cell", "part", F.struct(F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b")).alias("meet"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        """One meeting: a block with itself, or two blocks."""
        side = pdf["cell"].to_numpy().astype(np.int64) * (1 << 32) + pdf["part"].to_numpy()
        first = side == side.min()
        reps = pdf["rep"].to_numpy()
        m = np.array(pdf["v"].tolist(), dtype=np.float64)
        one, two = (m, m) if first.all() else (m[first], m[~first])
        s = one @ two.T
        i, j = np.nonzero(s >= threshold - 1e-12)
        x, y = (reps[i], reps[j]) if first.all() else (reps[first][i], reps[~first][j])
        keep = x < y if first.all() else np.ones(len(x), dtype=bool)
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": s[i, j][keep]})

    return sent.groupBy("meet").applyInPandas(product, "a bigint, b bigint, score double")
