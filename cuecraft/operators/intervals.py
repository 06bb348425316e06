"""Problem 6: continuous periods and gaps of overlapping intervals per entity.

Starts and ends are ranked independently of each other. The period that holds the k-th end closes there exactly when the
next-ranked start exceeds it, which is when as many ends as starts lie at or before that moment. So both sorted lists are
walked as one list of moments with two running counts. An entity that holds a large share of all rows is spread over its
time slices:

1. the moments are shuffled once, by (entity, slice), and counted there; counts and ranks read the same shuffle;
2. each slice is sorted on its own, and ranks within it are added to the counts of the slices before it, which need one
   row per slice;
3. edges of periods alternate between opening and closing, so each is paired with the next one: within the slice, or the
   first of the next slice that has one, which again needs one row per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.functions.timefmt import HOUR_US
from cuecraft.session import materialize, shuffle_width

#: Length of a slice; a lecture of two hours is spread over a dozen.
SLICE_US = HOUR_US // 6


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, max_gap_us: int | None = HOUR_US, slice_us: int = SLICE_US) -> DataFrame:
    """Maximal covered stretches and the gaps between successive ones.

    Input: any rows; ``entity`` of any type, ``start`` and ``end`` BIGINT. Other columns, whatever their names, are
    not read. Rows with a null or empty entity, a null bound, or an end not after the start count for nothing. Rows
    that touch are continuous. An empty input gives an empty result.

    Output: ``entity, kind, start_us, end_us``; kind is ``period`` or ``gap``. Gaps longer than ``max_gap_us`` are
    left out (None keeps all); a gap of exactly that length stays.
    """
    rows = df.select(F.col(entity).alias("_e"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_t")).where(
        F.col("_e").isNotNull() & (F.trim(F.col("_e").cast("string")) != "") & (F.col("_t") > F.col("_s"))
    )
    bound = F.explode(F.array(F.struct(F.col("_s").alias("at"), F.lit(1).alias("s")), F.struct(F.col("_t").alias("at"), F.lit(0).alias("s"))))
    moments = (
        rows.select("_e", bound.alias("b"))
        .select("_e", F.floor(F.col("b.at") / slice_us).alias("slice"), "b.at", F.col("b.s").cast("bigint").alias("s"))
        .where("slice IS NOT NULL")  # as the join below asks for, so that both its sides read one shuffle
        .repartition(shuffle_width(df.sparkSession), "_e", "slice")
        .groupBy("_e", "slice", "at").agg(F.sum("s").alias("n_s"), F.sum(1 - F.col("s")).alias("n_e"))
    )
    # Counts of starts and ends before each slice, of one row per slice.
    before = Window.partitionBy("_e").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        moments.groupBy("_e", "slice")
        .agg(F.sum("n_s").alias("s"), F.sum("n_e").alias("e"))
        .select("_e", "slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"))
    )
    within = Window.partitionBy("_e", "slice").orderBy("at")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        moments.join(slices, ["_e", "slice"])
        .withColumn("rank_s", F.col("s0") + F.sum("n_s").over(upto))
        .withColumn("rank_e", F.col("e0") + F.sum("n_e").over(upto))
    )
    # Before this moment all were closed: a start opens a period. At it all are closed: an end closes one.
    opens = (F.col("rank_s") - F.col("n_s") == F.col("rank_e") - F.col("n_e")) & (F.col("n_s") > 0)
    closes = F.col("rank_s") == F.col("rank_e")
    # Edges are few, two for a period.
    edges = materialize(
        ranked.select("_e", "slice", "at", opens.alias("opens"), closes.alias("closes")).where("opens or closes")
        .select("_e", "slice", "at", "opens", F.lead("at").over(within).alias("next"))
    )
    after = Window.partitionBy("_e").orderBy("slice")
    firsts = edges.groupBy("_e", "slice").agg(F.min("at").alias("at")).select("_e", "slice", F.lead("at").over(after).alias("beyond"))
    last = edges.where("next IS NULL").join(firsts, ["_e", "slice"]).select("_e", "at", "opens", F.col("beyond").alias("next"))
    paired = edges.where("next IS NOT NULL").select("_e", "at", "opens", "next").unionByName(last.where("next IS NOT NULL"))
    out = paired.select("_e", F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("at").alias("start_us"), F.col("next").alias("end_us"))
    if max_gap_us is not None:
        out = out.where((F.col("kind") == "period") | (F.col("end_us") - F.col("start_us") <= max_gap_us))
    return out.select(F.col("_e").alias(entity), "kind", "start_us", "end_us")
