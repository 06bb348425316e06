"""Problem 8: mixes of sources with target shares of the tokens.

Systematic sampling. Within a source every document expects the same number of copies, target tokens over tokens
there are. Expected copies are summed up in an order of the documents, one random offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses. Ordered by size, each stretch of similar sizes gets
its share, so that tokens follow the target as closely as documents do.

The order is a rank that no single task makes: documents fall into buckets of (size class, hash), ranks within a bucket
are added to the counts of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.llm.tokens import count
from cuecraft.session import materialize

BUCKETS = 64
#: A plan of at most so many rows is broadcast.
PLAN_ROWS = 10_000
SEED = 20_260


def _name(column: str) -> Column:
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document, counted once and kept; sources without case or stray blanks."""
    rows = documents.select("doc_id", "text", _name("source").alias("source"))
    return materialize(count(rows, "doc_id", "text", "source", path=path))


def shares(plan: DataFrame, sizes: DataFrame, on_shortage: str = "shrink") -> DataFrame:
    """Per mix and source what is aimed at: ``mix_id, source, target_share, max_repeats, budget, available, goal, copies``.

    A source can give ``max_repeats`` times its tokens at most. Where that is less than its share of the budget,

    * ``shrink`` (default) makes the whole mix smaller until every source has its share: shares are exact, the budget
      is a bound;
    * ``fill`` leaves the source at its most and the others at their shares of the budget: shares deviate.

    Sources without tokens cannot contribute; the others' weights are taken relative to each other. Rows of the plan
    with null mix, source or a weight that is not positive are left out; repeated rows count once.
    """
    if on_shortage not in ("shrink", "fill"):
        raise ValueError(f"on_shortage: {on_shortage!r}")
    rows = plan.select("mix_id", _name("source").alias("source"), "target_weight", "max_repeats", "budget_frac").where(
        F.col("mix_id").isNotNull() & F.col("source").isNotNull() & (F.col("target_weight") > 0)
    )
    wanted = rows.groupBy("mix_id", "source").agg(
        F.max("target_weight").alias("target_weight"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"), F.min("budget_frac").alias("budget_frac")
    )
    # One row per source; the number of sources does not grow with their documents.
    tokens = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    all_tokens = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    mix = Window.partitionBy("mix_id")
    there = F.coalesce("available", F.lit(0))
    joined = (
        wanted.join(tokens, "source", "left")
        .withColumn("available", there)
        .withColumn("weight", F.when(there > 0, F.col("target_weight")).otherwise(0.0))
        .withColumn("target_share", F.col("weight") / F.nullif(F.sum("weight").over(mix), F.lit(0.0)))
        .withColumn("budget", F.floor(F.coalesce("budget_frac", F.lit(1.0)) * F.lit(all_tokens)))
        .withColumn("most", F.col("max_repeats") * F.col("available"))
    )
    if on_shortage == "shrink":
        whole = F.least(F.col("budget").cast("double"), F.min(F.when(F.col("target_share") > 0, F.col("most") / F.col("target_share"))).over(mix))
        goal = F.col("target_share") * whole
    else:
        goal = F.least(F.col("target_share") * F.col("budget"), F.col("most").cast("double"))
    return joined.withColumn("goal", F.coalesce(goal, F.lit(0.0))).select(
        "mix_id", "source", "target_weight", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", "budget", "available", "goal",
        F.when(F.col("available") > 0, F.least(F.col("goal") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("copies"),
    )


def sample(sizes: DataFrame, aims: DataFrame, seed: int = SEED) -> DataFrame:
    """The multiset: ``mix_id, doc_id, source, n_tokens, copies`` with one row for each document used in a mix.

    ``copies`` never exceeds ``max_repeats``: it is the expected number rounded up or down. Documents without tokens
    add nothing to a size and are not used. A document id that occurs on several rows counts as several documents.
    """
    docs = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select(
        "doc_id", "source", "n_tokens",
        F.floor(F.log2(F.col("n_tokens").cast("double")) * 8).cast("int").alias("size_class"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("source").orderBy("size_class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("source", "size_class", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("source", "size_class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "size_class", "bucket").orderBy("n_tokens", F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ranked = docs.join(starts, ["source", "size_class", "bucket"]).select(
        "doc_id", "source", "n_tokens", (F.col("ahead") + F.row_number().over(within)).alias("rank")
    )
    draws = aims.where("copies > 0").select(
        "mix_id", "source", F.col("copies").alias("rate"),
        (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1_000_003)) / 1_000_003.0).alias("offset"),
    )
    # A plan of usual size is broadcast, so that a source that holds most rows stays where it is.
    if draws.count() <= PLAN_ROWS:
        draws = F.broadcast(draws)
    # Rates that are whole up to rounding cross exactly that many integers everywhere.
    rate = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-12, F.round("rate")).otherwise(F.col("rate"))
    crossed = F.floor(F.col("rank") * rate + F.col("offset")) - F.floor((F.col("rank") - 1) * rate + F.col("offset"))
    return (
        ranked.join(draws, "source")
        .withColumn("copies", crossed.cast("int"))
        .where("copies > 0")
        .select("mix_id", "doc_id", "source", "n_tokens", "copies")
    )


def report(plan: DataFrame, sizes: DataFrame, on_shortage: str = "shrink", seed: int = SEED) -> DataFrame:
    """Per mix and source the target share and what the sample really holds.

    ``mix_id, source, target_share, actual_share, tokens, budget, budget_used, documents, copies, max_repeats, most_copies``;
    budget_used is the size of the whole mix over its budget. Sources that gave nothing have a row of zeros.
    """
    aims = shares(plan, sizes, on_shortage)
    taken = sample(sizes, aims, seed).groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"),
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = aims.select("mix_id", "source", "target_share", "budget", "max_repeats").join(taken, ["mix_id", "source"], "left")
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return rows.select(
        "mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        zero("tokens"), "budget", F.coalesce(whole / F.nullif("budget", F.lit(0)), F.lit(0.0)).alias("budget_used"),
        zero("documents"), zero("copies"), "max_repeats", zero("most_copies"),
    )
