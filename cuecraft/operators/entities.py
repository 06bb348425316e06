"""Entity resolution and entity analytics.

Resolution by similarity: a mention becomes a new entity if no earlier entity's vector reaches the threshold, else it
joins the most similar one that already exists. In order of arrival that is a sequential process; the entities are the
lexicographically first maximal independent set of the similarity graph, which a few parallel rounds find. The graph is
one of distinct vectors: a repeated vector never creates an entity, as its first one did or joined one that is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.functions.text import content_id
from cuecraft.operators.neighbours import distinct_vectors, similar_pairs, with_vector_key
from cuecraft.schema import MERGE_THRESHOLD
from cuecraft.session import materialize


def _rounded(pairs: DataFrame, threshold: float, digits: int | None) -> DataFrame:
    return pairs if digits is None else pairs.withColumn("score", F.round("score", digits)).where(F.col("score") >= threshold)


def earlier_neighbours(mentions: DataFrame, seq: str, vector: str, threshold: float, digits: int | None = None) -> DataFrame:
    """Pairs of similar mentions with different vectors, in order: ``src`` before ``dst``, ``score`` at least the
    threshold. Equal vectors are represented by the first mention that has them. ``digits`` rounds scores first."""
    least = threshold if digits is None else threshold - 0.5 * 10.0**-digits
    pairs = _rounded(similar_pairs(distinct_vectors(mentions, seq, vector), least), threshold, digits)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score")


def leaders(mentions: DataFrame, edges: DataFrame, seq: str, fixed: str = "false") -> DataFrame:
    """Mentions that create an entity: ``seq``. Rounds go on until every mention is decided; those of ``fixed``, a condition
    on ``node``, are entities already."""
    # 0 undecided, 1 leader, 2 follower
    edges = materialize(edges)
    state = materialize(mentions.select(F.col(seq).cast("bigint").alias("node")).distinct().withColumn("state", F.when(F.expr(fixed), 1).otherwise(0)))
    while True:
        known = edges.join(state.select(F.col("node").alias("src"), F.col("state").alias("src_state")), "src")
        seen = known.groupBy(F.col("dst").alias("node")).agg(
            F.max((F.col("src_state") == 1).cast("int")).alias("has_leader"), F.max((F.col("src_state") == 0).cast("int")).alias("waits")
        )
        decided = F.when(F.coalesce("has_leader", F.lit(0)) == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        state = materialize(state.join(seen, "node", "left").select("node", F.when(F.col("state") == 0, decided).otherwise(F.col("state")).alias("state")))
        if state.where("state = 0").isEmpty():
            return state.where("state = 1").select(F.col("node").alias(seq))


def resolve(mentions: DataFrame, threshold: float = MERGE_THRESHOLD, seq: str = "seq", vector: str = "dense", digits: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """The entity of every mention: ``seq, entity, is_new``; an entity is named by the mention that created it.

    ``known`` has entities that are there already, with a ``seq`` below 0; mentions come from 0 on.

    Equal similarities go to the earlier entity. Mentions without a vector, or with a zero one, create entities of their
    own; so do mentions whose own vector is equal to none above 1, if the threshold is beyond it.
    """
    there = mentions.select(seq, vector) if known is None else mentions.select(seq, vector).unionByName(known.select(seq, vector))
    vectors = materialize(distinct_vectors(there, seq, vector))
    least = threshold if digits is None else threshold - 0.5 * 10.0**-digits
    edges = materialize(_rounded(similar_pairs(vectors, least), threshold, digits))
    lead = materialize(leaders(vectors.select("rep"), edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score"), "rep", "false" if known is None else "node < 0"))
    # Every entity near a vector, whichever came first, and the entity of the vector itself.
    both = edges.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "score").unionByName(edges.select(F.col("b").alias("leader"), F.col("a").alias("rep"), "score"))
    near = both.join(lead.select(F.col("rep").alias("leader")), "leader").unionByName(lead.select(F.col("rep").alias("leader"), "rep", F.lit(1.0).alias("score")))
    # The entities near one vector; they are dissimilar to each other, so few fit around it.
    steps = near.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("leader", "score"))).alias("near"))
    rows = mentions.select(F.col(seq).cast("bigint").alias(seq), F.col(vector).alias("_v")).dropDuplicates([seq])
    hashed = with_vector_key(rows, seq, "_v")
    known = vectors.select("h", "rep").join(steps, "rep").select("h", "near")
    joined = hashed.join(known, "h", "left")
    earlier = F.filter("near", lambda x: x["leader"] < F.col(seq))
    best = F.element_at(F.array_sort(F.transform(earlier, lambda x: F.struct((-x["score"]).alias("s"), x["leader"].alias("leader")))), 1)
    chosen = F.when(F.size(earlier) > 0, best["leader"])
    return joined.select(seq, F.coalesce(chosen, F.col(seq)).alias("entity"), chosen.isNull().alias("is_new"))


def counters(resolved: DataFrame) -> DataFrame:
    """One row: mentions extracted, entities new, mentions merged."""
    return resolved.agg(
        F.count("*").alias("extracted"), F.coalesce(F.sum(F.col("is_new").cast("bigint")), F.lit(0)).alias("new_entities"),
        F.coalesce(F.sum((~F.col("is_new")).cast("bigint")), F.lit(0)).alias("merged"),
    )


def first_mode(df: DataFrame, group: str, value: str, order: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first. Null counts as a value."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(name))


def merge(resolved: DataFrame, mentions: DataFrame, seq: str = "seq") -> DataFrame:
    """Entities after all mentions: ``entity, name, label, entity_instances``, as ``summaries`` takes them. Texts are
    lower-case, instances in order of arrival; name and label are the most frequent ones, of equally frequent ones the
    first. Mentions need ``text, label`` and may have ``loc``. The instances of one entity are one row, as they are stored.
    """
    place = F.col("loc") if "loc" in mentions.columns else F.lit(None).cast("string")
    rows = resolved.select(seq, "entity").join(mentions.select(seq, F.lower("text").alias("text"), "label", place.alias("loc")), seq)
    name, label = first_mode(rows, "entity", "text", seq, "name"), first_mode(rows, "entity", "label", seq, "label")
    listed = F.sort_array(F.collect_list(F.struct(seq, F.struct("text", "label", "loc").alias("i"))))
    instances = rows.groupBy("entity").agg(F.transform(listed, lambda x: x["i"]).alias("entity_instances"))
    return instances.join(name, "entity").join(label, "entity").select("entity", "name", "label", "entity_instances")


def in_order(mentions: DataFrame, order: str) -> DataFrame:
    """``seq`` from 0 in the order of ``order``, with ``text`` (lower case), ``label`` and ``loc``. Numbers are counted up over sorted
    partitions, so that no task holds all mentions."""
    kept = materialize(mentions.select(F.col(order).alias("_o"), F.lower("text").alias("text"), "label", "loc").orderBy("_o").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = kept.groupBy("_p").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("ahead"))
    within = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "_p").select((F.col("ahead") + within).cast("bigint").alias("seq"), "text", "label", "loc")


def stored_after(stored: DataFrame, mentions: DataFrame, resolved: DataFrame, vectors: DataFrame) -> DataFrame:
    """The entity collection after ``resolved`` mentions: stored entities (with their ``seq`` below 0) keep id and vector and
    take their new instances behind the old ones; new entities get the vector of the mention that made them."""
    old = stored.select(F.col("seq").alias("entity"), F.posexplode("entity_instances").alias("at", "i")).select("entity", F.lit(0).alias("late"), F.col("at").cast("bigint").alias("at"), "i.text", "i.label", F.col("i.location").alias("loc"))
    new = resolved.join(mentions, "seq").select("entity", F.lit(1).alias("late"), F.col("seq").alias("at"), "text", "label", "loc")
    every = materialize(old.unionByName(new))
    # Rows of an entity in order, as one number for the modes: old instances come first.
    numbered = every.withColumn("no", F.col("late").cast("bigint") * (1 << 40) + F.col("at"))
    name, label = first_mode(numbered, "entity", "text", "no", "name"), first_mode(numbered, "entity", "label", "no", "label")
    listed = F.sort_array(F.collect_list(F.struct("no", F.struct("text", "label", F.col("loc").alias("location")).alias("i"))))  # an entity is one row
    made = numbered.groupBy("entity").agg(F.transform(listed, lambda x: x["i"]).alias("entity_instances")).join(name, "entity").join(label, "entity")
    fresh = made.where("entity >= 0").join(vectors.select(F.col("seq").alias("entity"), "dense"), "entity").select(content_id(F.col("entity"), F.col("name"), F.col("entity_instances")).alias("id"), "name", "label", "entity_instances", "dense")
    kept = stored.select("id", F.col("seq").alias("entity"), F.col("name").alias("_n"), F.col("label").alias("_l"), "dense", F.col("entity_instances").alias("_i")).join(made.where("entity < 0"), "entity", "left")
    kept = kept.select("id", F.coalesce("name", "_n").alias("name"), F.coalesce("label", "_l").alias("label"), F.coalesce("entity_instances", "_i").alias("entity_instances"), "dense")
    return kept.unionByName(fresh.withColumn("dense", F.col("dense").cast("array<float>")))


def from_candidates(mentions: DataFrame) -> DataFrame:
    """A mention as an entity of one instance: ``name, label, entity_instances``."""
    return mentions.select(F.lower("text").alias("name"), "label", F.array(F.struct(F.lower("text").alias("text"), "label", "loc")).alias("entity_instances"))


def summaries(entities: DataFrame, label: str | None = None, limit: int = 100, include_aliases: bool = False) -> DataFrame:
    """A page of the entity list: ``name, label, num_instances[, aliases]``, sorted by label, size (largest first), name.

    The page is taken first, by id, and sorted then. A null list counts as none and has null aliases.
    """
    if not 1 <= limit <= 100_000:
        raise ValueError(f"limit must be between 1 and 100000, not {limit}")
    page = entities if label is None else entities.where(F.col("label") == label)
    page = page.orderBy("entity_id").limit(limit)
    n = F.coalesce(F.size("entity_instances"), F.lit(0)).cast("bigint")
    aliases = F.when(n > 0, F.sort_array(F.array_distinct(F.transform("entity_instances", lambda i: i["text"]))))
    columns = ["name", "label", n.alias("num_instances")] + ([aliases.alias("aliases")] if include_aliases else [])
    return page.select(*columns).orderBy("label", F.desc("num_instances"), "name")


def label_distribution(page: DataFrame) -> DataFrame:
    return page.groupBy("label").agg(F.count("*").alias("n"))


def merge_payload(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The table with the payload of the updates, by key; columns that an update leaves null, and all vectors, stay."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in changed))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns))


def entity_page(entities: DataFrame, label: str | None = None, limit: int = 100, include_aliases: bool = False) -> DataFrame:
    """The whole answer of the entity list in one row: ``total, limit, include_aliases, label_distribution, entities``."""
    page = summaries(entities, label, limit, include_aliases)
    order = F.struct("label", (-F.col("num_instances")).alias("size"), "name", F.struct(*page.columns).alias("e"))
    # ``limit`` rows at most.
    one = page.agg(F.count("*").alias("total"), F.transform(F.sort_array(F.collect_list(order)), lambda x: x["e"]).alias("entities"), F.collect_list("label").alias("labels"))
    counts = F.map_from_entries(F.transform(F.array_distinct("labels"), lambda x: F.struct(x, F.size(F.filter("labels", lambda y: y == x)))))
    return one.select("total", F.lit(limit).alias("limit"), F.lit(include_aliases).alias("include_aliases"), counts.alias("label_distribution"), "entities")
