"""Entity queries. Vectors in order of their ids are the stream of mentions; users and event types stand for entities
and labels where only counts matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuecraft.operators import entities as en
from cuecraft.operators import ner
from cuecraft.operators.catalog import Catalog
from cuecraft.schema import ENTITY_LABELS, MERGE_THRESHOLD
from cuecraft.session import table

THRESHOLD = 0.30
#: Similarities are compared to so many digits, so that ties are the same in SQL.
DIGITS = 6
TABLES = ("chunks", "documents", "embeddings", "entities", "events", "mentions")
STOP_WORDS = ner.STOP_WORDS


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("dense"), "label")


def entity_leaders(spark: SparkSession, d: str) -> DataFrame:
    m = _stream(spark, d)
    return en.leaders(m, en.earlier_neighbours(m, "seq", "dense", THRESHOLD, DIGITS), "seq")


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return en.resolve(_stream(spark, d), THRESHOLD, digits=DIGITS)


def entity_resolution_strict(spark: SparkSession, d: str) -> DataFrame:
    return en.resolve(_stream(spark, d), MERGE_THRESHOLD, digits=DIGITS)


def extraction_counters(spark: SparkSession, d: str) -> DataFrame:
    return en.counters(entity_resolution(spark, d))


def entity_mode_label(spark: SparkSession, d: str) -> DataFrame:
    return en.first_mode(table(spark, d, "events"), "user_id", "event_type", "event_id", "label")


def entity_mode_name(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mentions").where("text IS NOT NULL AND label IS NOT NULL").select("seq", F.upper("label").alias("label"), F.lower("text").alias("text")).distinct()
    return en.first_mode(m, "label", "text", "seq", "name")


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    s = en.summaries(table(spark, d, "entities"), limit=100, include_aliases=True)
    return s.select("name", "label", "num_instances", F.array_join("aliases", "|").alias("aliases"))


def entity_summary_label(spark: SparkSession, d: str) -> DataFrame:
    return en.summaries(table(spark, d, "entities"), "CONCEPT", limit=20)


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return en.label_distribution(table(spark, d, "mentions").distinct())


def page_total(spark: SparkSession, d: str) -> DataFrame:
    return en.label_distribution(en.summaries(table(spark, d, "entities"), limit=50)).withColumn("total", F.sum("n").over(Window.partitionBy()))


def aliases_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("aliases"), F.count("*").alias("n"))


def candidate_entities(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mentions").where("text IS NOT NULL").distinct()
    return en.from_candidates(m).groupBy("name", "label").agg(F.sum(F.size("entity_instances")).cast("bigint").alias("n"))


def ner_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("entity_id", "name", "label")
    answer = F.format_string("1. %s | True | %s | named\n2. %s | False | %s | other\n3. %s | True | ==NONE== | no\nno line", "name", "label", "name", "label", "name")
    return e.select("entity_id", F.explode(ner.parse_answer(answer)).alias("s")).select("entity_id", "s.text", "s.label")


def language_examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", ner.language(F.col("text"), STOP_WORDS).alias("language"))


def collection_status(spark: SparkSession, d: str) -> DataFrame:
    counts = Catalog(spark, d).counts([f"{t}.parquet" for t in TABLES])
    return counts.select(F.regexp_replace("collection_name", r"\.parquet$", "").alias("collection_name"), "n")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """The stream of vectors as mentions with texts and labels."""
    v = _stream(spark, d)
    return v.select("seq", F.concat(F.lit("Name "), (F.col("seq") % 3).cast("string")).alias("text"), F.col("label").cast("string").alias("label"))


def entities_merged(spark: SparkSession, d: str) -> DataFrame:
    """The entities that resolution leaves, by the functions of the service."""
    merged = en.merge(en.resolve(_stream(spark, d), THRESHOLD, digits=DIGITS), _labelled(spark, d))
    return merged.select("entity", "name", "label", F.size("entity_instances").cast("bigint").alias("n"), F.array_join(F.transform("entity_instances", lambda i: F.concat(i["text"], F.lit("/"), i["label"])), "|").alias("instances"))


def entity_page(spark: SparkSession, d: str) -> DataFrame:
    page = en.entity_page(table(spark, d, "entities"), limit=60)
    return page.select("total", "limit", F.size("label_distribution").cast("bigint").alias("labels"), F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("names"))


def merge_payload(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label")
    updates = v.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    return en.merge_payload(v, updates, "vec_id")


def scroll_page(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(spark, d).scroll("embeddings.parquet", 20, 3, "vec_id").select("vec_id", "label")


_EDGES = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
edges AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id) WHERE score >= {THRESHOLD}),
nb AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, coalesce((SELECT list(src) FROM edges WHERE dst = vec_id), []) AS near FROM e),
r(rn, lead) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.rn, CASE WHEN list_has_any(r.lead, nb.near) THEN r.lead ELSE list_append(r.lead, nb.vec_id) END FROM r JOIN nb ON nb.rn = r.rn + 1),
leaders AS MATERIALIZED (SELECT unnest(lead) AS seq FROM r WHERE rn = (SELECT max(rn) FROM r)),
resolved AS (SELECT e.vec_id AS seq, coalesce(b.leader, e.vec_id) AS entity, b.leader IS NULL AS is_new FROM e LEFT JOIN (SELECT dst, first(src ORDER BY score DESC, src) AS leader FROM edges JOIN leaders ON leaders.seq = src GROUP BY dst) b ON b.dst = e.vec_id)"""
_LABELS = ", ".join(f"'{x}'" for x in ENTITY_LABELS)
_SUMMARY = "SELECT name, label, CAST(coalesce(len(entity_instances), 0) AS BIGINT) AS num_instances{more} FROM (SELECT * FROM entities {where} ORDER BY entity_id LIMIT {n})"

SQL = {
    "entities_merged": f"""WITH RECURSIVE {_EDGES}, m AS (SELECT r.entity, r.seq, 'name ' || (r.seq % 3) AS text, CAST(e.label AS VARCHAR) AS label FROM resolved r JOIN embeddings e ON e.vec_id = r.seq),
nm AS (SELECT entity, first(text ORDER BY c DESC, f) AS name FROM (SELECT entity, text, count(*) AS c, min(seq) AS f FROM m GROUP BY ALL) GROUP BY entity),
lb AS (SELECT entity, first(label ORDER BY c DESC, f) AS label FROM (SELECT entity, label, count(*) AS c, min(seq) AS f FROM m GROUP BY ALL) GROUP BY entity)
SELECT entity, name, label, n, instances FROM (SELECT entity, count(*) AS n, string_agg(text || '/' || label, '|' ORDER BY seq) AS instances FROM m GROUP BY entity) JOIN nm USING (entity) JOIN lb USING (entity)""",
    "entity_page": """SELECT count(*) AS total, 60 AS "limit", count(DISTINCT label) AS labels, string_agg(name, '|' ORDER BY label, n DESC, name) AS names
 FROM (SELECT name, label, coalesce(len(entity_instances), 0) AS n FROM (SELECT * FROM entities ORDER BY entity_id LIMIT 60))""",
    "entity_leaders": f"WITH RECURSIVE {_EDGES} SELECT seq FROM leaders",
    "entity_resolution": f"WITH RECURSIVE {_EDGES} SELECT * FROM resolved",
    "entity_resolution_strict": f"WITH RECURSIVE {_EDGES.replace(f'score >= {THRESHOLD}', f'score >= {MERGE_THRESHOLD}')} SELECT * FROM resolved",
    "extraction_counters": f"WITH RECURSIVE {_EDGES} SELECT count(*) AS extracted, count(*) FILTER (is_new) AS new_entities, count(*) FILTER (NOT is_new) AS merged FROM resolved",
    "entity_mode_label": "SELECT user_id, first(event_type ORDER BY n DESC, f) AS label FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id",
    "entity_mode_name": "SELECT label, first(text ORDER BY n DESC, f) AS name FROM (SELECT label, text, count(*) AS n, min(seq) AS f FROM (SELECT DISTINCT seq, upper(label) AS label, lower(text) AS text FROM mentions WHERE text IS NOT NULL AND label IS NOT NULL) GROUP BY ALL) GROUP BY label",
    "entity_summary": _SUMMARY.format(more=", CASE WHEN len(entity_instances) > 0 THEN array_to_string(list_sort(list_distinct(list_transform(entity_instances, lambda i: i.text))), '|') END AS aliases", where="", n=100),
    "entity_summary_label": _SUMMARY.format(more="", where="WHERE label = 'CONCEPT'", n=20),
    "label_distribution": "SELECT label, count(*) AS n FROM (SELECT DISTINCT * FROM mentions) GROUP BY label",
    "page_total": "SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM (SELECT * FROM entities ORDER BY entity_id LIMIT 50) GROUP BY label",
    "aliases_sorted": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS aliases, count(*) AS n FROM events GROUP BY user_id",
    "candidate_entities": "SELECT lower(text) AS name, label, count(*) AS n FROM (SELECT DISTINCT * FROM mentions WHERE text IS NOT NULL) GROUP BY ALL",
    "ner_parse": f"SELECT entity_id, lower(name) AS text, label FROM entities WHERE label IN ({_LABELS})",
    "language_examples": "WITH w AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+') AS w FROM documents), c AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in words)}))) AS n_{lang}" for lang, words in STOP_WORDS.items())
    + " FROM w) SELECT doc_id, CASE WHEN greatest(n_de, n_en, n_fr, n_es) = 0 THEN 'en' WHEN n_de >= greatest(n_en, n_fr, n_es) THEN 'de' WHEN n_en >= greatest(n_fr, n_es) THEN 'en' WHEN n_fr >= n_es THEN 'fr' ELSE 'es' END AS language FROM c",
    "collection_status": " UNION ALL ".join(f"SELECT '{t}' AS collection_name, count(*) AS n FROM {t}" for t in TABLES),
    "merge_payload": "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN coalesce(label + 100, label) ELSE label END AS INT) AS label FROM embeddings",
    "scroll_page": "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20",
}
QUERIES = {name: globals()[name] for name in SQL}
