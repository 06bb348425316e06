"""Search queries: dense, sparse and multi-vector, fusion, reranking and prompts. Query sets are all rows whose id is
divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions.windows import numbered
from cuecraft.operators import rag
from cuecraft.operators import retrieval as rt
from cuecraft.operators.chunking import payload
from cuecraft.operators.joins import pick_join
from cuecraft.session import table

K, POOL, SIMILAR = 5, 50, 0.35
#: Scores are compared to so many digits, so that ties are the same in SQL.
DIGITS = 6


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


def _vector_queries(v: DataFrame) -> DataFrame:
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "dense")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rt.dense_topk(_vector_queries(v), v, K, digits=DIGITS)


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rt.dense_topk(_vector_queries(v), v.where("label = 3"), K, digits=DIGITS)


def entity_search_top1(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other row of every query: all rows are searched, and the query's own is left out."""
    v = _vectors(spark, d)
    hits = rt.dense_topk(_vector_queries(v), v, 2, digits=DIGITS).where("id <> query_id")
    return rt.top_per(hits.drop("rank"), "query_id", "score", "id", 1).select("query_id", "id", "score")


def similarity_threshold_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rt.similar(_vector_queries(v), v, SIMILAR, DIGITS)


def _multi(v: DataFrame) -> DataFrame:
    """Documents of ten consecutive vectors each."""
    return v.select(F.floor(F.col("id") / 10).alias("doc"), (F.col("id") % 10).alias("no"), F.col("dense").alias("vec"), "id")


def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    m = _multi(_vectors(spark, d)).groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "vec"))), lambda x: x["vec"]).alias("colbert"))  # ten at most
    return rt.maxsim_search(m.where("doc % 20 = 0").select(F.col("doc").alias("query_id"), "colbert"), m.select(F.col("doc").alias("id"), "colbert"), K, digits=DIGITS)


def candidate_union_maxsim(spark: SparkSession, d: str) -> DataFrame:
    m = _multi(_vectors(spark, d))
    lists = []
    for no in (0, 1):
        q = m.where(f"doc % 20 = 0 AND no = {no}").select(F.col("doc").alias("query_id"), F.col("vec").alias("dense"))
        hits = rt.dense_topk(q, m.select("id", F.col("vec").alias("dense")), POOL, digits=DIGITS)
        lists.append(hits.select("query_id", F.floor(F.col("id") / 10).alias("id")))
    queries = m.where("doc % 20 = 0").select(F.col("doc").alias("query_id"), "no", "vec")
    return rt.maxsim_topk(rt.candidates(lists), queries, m.select(F.col("doc").alias("id"), "no", "vec"), K)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "ask_log").where("ask_id % 20 = 0 AND question IS NOT NULL")
    return asked.select(F.col("ask_id").alias("query_id"), F.col("question").alias("text")).distinct()


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return rt.sparse_topk(rt.sparse_weights(_questions(spark, d), "query_id", "text"), rt.sparse_weights(_documents(spark, d), "id", "text"), K, digits=DIGITS)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return rt.search(_questions(spark, d), _documents(spark, d), "hybrid", K, pool=POOL, digits=DIGITS)


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    def sparse(q, c, limit, pool, digits):
        return rt.sparse_topk(q, c, limit, digits=digits)

    return rt.search(_questions(spark, d), _documents(spark, d), sparse, K, True, POOL, digits=DIGITS)


def context_prompt(spark: SparkSession, d: str) -> DataFrame:
    hits = pick_join(_documents(spark, d), sparse_topk(spark, d), "id")
    return rag.prompts(_questions(spark, d), hits)


def json_answer_fallback(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "ask_log").select("ask_id", "answer").distinct()
    return asked.select("ask_id", rag.parse_answer(F.col("answer")).alias("a")).select("ask_id", "a.answer", F.round("a.confidence_score", 6).alias("confidence_score"))


def payload_projection(spark: SparkSession, d: str) -> DataFrame:
    c = payload(table(spark, d, "chunks").select("chunk_id", "text", "loc"))
    place = F.when(F.col("course_id").isNotNull() & F.col("lecture_id").isNotNull(), F.concat_ws("/", "course_id", "lecture_id"))
    return c.select("chunk_id", F.col("text").alias("content"), place.alias("place"), "start_time", "end_time").distinct()


def running_rank(spark: SparkSession, d: str) -> DataFrame:
    """Position of every question in its course by time of asking."""
    rows = table(spark, d, "ask_log").select("ask_id", "course_id", "asked_at").distinct().where("course_id IS NOT NULL")
    return numbered(rows, "course_id", "asked_at", "ask_id").select("ask_id", "course_id", "no")


def lecture_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found by the questions, with their places."""
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text", "loc.course_id", "loc.lecture_id", "loc.start_us", "loc.end_us").where("text IS NOT NULL").dropDuplicates(["id"])
    hits = rt.sparse_topk(rt.sparse_weights(_questions(spark, d), "query_id", "text"), rt.sparse_weights(c, "id", "text"), K, digits=DIGITS)
    found = rt.lecture_items(hits, c)
    return found.select("query_id", "rank", "score", "text", "video_location.course_id", "video_location.lecture_id", "video_location.start_time", "video_location.end_time")


_COS = "round(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))), 6)"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_TOP = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({s})) WHERE rank <= {k}"
_DENSE = f"SELECT q.id AS query_id, v.id AS id, {_COS.format(a='q.e', b='v.e')} AS score FROM v q, v WHERE q.id % 20 = 0"
_QD = """q AS (SELECT DISTINCT ask_id AS query_id, question AS text FROM ask_log WHERE ask_id % 20 = 0 AND question IS NOT NULL),
d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL),
qt AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+')) AS token FROM q) GROUP BY ALL),
dt AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+')) AS token FROM d) GROUP BY ALL),
qw AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS w FROM qt),
dw AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM dt),
sp AS (SELECT query_id, id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (token) GROUP BY ALL)"""
_HASH = """({t}_v AS (SELECT {k}, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN tf ELSE -tf END)::DOUBLE AS x FROM (SELECT *, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h FROM {t}) GROUP BY ALL)"""


def _hash(t: str, k: str) -> str:
    return _HASH.format(t=t, k=k)[1:]


_CLOCK = """CASE WHEN {x} IS NOT NULL THEN (CASE WHEN {x} // 86400000000 = 0 THEN '' ELSE printf('%d day', {x} // 86400000000) || (CASE WHEN {x} // 86400000000 = 1 THEN '' ELSE 's' END) || ', ' END)
 || printf('%d:%02d:%02d', ({x} % 86400000000) // 3600000000, ({x} % 3600000000) // 60000000, ({x} % 60000000) // 1000000)
 || (CASE WHEN {x} % 1000000 = 0 THEN '' ELSE printf('.%06d', {x} % 1000000) END) END"""
_CHUNK_HITS = """q AS (SELECT DISTINCT ask_id AS query_id, question AS text FROM ask_log WHERE ask_id % 20 = 0 AND question IS NOT NULL),
d AS (SELECT DISTINCT chunk_id AS id, text, loc.course_id AS course_id, loc.lecture_id AS lecture_id, loc.start_us AS s, loc.end_us AS e FROM chunks WHERE text IS NOT NULL),
qt AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+')) AS token FROM q) GROUP BY ALL),
dt AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+')) AS token FROM d) GROUP BY ALL),
qw AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS w FROM qt),
dw AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM dt),
sp AS (SELECT query_id, id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (token) GROUP BY ALL)"""

SQL = {
    "lecture_hits": f"WITH {_CHUNK_HITS}, h AS (" + _TOP.format(s="SELECT * FROM sp", k=K) + ") SELECT query_id, rank, score, text, "
    + ", ".join(f"CASE WHEN course_id IS NOT NULL AND lecture_id IS NOT NULL THEN {x} END AS {n}" for x, n in (("course_id", "course_id"), ("lecture_id", "lecture_id"), (_CLOCK.format(x="s"), "start_time"), (_CLOCK.format(x="e"), "end_time")))
    + " FROM h JOIN d USING (id)",
    "dense_topk": f"WITH {_V} " + _TOP.format(s=_DENSE, k=K),
    "dense_topk_filtered": f"WITH {_V} " + _TOP.format(s=_DENSE + " AND v.label = 3", k=K),
    "entity_search_top1": f"WITH {_V} SELECT query_id, id, score FROM (" + _TOP.format(s=_DENSE + " AND v.id <> q.id", k=1) + ")",
    "similarity_threshold_pairs": f"WITH {_V} SELECT * FROM ({_DENSE}) WHERE score >= {SIMILAR}",
    "maxsim_topk": f"WITH {_V}, s AS (SELECT q.id // 10 AS query_id, q.id AS q, v.id // 10 AS id, max({_COS.format(a='q.e', b='v.e')}) AS best FROM v q, v WHERE (q.id // 10) % 20 = 0 GROUP BY ALL) "
    + _TOP.format(s="SELECT query_id, id, round(sum(best), 6) AS score FROM s GROUP BY ALL", k=K),
    "candidate_union_maxsim": f"WITH {_V}, s AS (SELECT q.id AS qv, v.id AS dv, {_COS.format(a='q.e', b='v.e')} AS score FROM v q, v WHERE (q.id // 10) % 20 = 0), "
    f"c AS (SELECT DISTINCT qv // 10 AS query_id, dv // 10 AS id FROM (SELECT *, row_number() OVER (PARTITION BY qv ORDER BY score DESC, dv) AS rn FROM s WHERE qv % 10 < 2) WHERE rn <= {POOL}), "
    "e AS (SELECT a.id AS qv, b.id AS dv, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS x FROM v a, v b WHERE (a.id // 10) % 20 = 0), "
    "m AS (SELECT c.query_id, c.id, e.qv, max(e.x) AS best FROM c JOIN e ON e.qv // 10 = c.query_id AND e.dv // 10 = c.id GROUP BY ALL) "
    + _TOP.format(s="SELECT query_id, id, round(sum(best), 6) AS score FROM m GROUP BY ALL", k=K),
    "sparse_topk": f"WITH {_QD} " + _TOP.format(s="SELECT * FROM sp", k=K),
    "rrf_hybrid": f"WITH {_QD}, {_hash('qt', 'query_id')}, {_hash('dt', 'id')}, "
    "ql AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qt_v GROUP BY ALL), dl AS (SELECT id, sqrt(sum(x * x)) AS n FROM dt_v GROUP BY ALL), "
    "de AS (SELECT query_id, id, round(sum(a.x * b.x) / (any_value(ql.n) * any_value(dl.n)), 6) + 0.0 AS score FROM ql JOIN dl ON ql.n > 0 AND dl.n > 0 JOIN qt_v a USING (query_id) JOIN dt_v b USING (id) WHERE a.slot = b.slot GROUP BY ALL "
    "UNION ALL SELECT query_id, id, 0.0 FROM ql JOIN dl ON ql.n > 0 AND dl.n > 0 WHERE NOT EXISTS (SELECT 1 FROM qt_v a JOIN dt_v b USING (slot) WHERE a.query_id = ql.query_id AND b.id = dl.id)), "
    f"l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sp UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM de) "
    + _TOP.format(s=f"SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rn)), 9) AS score FROM l WHERE rn <= {POOL} GROUP BY ALL", k=K),
    "rerank_topk": f"WITH {_QD}, h AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sp) WHERE rn <= {POOL}), "
    "qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL), dn AS (SELECT id, sum(tf) AS n FROM dt GROUP BY ALL), "
    "o AS (SELECT h.query_id, h.id, count(*) AS n FROM h JOIN qt USING (query_id) JOIN dt ON dt.id = h.id AND dt.token = qt.token GROUP BY ALL) "
    + _TOP.format(s="SELECT o.query_id, o.id, round((o.n / qn.n) / (1.0::DOUBLE + dn.n / 1000.0::DOUBLE), 6) AS score FROM o JOIN qn USING (query_id) JOIN dn USING (id)", k=K),
    "context_prompt": f"WITH {_QD}, h AS (" + _TOP.format(s="SELECT * FROM sp", k=K) + "), c AS (SELECT query_id, string_agg(rank || ': ' || d.text, chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN d USING (id) GROUP BY ALL) "
    "SELECT q.query_id, replace(replace('" + rag.PROMPT.replace("'", "''") + "', '{question}', q.text), '{context}', c.context) AS prompt FROM q LEFT JOIN c USING (query_id)",
    "json_answer_fallback": f"""SELECT DISTINCT ask_id,
 CASE WHEN answer IS NULL THEN '{rag.NO_HITS_ANSWER}' WHEN NOT (json_valid(answer) AND regexp_matches(answer, '^\\s*\\{{')) THEN '{rag.UNREADABLE_ANSWER}' ELSE coalesce(json_extract_string(answer, '$.answer'), '') END AS answer,
 CASE WHEN answer IS NULL OR NOT (json_valid(answer) AND regexp_matches(answer, '^\\s*\\{{')) THEN 0.0::DOUBLE ELSE coalesce(round(try_cast(json_extract_string(answer, '$.confidence_score') AS DOUBLE), 6), 0.0) END AS confidence_score
 FROM ask_log""",
    "payload_projection": """SELECT DISTINCT chunk_id, text AS content, CASE WHEN loc.course_id IS NOT NULL AND loc.lecture_id IS NOT NULL THEN loc.course_id || '/' || loc.lecture_id END AS place,
 """ + ", ".join(f"""CASE WHEN loc.{c}_us IS NOT NULL THEN (CASE WHEN loc.{c}_us // 86400000000 = 0 THEN '' ELSE printf('%d day', loc.{c}_us // 86400000000) || (CASE WHEN loc.{c}_us // 86400000000 = 1 THEN '' ELSE 's' END) || ', ' END)
 || printf('%d:%02d:%02d', (loc.{c}_us % 86400000000) // 3600000000, (loc.{c}_us % 3600000000) // 60000000, (loc.{c}_us % 60000000) // 1000000)
 || (CASE WHEN loc.{c}_us % 1000000 = 0 THEN '' ELSE printf('.%06d', loc.{c}_us % 1000000) END) END AS {c}_time""" for c in ("start", "end")) + " FROM chunks",
    "running_rank": "SELECT ask_id, course_id, row_number() OVER (PARTITION BY course_id ORDER BY asked_at, ask_id) AS no FROM (SELECT DISTINCT ask_id, course_id, asked_at FROM ask_log WHERE course_id IS NOT NULL)",
}
QUERIES = {name: globals()[name] for name in SQL}
