"""Chunking queries. Cues are the video chunks in order of their ids; texts are the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions import text as tx
from cuecraft.functions.timefmt import hms, srt_time
from cuecraft.operators import chunking as ch
from cuecraft.schema import MAX_CHUNK_FUNCTION
from cuecraft.session import table
from cuecraft.sources import files

MIN, MAX = 350, 400
#: The maximum of the whole pipeline.
FULL_MAX = MAX_CHUNK_FUNCTION


def cues(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("loc.kind = 'video' AND loc.lecture_id IS NOT NULL AND text IS NOT NULL")
    return c.select("loc.lecture_id", F.col("chunk_id").alias("seq"), "loc.start_us", "loc.end_us", F.col("text").alias("content")).distinct()


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(tx.period_parts(F.col("text"))).alias("part", "content"))


def cue_split_timed(spark: SparkSession, d: str) -> DataFrame:
    return ch.split_cues(cues(spark, d))


def sentence_islands(spark: SparkSession, d: str) -> DataFrame:
    return ch.islands(ch.split_cues(cues(spark, d)))


def grow_min_size(spark: SparkSession, d: str) -> DataFrame:
    return ch.grow(sentence_islands(spark, d), MIN)


def grow_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ch.grow(sentence_islands(spark, d), MIN, True)


def split_oversize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    none = F.lit(None).cast("bigint")
    rows = docs.select(F.lit("").alias("lecture_id"), F.col("doc_id").alias("chunk_no"), none.alias("start_us"), none.alias("end_us"), F.col("text").alias("content"))
    return ch.halve_oversized(rows, MAX).select(F.col("chunk_no").alias("doc_id"), "piece_no", "content")


def chunk_srt_full(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunk_cues(cues(spark, d))


def sentence_groups(spark: SparkSession, d: str) -> DataFrame:
    return ch.sentence_groups(table(spark, d, "documents"), "doc_id", "text")


def chunk_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text IS NOT NULL").select("chunk_id", "lang", "text").distinct()
    return c.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(tx.word_count(F.col("text"))).cast("bigint").alias("words"))


def timestamp_hms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "loc.start_us").distinct()
    return c.select("chunk_id", hms(F.col("start_us")).alias("hms"), srt_time(F.col("start_us") / 1_000_000).alias("srt"))


def srt_compose(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d).where("start_us IS NOT NULL")
    return files.srt_lines(c.select("lecture_id", "seq", (F.col("start_us") / 1_000_000).alias("start_s"), (F.col("end_us") / 1_000_000).alias("end_s"), F.col("content").alias("text")))


def suffix_dispatch(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ingest_requests").select("request_id", "srt_file").distinct()
    return r.select("request_id", tx.suffix(F.col("srt_file")).alias("suffix"), tx.stem(F.col("srt_file")).alias("stem"), files.by_suffix(F.col("srt_file")).alias("reader"), tx.or_unknown(F.col("srt_file")).alias("file"))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    packed = files.pack(F.filter(F.transform(F.split("text", "\n\n"), tx.strip), lambda b: b != ""), 120)
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "content"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_CUES = "cues AS (SELECT DISTINCT loc.lecture_id AS lecture_id, chunk_id AS seq, loc.start_us AS start_us, loc.end_us AS end_us, text AS content FROM chunks WHERE loc.kind = 'video' AND loc.lecture_id IS NOT NULL AND text IS NOT NULL)"
_PARTS = f"""{_CUES}, pa AS (SELECT *, string_split(regexp_replace(content, '\\.{_WS}+', '.' || chr(1), 'g'), chr(1)) AS arr FROM cues),
pb AS (SELECT lecture_id, seq, start_us, end_us, content AS whole, len(arr) AS n, unnest(arr) AS content, generate_subscripts(arr, 1) - 1 AS part FROM pa),
pc AS (SELECT *, CAST(round_even((end_us - start_us) / greatest(length(whole), 1), 0) AS BIGINT) AS per FROM pb),
pd AS (SELECT *, start_us + CAST(sum(per * length(content)) OVER (PARTITION BY lecture_id, seq ORDER BY part) AS BIGINT) AS reached FROM pc),
parts AS (SELECT lecture_id, seq, part, CASE WHEN part = 0 THEN start_us ELSE reached - per * length(content) END AS start_us, CASE WHEN part = n - 1 THEN end_us ELSE reached END AS end_us, content FROM pd)"""
_BLOCKS = f"""{_PARTS}, pe AS (SELECT *, CAST(coalesce(sum(CASE WHEN content LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY seq, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_no FROM parts),
blocks AS (SELECT lecture_id, block_no, first(start_us ORDER BY seq, part) AS start_us, last(end_us ORDER BY seq, part) AS end_us, string_agg(content, ' ' ORDER BY seq, part) AS content FROM pe GROUP BY ALL)"""
_GROWN = f"""{_BLOCKS}, bl AS MATERIALIZED (SELECT lecture_id, block_no, length(content) AS n FROM blocks),
r(lecture_id, block_no, chunk_no, size) AS (SELECT lecture_id, block_no, 0::BIGINT, n FROM bl WHERE block_no = 0
 UNION ALL SELECT bl.lecture_id, bl.block_no, CASE WHEN r.size > {MIN} THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.size > {MIN} THEN bl.n ELSE r.size + 1 + bl.n END
 FROM r JOIN bl ON bl.lecture_id = r.lecture_id AND bl.block_no = r.block_no + 1),
grown AS (SELECT b.lecture_id, r.chunk_no, min(b.block_no) AS first_block, max(b.block_no) AS last_block, first(start_us ORDER BY b.block_no) AS start_us, last(end_us ORDER BY b.block_no) AS end_us, string_agg(content, ' ' ORDER BY b.block_no) AS content
 FROM blocks b JOIN r ON r.lecture_id = b.lecture_id AND r.block_no = b.block_no GROUP BY b.lecture_id, r.chunk_no)"""

_OVERLAPPED = """SELECT g.lecture_id, g.chunk_no, g.first_block, g.last_block, CASE WHEN p.block_no IS NULL THEN g.start_us ELSE p.start_us END AS start_us, CASE WHEN n.block_no IS NULL THEN g.end_us ELSE n.end_us END AS end_us,
 coalesce(p.content || ' ', '') || g.content || coalesce(' ' || n.content, '') AS content FROM grown g
 LEFT JOIN blocks p ON p.lecture_id = g.lecture_id AND p.block_no = g.first_block - 1 LEFT JOIN blocks n ON n.lecture_id = g.lecture_id AND n.block_no = g.last_block + 1"""
_FULL = f"""WITH RECURSIVE {_GROWN}, ov AS MATERIALIZED ({_OVERLAPPED}),
h(lecture_id, chunk_no, pos, txt, a, b, w) AS (SELECT lecture_id, chunk_no, 0::BIGINT, content, start_us, end_us, list_filter(string_split_regex(content, '{_WS}+'), lambda x: x <> '') FROM ov
 UNION ALL SELECT lecture_id, chunk_no, pos + CASE WHEN side = 0 THEN 0 ELSE len(w) // 2 END, CASE WHEN side = 0 THEN lt ELSE array_to_string(w[len(w) // 2 + 1:], ' ') END,
  CASE WHEN side = 0 THEN a ELSE mid END, CASE WHEN side = 0 THEN mid ELSE b END, CASE WHEN side = 0 THEN w[1:len(w) // 2] ELSE w[len(w) // 2 + 1:] END
 FROM (SELECT *, array_to_string(w[1:len(w) // 2], ' ') AS lt, a + CAST(round_even((b - a) * (length(array_to_string(w[1:len(w) // 2], ' '))::DOUBLE / length(txt)), 0) AS BIGINT) AS mid FROM h WHERE length(txt) > {FULL_MAX} AND len(w) > 1), (VALUES (0), (1)) s(side))
SELECT lecture_id, chunk_no, CAST(row_number() OVER (PARTITION BY lecture_id, chunk_no ORDER BY pos) - 1 AS INT) AS piece_no, a AS start_us, b AS end_us, {_strip('txt')} AS text FROM h WHERE NOT (length(txt) > {FULL_MAX} AND len(w) > 1)"""

SQL = {
    "chunk_srt_full": _FULL,
    "page_blocks": f"""WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS arr FROM documents WHERE text IS NOT NULL),
u AS MATERIALIZED (SELECT doc_id, unnest(arr) AS t, generate_subscripts(arr, 1) AS i FROM b), s AS MATERIALIZED (SELECT doc_id, i, t, len(string_split_regex(t, '{_WS}+')) AS n FROM u),
r(doc_id, i, no, n) AS (SELECT doc_id, i, 0::BIGINT, n FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.n + s.n <= 120 THEN r.no ELSE r.no + 1 END, CASE WHEN r.n + s.n <= 120 THEN r.n + s.n ELSE s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT s.doc_id, CAST(r.no AS INT) AS chunk_no, string_agg(s.t, chr(10) ORDER BY s.i) AS content FROM s JOIN r ON r.doc_id = s.doc_id AND r.i = s.i GROUP BY s.doc_id, r.no""",
    "sentence_split": f"SELECT doc_id, unnest(arr) AS content, generate_subscripts(arr, 1) - 1 AS part FROM (SELECT doc_id, string_split(regexp_replace(text, '\\.{_WS}+', '.' || chr(1), 'g'), chr(1)) AS arr FROM documents WHERE text IS NOT NULL)",
    "cue_split_timed": f"WITH {_PARTS} SELECT * FROM parts",
    "sentence_islands": f"WITH {_BLOCKS} SELECT * FROM blocks",
    "grow_min_size": f"WITH RECURSIVE {_GROWN} SELECT * FROM grown",
    "grow_overlap": f"""WITH RECURSIVE {_GROWN} SELECT g.lecture_id, g.chunk_no, g.first_block, g.last_block, CASE WHEN p.block_no IS NULL THEN g.start_us ELSE p.start_us END AS start_us, CASE WHEN n.block_no IS NULL THEN g.end_us ELSE n.end_us END AS end_us,
 coalesce(p.content || ' ', '') || g.content || coalesce(' ' || n.content, '') AS content FROM grown g
 LEFT JOIN blocks p ON p.lecture_id = g.lecture_id AND p.block_no = g.first_block - 1 LEFT JOIN blocks n ON n.lecture_id = g.lecture_id AND n.block_no = g.last_block + 1""",
    "split_oversize": f"""WITH RECURSIVE h(doc_id, pos, txt, w) AS (SELECT doc_id, 0::BIGINT, text, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, pos + CASE WHEN side = 0 THEN 0 ELSE len(w) // 2 END, array_to_string(CASE WHEN side = 0 THEN w[1:len(w) // 2] ELSE w[len(w) // 2 + 1:] END, ' '), CASE WHEN side = 0 THEN w[1:len(w) // 2] ELSE w[len(w) // 2 + 1:] END
 FROM h, (VALUES (0), (1)) s(side) WHERE length(txt) > {MAX} AND len(w) > 1)
SELECT doc_id, txt AS content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS piece_no FROM h WHERE NOT (length(txt) > {MAX} AND len(w) > 1)""",
    "sentence_groups": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS arr FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(arr) AS t, generate_subscripts(arr, 1) - 1 AS i FROM s) SELECT doc_id, i // 5 AS group_no, string_agg(t, ' ' ORDER BY i) AS text FROM u GROUP BY doc_id, i // 5""",
    "chunk_stats_by_lang": f"""SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN {_strip('text')} = '' THEN 0 ELSE len(string_split_regex({_strip('text')}, '{_WS}+')) END) AS BIGINT) AS words
 FROM (SELECT DISTINCT chunk_id, lang, text FROM chunks WHERE text IS NOT NULL) GROUP BY lang""",
    "timestamp_hms": """SELECT DISTINCT chunk_id, CASE WHEN loc.start_us IS NOT NULL THEN printf('%02d:%02d:%02d', loc.start_us // 3600000000, loc.start_us // 60000000 % 60, loc.start_us // 1000000 % 60) END AS hms,
 CASE WHEN loc.start_us IS NOT NULL THEN printf('%02d:%02d:%02d,%03d', loc.start_us // 3600000000, loc.start_us // 60000000 % 60, loc.start_us // 1000000 % 60, loc.start_us // 1000 % 1000) END AS srt FROM chunks""",
    "srt_compose": f"""WITH {_CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY seq) AS no FROM cues WHERE start_us IS NOT NULL), t AS (SELECT *, coalesce(end_us, start_us) AS e FROM n)
SELECT lecture_id, no, no || chr(10) || printf('%02d:%02d:%02d,%03d', start_us // 3600000000, start_us // 60000000 % 60, start_us // 1000000 % 60, start_us // 1000 % 1000) || ' --> '
 || printf('%02d:%02d:%02d,%03d', e // 3600000000, e // 60000000 % 60, e // 1000000 % 60, e // 1000 % 1000) || chr(10) || {_strip('content')} || chr(10) AS cue FROM t""",
    "suffix_dispatch": """SELECT DISTINCT request_id, coalesce(regexp_extract(srt_file, '[^/\\\\.](\\.[^./\\\\]+)$', 1), NULL) AS suffix,
 CASE WHEN regexp_extract(srt_file, '[^/\\\\.](\\.[^./\\\\]+)$', 1) = '' THEN regexp_extract(srt_file, '([^/\\\\]*)$', 1) ELSE regexp_extract(regexp_extract(srt_file, '([^/\\\\]*)$', 1), '^(.*)\\.[^.]*$', 1) END AS stem,
 CASE regexp_extract(srt_file, '(\\.[^./\\\\]+)$', 1) WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pages' WHEN '.srt' THEN 'subtitles' END AS reader, CASE WHEN coalesce(srt_file, '') = '' THEN 'unknown' ELSE srt_file END AS file FROM ingest_requests""",
}
QUERIES = {name: globals()[name] for name in SQL}
