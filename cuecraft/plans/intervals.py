"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions.timefmt import parse_offset
from cuecraft.operators.intervals import periods_and_gaps
from cuecraft.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "video_locations").select(
        "lecture_id", parse_offset(F.col("start_time")).alias("s"), parse_offset(F.col("end_time")).alias("t")
    )
    return periods_and_gaps(rows, "lecture_id", "s", "t")


_OFFSET = """CASE WHEN regexp_full_match({c}, '\\s*(?:(-?\\d+) days?, )?(\\d+):([0-5]\\d):([0-5]\\d)(?:[.,](\\d{{1,6}}))?\\s*') THEN
 (coalesce(try_cast(nullif(regexp_extract({c}, '(-?\\d+) days?, ', 1), '') AS BIGINT), 0) * 86400
 + try_cast(regexp_extract({c}, '(\\d+):[0-5]\\d:[0-5]\\d', 1) AS BIGINT) * 3600
 + try_cast(regexp_extract({c}, '\\d+:([0-5]\\d):[0-5]\\d', 1) AS BIGINT) * 60
 + try_cast(regexp_extract({c}, '\\d+:[0-5]\\d:([0-5]\\d)', 1) AS BIGINT)) * 1000000
 + coalesce(try_cast(rpad(nullif(regexp_extract({c}, ':[0-5]\\d[.,](\\d{{1,6}})', 1), ''), 6, '0') AS BIGINT), 0) END"""

QUERIES = {"p6_found": p6_found}
SQL = {
    "p6_found": f"""
WITH r AS (SELECT lecture_id, {_OFFSET.format(c='start_time')} AS s, {_OFFSET.format(c='end_time')} AS t FROM video_locations),
v AS (SELECT * FROM r WHERE lecture_id IS NOT NULL AND trim(lecture_id) <> '' AND t > s),
m AS (SELECT *, max(t) OVER (PARTITION BY lecture_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS no FROM m),
p AS (SELECT lecture_id, no, min(s) AS s, max(t) AS t FROM g GROUP BY ALL)
SELECT lecture_id, 'period' AS kind, s AS start_us, t AS end_us FROM p
UNION ALL
SELECT lecture_id, 'gap', t, nxt FROM (SELECT *, lead(s) OVER (PARTITION BY lecture_id ORDER BY no) AS nxt FROM p) WHERE nxt - t <= 3600000000
"""
}
