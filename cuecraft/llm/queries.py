"""Queries of the training-data operators, and SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.llm import garbled, langid, linking, mixing, pairs, splitting, tokens
from cuecraft.llm.sentences import sentences
from cuecraft.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "chunks"), "chunk_id", "text")


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters other than white space the units of each chunk have; SQL says how many the chunk has."""
    units = sentences(table(spark, sf_dir, "chunks"), "chunk_id", "text", with_text=True)
    return units.groupBy("chunk_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"(?U)\s", ""))).cast("bigint").alias("covered"))


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ingest_requests"), with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).where(F.col("piece_no") == 1).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p2_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text put together again, each from where the one before it ended; SQL says what the text is."""
    p = _pieces(spark, sf_dir, True)
    row = F.sort_array(F.collect_list(F.struct("piece_no", "end_char", F.col("start_char").alias("at"), "piece")))  # the pieces of one text
    joined = F.aggregate("r", F.struct(F.lit(0).alias("end"), F.lit("").alias("text")), lambda a, x: F.struct(x["end_char"].alias("end"), F.concat(a["text"], F.substr(x["piece"], a["end"] - x["at"] + 1)).alias("text")))
    return p.groupBy("chunk_id").agg(row.alias("r")).select("chunk_id", joined["text"].alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "entities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf_dir, "ask_log"), table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "chunks"), "chunk_id", "text", "lang", only_cases=True).select("chunk_id", "seg_no", "lang").distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "chunks"), "chunk_id", "text", "lang")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.sample(sizes, mixing.shares(table(spark, sf_dir, "mix_plan"), sizes))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "mix_plan"), mixing.sized(table(spark, sf_dir, "documents")))


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source of every mix keeps to its repeats, and has the tokens it should up to its largest document."""
    plan, sizes = table(spark, sf_dir, "mix_plan"), mixing.sized(table(spark, sf_dir, "documents"))
    goals = mixing.shares(plan, sizes).select("mix_id", "source", "goal")
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    r = mixing.report(plan, sizes).join(goals, ["mix_id", "source"]).join(largest, "source", "left")
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (F.abs(F.col("tokens") - F.col("goal")) <= F.coalesce("largest", F.lit(0)))
    return r.select("mix_id", "source", kept.alias("kept"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_cover": p1_cover,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_joined": p2_joined,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_segments": p5_segments,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_bounds": p8_bounds,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OVERSIZED = """FROM chunks c
LEFT JOIN (SELECT request_id, min(coalesce(max_chunk_size, 850)) AS hi, min(coalesce(min_chunk_size, 350)) AS lo
           FROM ingest_requests GROUP BY request_id) r ON c.request_id = r.request_id AND r.hi >= r.lo
WHERE length(c.text) > coalesce(r.hi, 850)"""
SQL: dict[str, str] = {
    "p1_cover": f"SELECT DISTINCT chunk_id, length(regexp_replace(text, '{_WS}', '', 'g')) AS covered FROM chunks WHERE length(regexp_replace(text, '{_WS}', '', 'g')) > 0",
    "p2_joined": f"SELECT DISTINCT c.chunk_id, c.text {_OVERSIZED}",
    "p8_bounds": "SELECT DISTINCT mix_id, lower(trim(source)) AS source, true AS kept FROM mix_plan WHERE target_weight > 0",
    "p2_found": """
SELECT DISTINCT c.chunk_id FROM chunks c
LEFT JOIN (SELECT request_id, min(coalesce(max_chunk_size, 850)) AS hi, min(coalesce(min_chunk_size, 350)) AS lo
           FROM ingest_requests GROUP BY request_id) r ON c.request_id = r.request_id AND r.hi >= r.lo
WHERE length(c.text) > coalesce(r.hi, 850)
""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
