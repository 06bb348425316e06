"""Answers from retrieved texts: context, prompt, and the parsing of what the language model returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecraft.functions.text import fill_prompt
from cuecraft.schema import ANSWER, NO_HITS_ANSWER, UNREADABLE_ANSWER

PROMPT = "Answer the question from the numbered passages only.\n\nQuestion: {question}\n\nPassages:\n{context}\n\nReply with a JSON object of answer, confidence_score and source_snippets."


def contexts(hits: DataFrame) -> DataFrame:
    """``query_id, context``: the hits' texts (``query_id, rank, text``), numbered by rank and parted by blank lines."""
    line = F.concat(F.col("rank").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))  # at most the limit of the search
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, template: str = PROMPT) -> DataFrame:
    """``query_id, prompt``; a question without hits has a null prompt."""
    joined = questions.select("query_id", F.col("text").alias("question")).join(contexts(hits), "query_id", "left")
    return joined.select("query_id", F.when(F.col("context").isNotNull(), fill_prompt(template, question=F.col("question"), context=F.col("context"))).alias("prompt"))


def parse_answer(raw: Column) -> Column:
    """The answer object of a model's reply. Malformed JSON gives a canned answer without confidence, missing fields
    of an object their empty values, and null (no hits, so no call) the answer that nothing was found."""
    parsed = F.from_json(raw, ANSWER)
    none = F.create_map().cast("map<string,double>")
    canned = lambda text: F.struct(F.lit(text).alias("answer"), F.lit(0.0).alias("confidence_score"), none.alias("source_snippets"))
    read = F.struct(
        F.coalesce(parsed["answer"], F.lit("")).alias("answer"), F.coalesce(parsed["confidence_score"], F.lit(0.0)).alias("confidence_score"),
        F.coalesce(parsed["source_snippets"], none).alias("source_snippets"),
    )
    whole = F.try_parse_json(raw).isNotNull() & raw.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(raw.isNull(), canned(NO_HITS_ANSWER)).when(~whole, canned(UNREADABLE_ANSWER)).otherwise(read)


def ask(questions: DataFrame, hits: DataFrame, model, template: str = PROMPT) -> DataFrame:
    """``query_id, answer, confidence_score, source_snippets`` of every question; ``model`` maps a column of prompts to a
    column of replies, and is not called for questions without hits."""
    asked = prompts(questions, hits, template)
    reply = F.when(F.col("prompt").isNotNull(), model(F.col("prompt")))
    return asked.select("query_id", parse_answer(reply).alias("a")).select("query_id", "a.*")
