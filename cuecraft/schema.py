"""Types and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The service's defaults and canned answers.
DIMENSION = 1024
CANDIDATES = 50
DEFAULT_LIMIT = 5
MERGE_THRESHOLD = 0.83
RRF_K = 60
MIN_CHUNK, MAX_CHUNK, MAX_CHUNK_FUNCTION = 350, 850, 750
ENTITY_MIN_CHUNK, ENTITY_MAX_CHUNK, ENTITY_SENTENCES = 40, 400, 3
SENTENCES_PER_CHUNK = 5
PAGE_TOKENS = 312
ENTITY_LABELS = ("ALGORITHM", "CONCEPT", "THEOREM_RULE", "DISTRIBUTION", "FUNCTION", "OPERATOR")
RETRIEVERS = ("dense", "hybrid", "hybrid+colbert")
COLLECTIONS = ("lectures", "entities")
NO_HITS_ANSWER = "I could not find any relevant information to answer this question."
UNREADABLE_ANSWER = "I could not generate a valid answer."

LOCATION = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("course_id", T.StringType()), T.StructField("lecture_id", T.StringType()),
    T.StructField("file_id", T.StringType()), T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()),
])
CUES = T.StructType([
    T.StructField("lecture_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("start_us", T.LongType()),
    T.StructField("end_us", T.LongType()), T.StructField("content", T.StringType()),
])
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("loc", LOCATION)])
ANSWER = T.StructType([
    T.StructField("answer", T.StringType()), T.StructField("confidence_score", T.DoubleType()),
    T.StructField("source_snippets", T.MapType(T.StringType(), T.DoubleType())),
])
LECTURE_POINT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("course_id", T.StringType()), T.StructField("lecture_id", T.StringType()),
    T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("dense", T.ArrayType(T.FloatType())),
    T.StructField("sparse", T.MapType(T.StringType(), T.FloatType())), T.StructField("colbert", T.ArrayType(T.ArrayType(T.FloatType()))),
])
ENTITY_POINT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("entity_instances", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("location", LOCATION)]))),
    T.StructField("dense", T.ArrayType(T.FloatType())),
])
