"""The service as Python functions: collections, ingest, transcription, search, answers, entity extraction and listing.

Models are plug points: an encoder (``operators.encoding.Encoder``), a reranker of pairs, an annotator of texts, a chat
model as a function of a column of prompts, a parser of page files and a recogniser of audio files. Stand-ins that need
no model are the defaults where there can be one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions import text as tx
from cuecraft.operators import chunking, entities, ner, rag, retrieval
from cuecraft.operators.catalog import SCHEMAS, Catalog
from cuecraft.operators.encoding import Encoder, HashEncoder
from cuecraft.schema import DEFAULT_LIMIT, ENTITY_MAX_CHUNK, ENTITY_MIN_CHUNK, ENTITY_SENTENCES, MAX_CHUNK, MERGE_THRESHOLD, MIN_CHUNK, PAGE_TOKENS
from cuecraft.session import materialize
from cuecraft.sources import files


def located(chunks: DataFrame, course_id: str | None) -> DataFrame:
    """Chunks of cues with their place: ``chunk_id, text, loc``; ids are hashes of the content, numbers keep the order."""
    loc = F.struct(
        F.lit("video").alias("kind"), F.lit(course_id).cast("string").alias("course_id"), "lecture_id", F.lit(None).cast("string").alias("file_id"), "start_us", "end_us",
    )
    made = tx.content_id(F.lit(course_id), F.col("lecture_id"), F.col("chunk_no"), F.col("piece_no"), F.col("text"))
    return chunks.select(made.alias("chunk_id"), "text", loc.alias("loc"), F.struct("chunk_no", "piece_no").alias("no"))


def lecture_points(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """Rows of the lecture collection of ``chunk_id, text, loc``: payload and dense, sparse and multi-vectors."""
    flat = chunks.select("chunk_id", F.struct("text", "loc").alias("payload"), "text")
    encoded = encoder.encode(flat.select(F.to_json(F.struct("chunk_id", "text", F.col("payload.loc").alias("loc"))).alias("row"), "text"), "row", "text", ("dense", "sparse", "colbert"))
    # The payload rides along as the encoder's key, so that no join brings them together again.
    row = F.from_json("row", "chunk_id string, text string, loc struct<course_id:string,lecture_id:string,start_us:bigint,end_us:bigint>")
    out = encoded.select(row.alias("r"), "dense", "sparse", "colbert")
    return out.select(
        F.col("r.chunk_id").alias("id"), "r.text", "r.loc.course_id", "r.loc.lecture_id", "r.loc.start_us", "r.loc.end_us",
        F.col("dense").cast("array<float>").alias("dense"), F.col("sparse").cast("map<string,float>").alias("sparse"), F.col("colbert").cast("array<array<float>>").alias("colbert"),
    )


@dataclass
class Service:
    spark: SparkSession
    root: str
    encoder: Encoder = field(default_factory=HashEncoder)
    reranker: Callable[[DataFrame], DataFrame] = retrieval.coverage_reranker
    annotator: Callable[[str], list[tuple[str, str]]] | None = None
    chat: Callable | None = None
    page_parser: Callable | None = None
    recogniser: Callable | None = None
    threshold: float = MERGE_THRESHOLD

    def __post_init__(self):
        self.catalog = Catalog(self.spark, self.root)

    def about(self) -> dict:
        return {"message": "Lecture search is running"}

    def init(self) -> dict:
        return {"message": "Collections are there", **self.catalog.init()}

    def status(self) -> dict:
        return {"collections": self.catalog.status()}

    def delete(self, name: str) -> None:
        self.catalog.delete(name)

    # Ingest.

    def ingest(self, srt_file: str, course_id: str, lecture_id: str, min_size: int = MIN_CHUNK, max_size: int = MAX_CHUNK, overlap: bool = True, debug_file: str | None = None) -> dict:
        """Subtitles of one lecture to points of the lecture collection; repeated ingests append again. A missing file, a
        wrong suffix, or sizes that exclude each other are errors. ``debug_file`` gets the chunks as subtitles."""
        files.check_file(self.spark, srt_file)
        self.catalog.require("lectures")
        cues = files.read_srt(self.spark, srt_file).withColumn("lecture_id", F.lit(lecture_id))
        chunks = chunking.chunk_cues(cues, min_size, max_size, overlap)
        if debug_file:
            rows = chunks.select("lecture_id", F.struct("chunk_no", "piece_no").alias("seq"), (F.col("start_us") / 1e6).alias("start_s"), (F.col("end_us") / 1e6).alias("end_s"), "text")
            files.write_srt_file(rows, debug_file)
        points = materialize(lecture_points(located(chunks, course_id), self.encoder))
        self.catalog.append("lectures", points)
        n = points.count()
        return {"message": f"{n} chunks ingested", "chunks": n}

    def transcribe(self, audio_file: str, segments: DataFrame | None = None) -> dict:
        """Writes ``.srt`` and ``.txt`` beside the audio file from the recogniser's segments, or from ready ones
        (``seq, start_s, end_s, text``). A missing file is an error."""
        files.check_file(self.spark, audio_file)
        if segments is None:
            if self.recogniser is None:
                raise ValueError("no recogniser is plugged in, and no segments are given")
            segments = files.read_binary(self.spark, audio_file, self.recogniser, "seq long, start_s double, end_s double, text string")
        rows = segments.select(F.lit("").alias("lecture_id"), "seq", "start_s", "end_s", "text")
        stem = audio_file.rsplit(".", 1)[0]
        files.write_srt_file(rows, f"{stem}.srt")
        whole = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: tx.strip(F.coalesce(x["text"], F.lit("")))), " ").alias("text"))  # one recording
        files.write_one_file(self.spark, whole.first()["text"], f"{stem}.txt")
        return {"message": "Transcribed", "srt": f"{stem}.srt", "txt": f"{stem}.txt"}

    # Search and answers.

    def _asked(self, texts: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([(0, texts)], "query_id bigint, text string") if isinstance(texts, str) else texts

    def search(self, queries: DataFrame | str, kind="hybrid", limit: int = DEFAULT_LIMIT, reranking: bool = False) -> DataFrame:
        """Hits of text queries with their texts and places: ``query_id, rank, score, text, video_location``."""
        lectures = self.catalog.require("lectures")
        hits = retrieval.search(self._asked(queries), lectures, kind, limit, reranking, encoder=self.encoder, reranker=self.reranker)
        return retrieval.lecture_items(hits, lectures)

    def ask(self, questions: DataFrame | str, kind="hybrid", limit: int = DEFAULT_LIMIT) -> DataFrame:
        """``query_id, answer, confidence_score, source_snippets`` of every question, from the hits of its search."""
        if self.chat is None:
            raise ValueError("no chat model is plugged in")
        asked = self._asked(questions)
        return rag.ask(asked, self.search(asked, kind, limit).select("query_id", "rank", "text"), self.chat)

    # Entities.

    def chunks_of(self, path: str, course_id: str, lecture_id: str | None = None) -> DataFrame:
        """``chunk_id, text, loc, no`` of a text, page or subtitle file, cut as entity extraction wants it."""
        kind = files.dispatch(path)
        if kind == "subtitles":
            cues = files.read_srt(self.spark, path).withColumn("lecture_id", F.lit(lecture_id or "unknown"))
            return located(chunking.chunk_cues(cues, ENTITY_MIN_CHUNK, ENTITY_MAX_CHUNK), course_id)
        if kind == "text":
            groups = chunking.sentence_groups(files.read_txt(self.spark, path, course_id), "file_id", "text", ENTITY_SENTENCES)
        else:
            blocks = files.read_pages(self.spark, path, self.page_parser)
            groups = blocks.select("file_id", F.posexplode(files.pack(F.col("blocks"), PAGE_TOKENS)).alias("group_no", "text"))
        none = F.lit(None)
        loc = F.struct(F.lit("file").alias("kind"), F.lit(course_id).alias("course_id"), none.cast("string").alias("lecture_id"), "file_id", none.cast("bigint").alias("start_us"), none.cast("bigint").alias("end_us"))
        made = tx.content_id(F.lit(course_id), F.col("file_id"), F.col("group_no"), F.col("text"))
        return groups.select(made.alias("chunk_id"), "text", loc.alias("loc"), F.struct(F.col("group_no").cast("long").alias("chunk_no"), F.lit(0).alias("piece_no")).alias("no"))

    def extract(self, path: str, course_id: str, lecture_id: str | None = None, annotator: Callable | dict[str, Callable] | None = None) -> dict:
        """Entities of a file into the entity collection: counts of extracted, new and merged mentions, of chunks whose
        annotation failed, and the language that the first two chunks are in, which picks the annotator of a dict."""
        files.check_file(self.spark, path)
        self.catalog.require("entities")
        chunks = materialize(self.chunks_of(path, course_id, lecture_id))
        language = ner.head_language(chunks, "no", "text")
        annotator = annotator or self.annotator
        if isinstance(annotator, dict):
            annotator = annotator.get(language, annotator.get("en"))
        if annotator is None:
            raise ValueError("no annotator is plugged in")
        spans = materialize(ner.annotated(chunks.select("chunk_id", "text", "loc", "no"), annotator))
        mentions = ner.mentions(spans, "no", "loc")
        return self.add_mentions(mentions) | {"failed_chunks": ner.failures(spans), "language": language}

    def add_mentions(self, mentions: DataFrame) -> dict:
        """Mentions (``order`` of arrival, ``text, label, loc``) joined to the stored entities or stored as new ones."""
        stored = materialize(self.catalog.require("entities").withColumn("seq", -1 - F.monotonically_increasing_id()))
        numbered = materialize(entities.in_order(mentions, "order"))
        vectors = self.encoder.encode(numbered, "seq", "text", ("dense",))
        known = stored.select("seq", F.col("dense").cast("array<double>").alias("dense"))
        resolved = materialize(entities.resolve(vectors, self.threshold, known=known))
        made = entities.stored_after(stored, numbered, resolved, vectors)
        self.catalog.replace("entities", made.select([f.name for f in SCHEMAS["entities"]]))
        c = entities.counters(resolved).first()
        return {"num_extracted_entities": c["extracted"], "num_new_inserted_entities": c["new_entities"], "num_merged_entities": c["merged"]}

    def search_entities(self, queries: DataFrame | str, limit: int) -> DataFrame:
        """The nearest entities of text queries: ``query_id, rank, id, score, entity``."""
        stored = self.catalog.require("entities")
        asked = self.encoder.encode(self._asked(queries), "query_id", "text", ("dense",))
        return retrieval.entity_items(retrieval.dense_topk(asked, stored.select("id", "dense"), limit), stored)

    def list_entities(self, label: str | None = None, limit: int = 100, include_aliases: bool = False) -> DataFrame:
        """One row: ``total, limit, include_aliases, label_distribution, entities``."""
        return entities.entity_page(self.catalog.require("entities").withColumnRenamed("id", "entity_id"), label, limit, include_aliases)
