"""Files in and out: subtitles, texts, pages, examples, transcripts and points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions import text as tx
from cuecraft.functions.timefmt import parse_offset, srt_time
from cuecraft.functions.windows import numbered
from cuecraft.schema import PAGE_TOKENS

_CUE = r"(?s)^\s*(?:(\d+)[^\S\n]*\n)?\s*(\d+:\d\d:\d\d[,.]\d{1,3})\s*-->\s*(\d+:\d\d:\d\d[,.]\d{1,3})[^\n]*\n?(.*)$"


def check_suffix(path: str, *allowed: str) -> str:
    found = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if found not in allowed:
        raise ValueError(f"{path}: the suffix must be {' or '.join(allowed)}")
    return found


def parse_srt(files: DataFrame, key: str = "lecture_id", text: str = "text") -> DataFrame:
    """Cues of subtitle texts, one row a file: ``key, seq, start_us, end_us, content``. Blocks without times are left out."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^\ufeff", ""), r"\r\n?", "\n")
    rows = files.select(key, F.posexplode(F.split(clean, r"\n[^\S\n]*\n")).alias("pos", "block")).where(F.col("block").rlike(_CUE))
    part = lambda i: F.regexp_extract("block", _CUE, i)
    return rows.select(key, F.col("pos").cast("bigint").alias("seq"), parse_offset(part(2)).alias("start_us"), parse_offset(part(3)).alias("end_us"), tx.strip(part(4)).alias("content"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of the subtitle files at ``path``; the lecture is named by the file."""
    check_suffix(path, ".srt")
    files = spark.read.text(path, wholetext=True).select(tx.stem(F.col("_metadata.file_name")).alias("lecture_id"), F.col("value").alias("text"))
    return parse_srt(files)


def read_txt(spark: SparkSession, path: str, course_id: str) -> DataFrame:
    """Text files: ``course_id, file_id, text``."""
    return spark.read.text(path, wholetext=True).select(F.lit(course_id).alias("course_id"), tx.stem(F.col("_metadata.file_name")).alias("file_id"), F.col("value").alias("text"))


def check_file(spark: SparkSession, path: str) -> None:
    """A missing path, or one that is no file, is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(f"{path} does not exist or is no file")


def write_one_file(spark: SparkSession, text: str, path: str) -> None:
    """A text as one file of that very name, on whatever file system the path is of."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_srt_file(segments: DataFrame, path: str) -> None:
    """The segments of one recording as one subtitle file, a blank line after each cue."""
    check_suffix(path, ".srt")
    cues = srt_lines(segments).orderBy("no").select("cue")
    write_one_file(segments.sparkSession, "".join(r["cue"] + "\n" for r in cues.toLocalIterator()), path)


def read_pages(spark: SparkSession, path: str, parser: Callable | None = None) -> DataFrame:
    """Blocks of page files: ``file_id, blocks``. The parser maps Pandas batches of ``path, content`` to ``path, blocks``; by
    default files are taken for HTML."""
    kind = "path string, blocks array<string>"
    if parser is not None:
        rows = read_binary(spark, path, parser, kind)
    else:
        rows = spark.read.format("binaryFile").load(path).select("path", blocks(F.decode("content", "utf-8")).alias("blocks"))
    return rows.select(tx.stem(F.col("path")).alias("file_id"), "blocks")


def read_definitions(spark: SparkSession, path: str) -> dict[str, str]:
    """Labels and their meanings of a JSON object."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_binary(spark: SparkSession, path: str, parser: Callable, schema: str) -> DataFrame:
    """Binary files (pages, audio) through a parser that maps batches of ``path, content`` to rows of ``schema``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parser, schema)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Worked examples of the annotator: ``text, spans``."""
    return spark.read.json(path, multiLine=True, schema="text string, spans array<struct<text string, is_entity boolean, label string, reason string>>")


def _replace_all(texts: Column, what: str, by: str) -> Column:
    return F.transform(texts, lambda t: F.replace(t, F.lit(what), F.lit(by)))


def blocks(html: Column) -> Column:
    """Texts of the blocks of a page: markup off, references resolved for the five basic ones, empty blocks left out."""
    cut = F.split(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|pre|blockquote)\b[^>]*>")
    plain = F.transform(cut, lambda b: tx.strip(F.regexp_replace(F.regexp_replace(b, r"<[^>]*>", ""), r"(?U)\s+", " ")))
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = _replace_all(plain, ref, ch)
    return F.filter(plain, lambda b: b != "")


def pack(block_texts: Column, max_tokens: int = PAGE_TOKENS) -> Column:
    """Blocks packed in order into chunks of at most ``max_tokens`` words, joined by line ends; a larger block stays alone."""
    size = lambda b: tx.word_count(b)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc, b):
        fits = (acc["n"] == 0) | (acc["n"] + size(b) <= max_tokens)
        grown = F.when(acc["n"] == 0, b).otherwise(F.concat(acc["open"], F.lit("\n"), b))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(fits, grown).otherwise(b).alias("open"), F.when(fits, acc["n"] + size(b)).otherwise(size(b)).alias("n"),
        )

    return F.aggregate(block_texts, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def srt_lines(segments: DataFrame, key: str = "lecture_id") -> DataFrame:
    """Segments (``key, seq, start_s, end_s, text``) as numbered subtitle cues: ``key, no, cue``. A missing end is the start."""
    cue = F.concat(F.col("no").cast("string"), F.lit("\n"), srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.coalesce("end_s", "start_s")), F.lit("\n"), tx.strip(F.coalesce("text", F.lit(""))), F.lit("\n"))
    return numbered(segments, key, "seq").select(key, "no", cue.alias("cue"))


def write_txt(texts: DataFrame, path: str) -> None:
    texts.select("text").write.mode("overwrite").text(path)


def by_suffix(path: Column) -> Column:
    """How a file is read: ``text``, ``pages`` or ``subtitles``; null for any other suffix."""
    s = tx.suffix(path)
    return F.when(s == ".txt", "text").when(s == ".pdf", "pages").when(s == ".srt", "subtitles")


def dispatch(path: str) -> str:
    """The same for one path; an unknown suffix is an error."""
    return {".txt": "text", ".pdf": "pages", ".srt": "subtitles"}[check_suffix(path, ".txt", ".pdf", ".srt")]
