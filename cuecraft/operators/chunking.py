"""Chunking of timed cues and of texts.

Cues are split at full stops, joined into blocks that end with one, grown to a minimum size, given neighbours as context
and halved while too large. A lecture of any length is spread over tasks:

* blocks are numbered over ranges of (lecture, cue): each range counts on its own, and only the lecture that goes on from
  the range before gets an offset, so one row a range;
* growing is a fold whose state is one number, the size of the open chunk. The blocks' lengths are cut into slices; for
  each slice a short table says, for every place where the open chunk can close, how many chunks follow and what stays
  open. The tables of a lecture are composed, then every slice is folded from its entry. Texts meet by chunk at last.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.functions import text as tx
from cuecraft.functions.timefmt import clock
from cuecraft.schema import MAX_CHUNK_FUNCTION, MIN_CHUNK, SENTENCES_PER_CHUNK
from cuecraft.session import materialize

#: White space after a full stop, as Unicode has it.
_AFTER_STOP = re.compile(r"(?<=\.)[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Blocks of a lecture that are folded in one task.
SLICE_BLOCKS = 50_000


def check_sizes(min_size: int, max_size: int) -> None:
    if max_size < min_size:
        raise ValueError(f"the maximum size {max_size} is below the minimum {min_size}")


def split_cues(cues: DataFrame) -> DataFrame:
    """Parts of the cues, cut after full stops: ``lecture_id, seq, part, start_us, end_us, content``.

    Time is shared out by length: a rounded time per character (half to even) times the part's length, from the end of
    the part before; the first starts and the last ends with its cue. Null content counts as empty; null times stay.
    """
    source = cues.select("lecture_id", F.col("seq").cast("bigint").alias("seq"), "start_us", "end_us", F.coalesce("content", F.lit("")).alias("content"))
    kinds = {"lecture_id": pa.string(), "seq": pa.int64(), "part": pa.int32(), "start_us": pa.int64(), "end_us": pa.int64(), "content": pa.string()}

    def cut(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for lecture, seq, start, end, whole in zip(*(c.to_pylist() for c in batch.columns)):
                parts = _AFTER_STOP.split(whole)
                timed = start is not None and end is not None
                per_char = round((end - start) / max(len(whole), 1)) if timed else None
                at = start
                for k, content in enumerate(parts):
                    stop = at + per_char * len(content) if timed else None
                    last = k == len(parts) - 1
                    row = (lecture, seq, k, at if timed or k == 0 else None, end if last else stop, content)
                    for column, value in zip(out, row):
                        column.append(value)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds.values())], names=list(kinds))

    return source.mapInArrow(cut, "lecture_id string, seq bigint, part int, start_us bigint, end_us bigint, content string")


def payload(chunks: DataFrame) -> DataFrame:
    """What is stored beside a chunk's vectors (``loc`` with its place): text, course, lecture and times as texts."""
    return chunks.select(*(c for c in chunks.columns if c not in ("text", "loc")), "text", "loc.course_id", "loc.lecture_id", clock(F.col("loc.start_us")).alias("start_time"), clock(F.col("loc.end_us")).alias("end_time"))


def islands(parts: DataFrame) -> DataFrame:
    """Blocks that run up to a part ending with a full stop: ``lecture_id, block_no, start_us, end_us, content``.

    The contents are joined by spaces; the last block of a lecture may be incomplete. Blocks count from 0.
    """
    kept = ["lecture_id", "seq", "part", "start_us", "end_us", "content"]
    ranged = parts.select(*kept).repartitionByRange("lecture_id", "seq", "part").sortWithinPartitions("lecture_id", "seq", "part").withColumn("_p", F.spark_partition_id())

    def count(batches):
        lecture, closed = object(), 0
        for batch in batches:
            numbers = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                if name != lecture:
                    lecture, closed = name, 0
                numbers.append(closed)
                closed += content.endswith(".")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, type=pa.int64())], names=[*kept, "_p", "_no"])

    numbered = materialize(ranged.mapInArrow(count, "lecture_id string, seq bigint, part int, start_us bigint, end_us bigint, content string, _p int, _no bigint"))
    closed = numbered.groupBy("lecture_id", "_p").agg(F.sum(F.col("content").endswith(".").cast("bigint")).alias("n"))
    before = Window.partitionBy("lecture_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # At most one lecture of a range goes on from another range.
    offsets = closed.withColumn("ahead", F.sum("n").over(before)).where("ahead > 0").select(F.col("lecture_id").alias("_l"), F.col("_p").alias("_q"), "ahead")
    placed = numbered.join(F.broadcast(offsets), (F.col("lecture_id").eqNullSafe(F.col("_l"))) & (F.col("_p") == F.col("_q")), "left")
    row = F.struct("seq", "part", "start_us", "end_us", "content")
    grouped = placed.groupBy("lecture_id", (F.col("_no") + F.coalesce("ahead", F.lit(0))).alias("block_no")).agg(F.sort_array(F.collect_list(row)).alias("r"))  # one block
    return grouped.select(
        "lecture_id", "block_no", F.col("r")[0]["start_us"].alias("start_us"), F.element_at("r", -1)["end_us"].alias("end_us"),
        F.array_join(F.col("r.content"), " ").alias("content"),
    )


class Fold:
    """Growing over one slice of block lengths. A chunk closes with the first block that makes it longer than the minimum;
    its size is that of the blocks and one space between two."""

    def __init__(self, lengths: np.ndarray, min_size: int):
        n = len(lengths)
        self.n, self.min_size = n, min_size
        self.sums = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 1)])
        # Where a chunk closes that begins with block i; n if it stays open.
        self.close = np.searchsorted(self.sums, self.sums[:-1] + min_size + 1, side="right") - 1
        self.close = np.where(self.close < n, self.close, n)

    def first_close(self, open_size: int) -> int:
        """The block that closes what is open at the start (-1: nothing is)."""
        held = open_size + 1 if open_size >= 0 else 0
        k = int(np.searchsorted(self.sums, self.min_size + 1 - held, side="right"))
        return min(max(k - 1, 0), self.n)

    def run(self, start: int) -> list[int]:
        """Blocks that close a chunk, from a chunk that begins with block ``start``."""
        out = []
        while start < self.n and (k := int(self.close[start])) < self.n:
            out.append(k)
            start = k + 1
        return out

    def left_open(self, begin: int, held: int = -1) -> int:
        """Size of what is open at the end, if the last chunk begins with ``begin``, or goes on from a size ``held``."""
        size = int(self.sums[-1] - self.sums[begin])
        return held + size if held >= 0 else size - 1 if begin < self.n else -1

    def table(self) -> list[tuple[int, int, int]]:
        """For each block that can be the first to close: the block, chunks closed by the end, and the size left open."""
        last = self.first_close(-1)
        chunks, open_at = np.zeros(self.n + 2, dtype=np.int64), np.full(self.n + 2, -1, dtype=np.int64)
        for i in range(self.n - 1, -1, -1):
            k = int(self.close[i])
            chunks[i], open_at[i] = (0, self.left_open(i)) if k >= self.n else (chunks[k + 1] + 1, open_at[k + 1])
        return [(j, int(chunks[j + 1]) + 1, int(open_at[j + 1])) for j in range(min(last, self.n - 1) + 1)]


_TABLE = pa.schema([("lecture_id", pa.string()), ("slice", pa.int64()), ("sums", pa.list_(pa.int64())), ("total", pa.int64()), ("table", pa.list_(pa.struct([("close", pa.int32()), ("chunks", pa.int64()), ("left", pa.int64())])))])


def _slices(batches, columns: int):
    """Key (the first two columns) and the numbers of the other columns of each slice, whose rows follow each other, be it
    over several batches."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lectures, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        rest = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(columns)]
        edges = [i for i in range(1, len(lectures)) if lectures[i] != lectures[i - 1] or numbers[i] != numbers[i - 1]]
        for low, high in zip([0, *edges], [*edges, len(lectures)]):
            key = (lectures[low], int(numbers[low]))
            if parts and key != held:
                yield held, [np.concatenate(x) for x in zip(*parts)]
                parts = []
            held = key
            parts.append([x[low:high] for x in rest])
    if parts:
        yield held, [np.concatenate(x) for x in zip(*parts)]


def grow(blocks: DataFrame, min_size: int, overlap: bool = False, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """Blocks joined until a chunk is longer than ``min_size``: ``lecture_id, chunk_no, first_block, last_block,
    start_us, end_us, content``. The last chunk of a lecture may be short.

    With ``overlap`` the block before and the block after a chunk are added to it, with their times.
    """
    blocks = materialize(blocks.select("lecture_id", "block_no", "start_us", "end_us", "content"))
    lengths = blocks.select("lecture_id", F.floor(F.col("block_no") / slice_blocks).alias("slice"), "block_no", F.length("content").alias("n"))

    same = lambda x, y: F.col(f"{x}.lecture_id").eqNullSafe(F.col(f"{y}.lecture_id"))
    # Only lectures of several slices need tables.
    long = lengths.where("slice > 0").select("lecture_id").distinct()

    def tables(batches):
        for (lecture, no), (n,) in _slices(batches, 1):
            fold = Fold(n, min_size)
            table = [{"close": j, "chunks": c, "left": o} for j, c, o in fold.table()]
            yield pa.RecordBatch.from_pylist([{"lecture_id": lecture, "slice": no, "sums": fold.sums[: fold.first_close(-1) + 2].tolist(), "total": int(fold.sums[-1]), "table": table}], schema=_TABLE)

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        """What is open where each slice of a lecture begins, and the number of the chunk."""
        rows, open_size, chunk = [], -1, 0
        for r in pdf.sort_values("slice").itertuples(index=False):
            rows.append((r.lecture_id, r.slice, open_size, chunk))
            held = open_size + 1 if open_size >= 0 else 0
            k = max(int(np.searchsorted(np.array(r.sums), min_size + 1 - held, side="right")) - 1, 0)
            if k < len(r.table):
                chunk, open_size = chunk + r.table[k]["chunks"], r.table[k]["left"]
            else:
                open_size = open_size + r.total if open_size >= 0 else r.total - 1
        return pd.DataFrame(rows, columns=["lecture_id", "slice", "open_size", "chunk"])

    sliced = lengths.alias("a").join(long.alias("b"), same("a", "b"), "left_semi").repartition("lecture_id", "slice").sortWithinPartitions("lecture_id", "slice", "block_no")
    made = sliced.select("lecture_id", "slice", "n").mapInArrow(tables, "lecture_id string, slice bigint, sums array<bigint>, total bigint, table array<struct<close:int,chunks:bigint,left:bigint>>")
    entry = made.groupBy("lecture_id").applyInPandas(entries, "lecture_id string, slice bigint, open_size bigint, chunk bigint")  # one row a slice

    def assign(batches):
        names: list = []
        parts: list[list[np.ndarray]] = []

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), *(pa.array(np.concatenate(x)) for x in zip(*parts))], names=["lecture_id", "block_no", "chunk_no", "first", "last"])
            names.clear(), parts.clear()
            return out

        for (lecture, _), (n, block, held, chunk) in _slices(batches, 4):
            fold = Fold(n, min_size)
            open_size = int(held[0])
            k = fold.first_close(open_size)
            ends = np.zeros(fold.n, dtype=bool)
            ends[[k, *fold.run(k + 1)] if k < fold.n else []] = True
            names += [lecture] * fold.n
            parts.append([block, chunk[0] + np.concatenate([[0], np.cumsum(ends)[:-1]]), np.concatenate([[open_size < 0], ends[:-1]]), ends])
            if len(names) > 10_000:
                yield handed_on()
        if names:
            yield handed_on()

    entered = lengths.alias("a").join(entry.alias("b"), same("a", "b") & (F.col("a.slice") == F.col("b.slice")), "left")
    entered = entered.select("a.lecture_id", "a.slice", F.col("n").cast("bigint").alias("n"), "block_no", F.coalesce("open_size", F.lit(-1)).cast("bigint").alias("open_size"), F.coalesce("chunk", F.lit(0)).cast("bigint").alias("chunk"))
    ordered = entered.repartition("lecture_id", "slice").sortWithinPartitions("lecture_id", "slice", "block_no")
    assigned = ordered.mapInArrow(assign, "lecture_id string, block_no bigint, chunk_no bigint, first boolean, last boolean")
    joined = blocks.join(assigned.withColumnRenamed("lecture_id", "_l").withColumnRenamed("block_no", "_b"), F.col("lecture_id").eqNullSafe(F.col("_l")) & (F.col("block_no") == F.col("_b")))
    own = F.struct("chunk_no", F.lit(0).alias("role"))
    if overlap:
        roles = F.array(own, F.when(F.col("last"), F.struct((F.col("chunk_no") + 1).alias("chunk_no"), F.lit(-1).alias("role"))), F.when(F.col("first") & (F.col("chunk_no") > 0), F.struct((F.col("chunk_no") - 1).alias("chunk_no"), F.lit(1).alias("role"))))
    else:
        roles = F.array(own)
    rows = joined.select("lecture_id", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("c"), F.struct("block_no", "start_us", "end_us", "content").alias("b"))
    chunk = rows.groupBy("lecture_id", F.col("c.chunk_no").alias("chunk_no")).agg(
        F.sort_array(F.collect_list("b")).alias("r"), F.min(F.when(F.col("c.role") == 0, F.col("b.block_no"))).alias("first_block"), F.max(F.when(F.col("c.role") == 0, F.col("b.block_no"))).alias("last_block"),
    )  # one chunk
    return chunk.where("first_block IS NOT NULL").select(
        "lecture_id", "chunk_no", "first_block", "last_block", F.col("r")[0]["start_us"].alias("start_us"), F.element_at("r", -1)["end_us"].alias("end_us"), F.array_join(F.col("r.content"), " ").alias("content"),
    )


def halves(content: str, start: int | None, end: int | None, max_size: int) -> list[tuple[str, int | None, int | None]]:
    """The content, or its halves by words while they are longer than the maximum and have more than one word."""
    out, todo = [], [(content, start, end)]
    while todo:
        text, a, b = todo.pop()
        words = text.split()
        if len(text) <= max_size or len(words) <= 1:
            out.append((text, a, b))
            continue
        left, right = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
        # Microseconds are rounded half to even, as durations are.
        middle = None if a is None or b is None else a + round((b - a) * (len(left) / len(text)))
        todo += [(right, middle, b), (left, a, middle)]
    return out


def halve_oversized(chunks: DataFrame, max_size: int) -> DataFrame:
    """Chunks over the maximum, cut in halves at words: ``lecture_id, chunk_no, piece_no, start_us, end_us, content``."""
    source = chunks.select("lecture_id", "chunk_no", "start_us", "end_us", F.coalesce("content", F.lit("")).alias("content"))
    schema = "lecture_id string, chunk_no long, piece_no int, start_us long, end_us long, content string"
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())

    def cut(batches):
        for batch in batches:
            rows = [
                (lec, no, i, a, b, text)
                for lec, no, start, end, content in zip(*(c.to_pylist() for c in batch.columns))
                for i, (text, a, b) in enumerate(halves(content, start, end, max_size))
            ]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return source.mapInArrow(cut, schema)


def chunk_cues(cues: DataFrame, min_size: int = MIN_CHUNK, max_size: int = MAX_CHUNK_FUNCTION, overlap: bool = True) -> DataFrame:
    """The whole pipeline from cues to chunks: ``lecture_id, chunk_no, piece_no, start_us, end_us, text``."""
    check_sizes(min_size, max_size)
    grown = grow(islands(split_cues(cues)), min_size, overlap)
    return halve_oversized(grown, max_size).select("lecture_id", "chunk_no", "piece_no", "start_us", "end_us", tx.strip(F.col("content")).alias("text"))


def sentence_groups(texts: DataFrame, key: str, text: str, size: int = SENTENCES_PER_CHUNK) -> DataFrame:
    """Groups of ``size`` sentences, joined by spaces: ``key, group_no, text``. Texts without sentences have none."""
    s = texts.select(key, tx.sentence_parts(F.col(text)).alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / size).cast("int"))
    groups = F.transform(starts, lambda i: F.array_join(F.slice(F.col("s"), i * size + 1, size), " "))
    return s.select(key, F.posexplode(groups).alias("group_no", "text"))
