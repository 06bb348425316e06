"""Problem 2: items larger than a limit are cut at natural boundaries, with overlap between consecutive pieces.

Agglomerative merging. The text is first cut into atoms: sentence units, and within units that are too long clauses,
words and at last single characters. Every boundary between two atoms has a strength. The adjacent pairs lie in a heap
by (strength, combined size); the weakest boundary whose sides fit together, overlap included, is merged away first,
until nothing fits. What then lies below the minimum size takes atoms from a neighbour that can spare them.

The pieces without their overlap are consecutive slices of the text: joined they are the text.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.llm.arrow import int_lists, map_arrow
from cuecraft.llm.sentences import spans
from cuecraft.operators.joins import lookup_join

# The ingest model's defaults.
MIN_SIZE, MAX_SIZE, OVERLAP, OVERLAP_CHARS = 350, 850, True, 40

CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_CLAUSE = re.compile(r"(?:[,;:–—]\s+|[，、；：،؛]\s*)(?=\S)")
_GAP = re.compile(r"\s+(?=\S)")
_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x85\u2028\u2029])[^\S\n\r]*(?:\r\n|[\n\r\x85\u2028\u2029])|\u2029")
_LINE_END = re.compile(r"[\n\r\x85\u2028\u2029]")
#: Characters that no cut separates from the one before them: marks, joiners, variation selectors, skin tones.
_CLINGING = re.compile(r"[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٰٟऀ-ःऺ-ॏัิ-ฺ็-๎\u200c\u200d⃐-⃿︀-\ufe0f\U0001f3fb-\U0001f3ff]")


def _finer(text: str, low: int, high: int, limit: int, cuts: list[tuple[int, int]]) -> None:
    """Append cuts inside of ``low..high`` so that no stretch is longer than ``limit``: clauses, in them words."""
    at = low
    for stop in [*(m.end() for m in _CLAUSE.finditer(text, low, high)), high]:
        if stop - at > limit:
            _split_words(text, at, stop, limit, cuts)
        if stop < high:
            cuts.append((stop, CLAUSE))
        at = stop


def _split_words(text: str, low: int, high: int, limit: int, cuts: list[tuple[int, int]]) -> None:
    at = low
    for stop in [*(m.end() for m in _GAP.finditer(text, low, high)), high]:
        while stop - at > limit:
            cut = at + limit
            while cut > at + 1 and cut < high and (_CLINGING.match(text, cut) or text[cut - 1] == "\u200d"):
                cut -= 1
            if cut <= at + 1:
                cut = at + limit
            cuts.append((cut, CHARACTER))
            at = cut
        if stop < high:
            cuts.append((stop, WORD))
        at = stop


def _cuts(text: str, limit: int) -> list[tuple[int, int]]:
    """Inner boundaries of the text in order, with their strengths; no stretch between two exceeds ``limit``."""
    units = spans(text)
    cuts: list[tuple[int, int]] = []
    at = 0
    for k, (a, b) in enumerate(units):
        if k:
            gap = text[units[k - 1][1] : a]
            strength = SENTENCE
            if _LINE_END.search(gap):
                strength = PARAGRAPH if _BLANK_LINE.search(gap) else LINE
            cuts.append((a, strength))
            at = a
        stop = units[k + 1][0] if k + 1 < len(units) else len(text)
        if stop - at > limit:
            _finer(text, at, stop, limit, cuts)
    if not units and len(text) > limit:
        _split_words(text, 0, len(text), limit, cuts)
    return cuts


def _merge(ends: list[int], strengths: list[int], max_size: int, overlap: int) -> list[int]:
    """Ends of the merged groups, as indexes into ``ends``. ``ends[k]`` is the end of atom k, ``strengths[k]`` the
    strength of the boundary after it."""
    n = len(ends)
    begin = [0, *ends[:-1]]  # start of the group that begins with atom k
    right = list(range(1, n + 1))  # first atom of the next group
    left = list(range(-1, n - 1))
    last = list(range(n))  # last atom of the group
    alive = [True] * n
    heap = []

    def offer(k: int) -> None:
        r = right[k]
        if r < n:
            size = ends[last[r]] - begin[k]
            if size + (overlap if k else 0) <= max_size:
                heapq.heappush(heap, (strengths[last[k]], size, k, r, last[r]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, _, k, r, e = heapq.heappop(heap)
        if not alive[k] or not alive[r] or right[k] != r or last[r] != e:
            continue
        size = ends[e] - begin[k]
        if size + (overlap if k else 0) > max_size:
            continue
        alive[r] = False
        last[k] = e
        right[k] = right[r]
        if right[k] < n:
            left[right[k]] = k
        offer(k)
        if left[k] >= 0:
            offer(left[k])
    return [last[k] for k in range(n) if alive[k]]


def _lift_small(text: str, bounds: list[int], atoms: list[int], min_size: int, max_size: int, overlap: int) -> list[int]:
    """Move boundaries so that pieces below the minimum reach it, as far as their neighbours can spare it."""
    size = lambda k: bounds[k + 1] - bounds[k] + (overlap if k else 0)
    for k in range(len(bounds) - 1):
        if size(k) >= min_size:
            continue
        for side in (-1, 1):  # move the boundary before, or after, this piece
            other = k + side
            if not 0 <= other < len(bounds) - 1:
                continue
            edge = k if side < 0 else k + 1
            low, high = bounds[edge - 1], bounds[edge + 1]
            first = overlap if edge - 1 > 0 else 0
            fits = lambda p: min_size <= p - low + first <= max_size and min_size <= high - p + overlap <= max_size  # noqa: B023, E731
            choices = [p for p in atoms if low < p < high and fits(p)]
            if not choices:
                choices = [m.end() for m in _GAP.finditer(text, low, high) if m.end() < high and fits(m.end())]
            if choices:
                bounds[edge] = min(choices, key=lambda p: abs(p - bounds[edge]))  # noqa: B023
                break
    return bounds


def pieces(text: str, min_size: int, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of every piece in code points; a text within ``max_size`` is one piece.

    Every piece is at most ``max_size`` long; from the second on it begins ``overlap`` characters before the end of the
    one before it. An overlap that isn't below the size leaves no room for anything new; it is cut to half of the size
    here. ``settings`` refuses requests with such a one.
    """
    n = len(text)
    if n <= max_size:
        return [(0, n)] if n else []
    overlap = max(0, overlap) if overlap < max_size else max_size // 2
    cuts = _cuts(text, max_size - overlap)
    ends = [p for p, _ in cuts] + [n]
    strengths = [s for _, s in cuts] + [PARAGRAPH]
    bounds = [0, *(ends[k] for k in _merge(ends, strengths, max_size, overlap))]
    if min_size > 0 and any(bounds[k + 1] - bounds[k] + (overlap if k else 0) < min_size for k in range(len(bounds) - 1)):
        bounds = _lift_small(text, bounds, ends[:-1], min(min_size, max_size), max_size, overlap)
    return [(max(0, bounds[k] - (overlap if k else 0)), bounds[k + 1]) for k in range(len(bounds) - 1)]


def settings(requests: DataFrame) -> DataFrame:
    """One row for a request: ``request_id, min_size, max_size, overlap_chars`` with the model's defaults for nulls.

    Repeated rows count once; requests whose maximum lies below their minimum were refused and are left out, and so are
    those whose overlap is not below the maximum.
    """
    filled = requests.where(F.col("request_id").isNotNull()).select(
        "request_id",
        F.coalesce("min_chunk_size", F.lit(MIN_SIZE)).alias("min_size"),
        F.coalesce("max_chunk_size", F.lit(MAX_SIZE)).alias("max_size"),
        F.when(F.coalesce("overlap", F.lit(OVERLAP)), F.coalesce("overlap_chars", F.lit(OVERLAP_CHARS))).otherwise(0).alias("overlap_chars"),
    )
    # A key with rows that differ keeps the least of each setting; the check of max against min follows.
    one = filled.groupBy("request_id").agg(*(F.min(c).alias(c) for c in ("min_size", "max_size", "overlap_chars")))
    return one.where((F.col("max_size") >= F.col("min_size")) & (F.col("max_size") > 0) & (F.col("overlap_chars") < F.col("max_size")))


def split_oversized(chunks: DataFrame, requests: DataFrame, key: str = "chunk_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Pieces of every text longer than the maximum of its request: ``key, piece_no, start_char, end_char[, piece]``.

    ``piece_no`` counts from 0 in text order; offsets are code points of the text, end exclusive. Texts within their
    limit, null and empty ones give no rows. Repeated rows of a key and text give their pieces once. Chunks without
    request, or of an unknown one, get the defaults. Other columns are not read.
    """
    # Only these columns go on: clashing names elsewhere do no harm.
    source = chunks.select(F.col(key).alias("_k"), F.col(text).alias("_t"), "request_id").where(F.col("_t").isNotNull())
    joined = lookup_join(source, settings(requests), "request_id", "_k").select(
        "_k", "_t",
        F.coalesce("min_size", F.lit(MIN_SIZE)).alias("lo"),
        F.coalesce("max_size", F.lit(MAX_SIZE)).alias("hi"),
        F.coalesce("overlap_chars", F.lit(OVERLAP_CHARS)).alias("ov"),
    ).where(F.length("_t") > F.col("hi"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, t, lo, hi, ov = batch.columns
        texts = t.to_pylist()
        found = [pieces(*row) for row in zip(texts, lo.to_pylist(), hi.to_pylist(), ov.to_pylist())]
        columns = [k, int_lists([[a for a, _ in x] for x in found]), int_lists([[b for _, b in x] for x in found])]
        names = ["_k", "starts", "ends"]
        if with_text:
            columns.append(pa.array([[s[a:b] for a, b in x] for s, x in zip(texts, found)], type=pa.list_(pa.string())))
            names.append("texts")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["_k"].dataType.simpleString()
    parts = "starts array<int>, ends array<int>" + (", texts array<string>" if with_text else "")
    rows = map_arrow(joined, cut, f"_k {kind}, {parts}").dropDuplicates()
    names = ["starts", "ends"] + (["texts"] if with_text else [])
    out = rows.select("_k", F.posexplode(F.arrays_zip(*names)).alias("piece_no", "u"))
    columns = [F.col("_k").alias(key), "piece_no", F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char")]
    return out.select(*columns, *([F.col("u.texts").alias("piece")] if with_text else []))
