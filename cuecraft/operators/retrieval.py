"""Search: dense, sparse and multi-vector top-k for many queries at once, rank fusion and reranking.

Queries are sent out in blocks of a fixed size, one pass over the collection for each. Every task scores its rows against
the whole block as matrix or postings products and keeps only its own best k for each query, so that k rows of a query
and task are shuffled and never the pairs. Scores rank at full precision; ``digits`` rounds them first if asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.functions import text as tx
from cuecraft.operators.encoding import Encoder, HashEncoder
from cuecraft.operators.joins import pick_join
from cuecraft.schema import CANDIDATES, RETRIEVERS, RRF_K

#: Queries sent to the tasks at once, and scores that a task works out at once.
QUERY_BLOCK = 20_000
_SCORES_AT_ONCE = 4_000_000


def top_per(df: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group by score, ties by id; Spark limits groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of ``size`` numbers, of length one, and which they are; null, zero and other vectors have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False) & (lengths == size)
    at = np.flatnonzero(there)
    if not len(at) or not size:
        return np.zeros((0, size)), at[:0]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null numbers become NaN
    m = flat[column.offsets.to_numpy()[:-1][at][:, None] + np.arange(size)]
    n = np.linalg.norm(m, axis=1)
    good = n > 0
    return m[good] / n[good, None], at[good]


def _blocks(queries: DataFrame, *columns: str) -> Iterator[list]:
    """Rows of the queries, block by block; the driver holds one block."""
    rows: list = []
    for row in queries.select(*columns).where(F.col(columns[1]).isNotNull()).toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == QUERY_BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


class Best:
    """The k best ids of each query so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows, self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries by rows of a block; minus infinity is no hit."""
        least = self.floor
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        rows, found = np.concatenate([self.rows, row]), np.concatenate([self.scores, scores[row, at]])
        names = ids[at] if self.ids is None else np.concatenate([self.ids, ids[at]])
        order = np.lexsort((names, -found, rows))
        rows, found, names = rows[order], found[order], names[order]
        first = np.searchsorted(rows, rows)  # where the row's own begin
        place = np.arange(len(rows)) - first
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], found[keep], names[keep]
        last = place == self.k - 1
        self.floor[rows[last]] = found[last]

    def batch(self, queries: list, kinds: tuple[str, str]) -> pa.RecordBatch:
        return _rows([queries[i] for i in self.rows], [] if self.ids is None else self.ids.tolist(), self.scores, kinds)


def _rows(queries: list, ids: list, scores, kinds: tuple[str, str]) -> pa.RecordBatch:
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(queries, type=arrow[kinds[0]]), pa.array(ids, type=arrow[kinds[1]]), pa.array(scores, type=pa.float64())], names=["query_id", "id", "score"])


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    return scores if digits is None else np.round(scores, digits) + 0.0


def _scored(queries: DataFrame, collection: DataFrame, q_columns: tuple[str, str], columns: tuple[str, str], prepare: Callable, score: Callable, k: int | None, least: float | None, digits: int | None) -> DataFrame:
    """``query_id, id, score`` of each task. ``prepare`` makes of a block of queries what is sent out; ``score`` gives for it
    and a slice of an Arrow batch the places of rows and the matrix of queries by rows."""
    spark = collection.sparkSession
    kinds = queries.schema[q_columns[0]].dataType.simpleString(), collection.schema[columns[0]].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    source = collection.select(*columns).where(F.col(columns[0]).isNotNull())
    parts = []
    for block in _blocks(queries, *q_columns):
        held = spark.sparkContext.broadcast(([r[0] for r in block], prepare([r[1] for r in block])))

        def run(batches, held=held):
            names, sent = held.value
            best = Best(len(names), k) if least is None else None
            step = max(1, _SCORES_AT_ONCE // max(1, len(names)))
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    at, scores = score(sent, part.column(1))
                    if not len(at):
                        continue
                    ids = np.array(part.column(0).take(pa.array(at)).to_pylist())
                    scores = _rounded(scores, digits)
                    if best is not None:
                        best.add(scores, ids)
                        continue
                    q, d = np.nonzero(scores >= least)
                    yield _rows([names[i] for i in q], ids[d].tolist(), scores[q, d], kinds)
            if best is not None:
                yield best.batch(names, kinds)

        parts.append(source.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _unit(vectors: list) -> np.ndarray:
    """Vectors as rows of length one; null, zero and odd ones are zero, and have no score above zero."""
    size = max((len(v) for v in vectors), default=0)
    m = np.array([v if len(v) == size and None not in v else [0.0] * size for v in vectors], dtype=np.float64).reshape(len(vectors), size)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _cosines(q: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    m, at = _matrix(column, q.shape[1])
    scores = q @ m.T
    scores[~q.any(axis=1)] = -np.inf
    return at, scores


def dense_scores(queries: DataFrame, vectors: DataFrame, q_id: str, q_vec: str, v_id: str, v_vec: str, k: int | None, least: float | None = None, digits: int | None = None) -> DataFrame:
    """``query_id, id, score``: each task's best k for a query, or all scores of at least ``least``. Scores are cosines.

    Null, empty and zero vectors match nothing, nor do vectors of another size than the queries'.
    """
    return _scored(queries, vectors, (q_id, q_vec), (v_id, v_vec), _unit, _cosines, k, least, digits)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "dense", v_id: str = "id", v_vec: str = "dense", digits: int | None = None) -> DataFrame:
    """The k nearest vectors of every query by cosine: ``query_id, id, score, rank``; ties by id."""
    return top_per(dense_scores(queries, vectors, q_id, q_vec, v_id, v_vec, k, None, digits), "query_id", "score", "id", k)


def similar(queries: DataFrame, vectors: DataFrame, threshold: float, digits: int | None = None, **names: str) -> DataFrame:
    """All pairs of a query and a vector with a cosine of at least the threshold (equal counts)."""
    n = {"q_id": "query_id", "q_vec": "dense", "v_id": "id", "v_vec": "dense"} | names
    return dense_scores(queries, vectors, n["q_id"], n["q_vec"], n["v_id"], n["v_vec"], None, threshold, digits)


def _postings(weights: list[dict]) -> tuple[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Queries and their positive weights by token."""
    by_token: dict[str, list] = {}
    for i, tokens in enumerate(weights):
        for token, w in tokens.items():
            if w is not None and w > 0:
                by_token.setdefault(token, []).append((i, w))
    return len(weights), {t: (np.array([i for i, _ in p]), np.array([w for _, w in p], dtype=np.float64)) for t, p in by_token.items()}


def _lexical(sent: tuple, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size, postings = sent
    at, out = [], []
    for i, weights in enumerate(column.to_pylist()):
        hits = [(postings[t], w) for t, w in weights or () if w is not None and w > 0 and t in postings]
        if hits:
            row = np.zeros(size)
            for (who, weight), w in hits:
                row[who] += weight * w
            row[row <= 0] = -np.inf
            at.append(i)
            out.append(row)
    return np.array(at, dtype=np.int64), np.array(out).T if out else np.zeros((size, 0))


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int, q_id: str = "query_id", d_id: str = "id", weights: str = "sparse", digits: int | None = None) -> DataFrame:
    """The k best documents by the dot product of token weights (maps): ``query_id, id, score, rank``.

    Weights of zero or less are dropped; a document without a common token is no hit.
    """
    found = _scored(queries, docs, (q_id, weights), (d_id, weights), _postings, _lexical, k, None, digits)
    return top_per(found, "query_id", "score", "id", k)


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_K, digits: int | None = 9) -> DataFrame:
    """Ranked lists (``query_id, id, rank``) fused by reciprocal ranks: ``query_id, id, score, rank``. Sums of the same
    ranks in another order are ties, so scores are rounded to nine digits."""
    union = reduce(DataFrame.unionByName, (x.select("query_id", "id", "rank") for x in lists))
    total = F.sum(1.0 / (constant + F.col("rank")))
    fused = union.groupBy("query_id", "id").agg((total if digits is None else F.round(total, digits)).alias("score"))
    return top_per(fused, "query_id", "score", "id", k)


def candidates(lists: list[DataFrame]) -> DataFrame:
    """The distinct union of ranked lists: ``query_id, id``."""
    return reduce(DataFrame.unionByName, (x.select("query_id", "id") for x in lists)).distinct()


def _late(q: list[np.ndarray], column: pa.Array, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """MaxSim of every query's vectors with those of each row: sums of the best cosines, which ``digits`` rounds, too."""
    size = q[0].shape[1] if q else 0
    every = np.concatenate(q) if q else np.zeros((0, size))
    starts = np.cumsum([0, *(len(x) for x in q)])[:-1]
    docs = column.to_pylist()
    flat = pa.array([v for d in docs for v in d or ()], type=pa.list_(pa.float64()))
    owner = np.repeat(np.arange(len(docs)), [len(d or ()) for d in docs])
    m, at = _matrix(flat, size)
    if not len(at) or not len(every):
        return np.zeros(0, dtype=np.int64), np.zeros((len(q), 0))
    owner = owner[at]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    best = np.maximum.reduceat(_rounded(every @ m.T, digits), begin, axis=1)
    return owner[begin], np.add.reduceat(best, starts, axis=0)


def maxsim_search(queries: DataFrame, docs: DataFrame, k: int, q_id: str = "query_id", d_id: str = "id", vectors: str = "colbert", digits: int | None = None) -> DataFrame:
    """Late interaction over a whole collection (``vectors``: arrays of vectors): ``query_id, id, score, rank``. Exact; no
    pair leaves a task. Queries without a vector, and documents without one, have no hits."""
    asked = queries.where(F.size(vectors) > 0)
    found = _scored(asked, docs, (q_id, vectors), (d_id, vectors), lambda v: [_unit(x) for x in v], partial(_late, digits=digits), k, None, digits)
    return top_per(found, "query_id", "score", "id", k)


def maxsim_topk(pairs: DataFrame, queries: DataFrame, docs: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """Late interaction over candidate pairs (``query_id, id``); both sides one row per vector (``.., vec``).

    ``query_id, id, score, rank``; the score sums over the query's vectors the best cosine in the document.
    """
    from cuecraft.functions.vectors import cosine

    q = queries.select("query_id", F.col("no").alias("q_no"), F.col("vec").alias("q_vec"))
    d = docs.select("id", F.col("vec").alias("d_vec"))
    total = F.sum("best")
    best = (
        pairs.join(q, "query_id").join(d, "id")
        .groupBy("query_id", "id", "q_no").agg(F.max(cosine(F.col("q_vec"), F.col("d_vec"))).alias("best"))
        .groupBy("query_id", "id").agg((total if digits is None else F.round(total, digits)).alias("score"))
    )
    return top_per(best, "query_id", "score", "id", k)


def rerank(hits: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, k: int, pool: int = CANDIDATES) -> DataFrame:
    """The k best of the first ``pool`` hits by another score; all other columns stay."""
    first = hits.where(F.col("rank") <= pool).drop("rank", "score")
    scored = first.withColumn("score", score) if isinstance(score, Column) else score(first)
    return top_per(scored, "query_id", "score", "id", k)


def coverage_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """Cross-encoder stand-in: share of the query's tokens in the document, damped by its length."""
    q = F.array_distinct(query_tokens)
    share = F.size(F.array_intersect(q, doc_tokens)) / F.greatest(F.size(q), F.lit(1))
    return F.round(share / (1.0 + F.size(doc_tokens) / 1000.0), 6)


def coverage_reranker(pairs: DataFrame) -> DataFrame:
    """The stand-in as a reranker: pairs with ``q_text`` and ``d_text`` get a ``score``."""
    return pairs.withColumn("score", coverage_score(tx.tokens(F.col("q_text")), tx.tokens(F.col("d_text"))))


def retriever(kind: str) -> str:
    """The name of a retriever, checked."""
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever {kind!r}; one of {', '.join(RETRIEVERS)}")
    return kind


#: A retriever maps encoded queries, an encoded collection, how many hits and candidates are wanted, and digits to hits.
Retriever = Callable[[DataFrame, DataFrame, int, int, "int | None"], DataFrame]


def _dense(q: DataFrame, c: DataFrame, limit: int, pool: int, digits: int | None) -> DataFrame:
    return dense_topk(q, c, limit, digits=digits)


def _hybrid(q: DataFrame, c: DataFrame, limit: int, pool: int, digits: int | None) -> DataFrame:
    return rrf([sparse_topk(q, c, pool, digits=digits), dense_topk(q, c, pool, digits=digits)], limit)


def _hybrid_colbert(q: DataFrame, c: DataFrame, limit: int, pool: int, digits: int | None) -> DataFrame:
    pairs = candidates([sparse_topk(q, c, pool, digits=digits), dense_topk(q, c, pool, digits=digits)])
    each = lambda df, key: df.select(key, F.posexplode("colbert").alias("no", "vec"))
    picked = pick_join(c.select("id", "colbert"), pairs.select("id").distinct(), "id")
    return maxsim_topk(pairs, each(q, "query_id"), each(picked, "id"), limit, digits)


BUILT_IN: dict[str, Retriever] = {"dense": _dense, "hybrid": _hybrid, "hybrid+colbert": _hybrid_colbert}


def search(
    queries: DataFrame, collection: DataFrame, kind: str | Retriever = "hybrid", limit: int = 5, reranking: bool = False, pool: int = CANDIDATES,
    encoder: Encoder | None = None, reranker: Callable[[DataFrame], DataFrame] = coverage_reranker, digits: int | None = None,
) -> DataFrame:
    """Top hits of text queries (``query_id, text``) in a collection (``id, text``): ``query_id, id, score, rank``.

    ``kind`` names a retriever or is one. Queries, and a collection without vectors, are encoded by ``encoder`` (the
    built-in hash encoder by default). ``reranking`` gives the first ``pool`` hits, with ``q_text`` and ``d_text``, to
    ``reranker`` for another ``score``.
    """
    run = BUILT_IN[retriever(kind)] if isinstance(kind, str) else kind
    encoder = encoder or HashEncoder()
    parts = ("dense",) if kind == "dense" else ("dense", "sparse") if kind == "hybrid" else ("dense", "sparse", "colbert")
    q = encoder.encode(queries, "query_id", "text", parts)
    c = collection if set(parts) <= set(collection.columns) else encoder.encode(collection.select("id", "text"), "id", "text", parts)
    hits = run(q, c, max(limit, pool) if reranking else limit, pool, digits).select("query_id", "id", "score", "rank")
    if not reranking:
        return hits
    texts = pick_join(collection.select("id", F.col("text").alias("d_text")), hits, "id").join(queries.select("query_id", F.col("text").alias("q_text")), "query_id")
    return rerank(texts, reranker, limit, pool).select("query_id", "id", "score", "rank")


def lecture_items(hits: DataFrame, lectures: DataFrame) -> DataFrame:
    """Hits with what was found: ``query_id, rank, score, text, video_location``. The place is null unless both course and
    lecture are known; its times are texts."""
    from cuecraft.functions.timefmt import clock

    place = F.struct("course_id", "lecture_id", clock(F.col("start_us")).alias("start_time"), clock(F.col("end_us")).alias("end_time"))
    rows = lectures.select("id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("course_id").isNotNull() & F.col("lecture_id").isNotNull(), place).alias("video_location"))
    return pick_join(rows, hits, "id").select("query_id", "rank", F.col("score").cast("double").alias("score"), "text", "video_location")


def entity_items(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Hits with their entities: ``query_id, rank, id, score, entity``."""
    rows = entities.select(F.col("id"), F.struct("name", "label", "entity_instances").alias("entity"))
    return pick_join(rows, hits, "id").select("query_id", "rank", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), "entity")


def sparse_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lexical weights of the built-in encoder: ``key, sparse``."""
    return HashEncoder().encode(df, key, text, ("sparse",))
