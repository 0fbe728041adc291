"""Exact top-k by exhaustive term-at-a-time accumulation.

A term is a dimension, a weight is floor(256 * component), and a vector's score for a query is the integer inner
product. Candidates are packed into blocks of a few hundred vectors as postings (for each term the rows that hold it
and their weights); queries are packed into blocks of sparse rows. Every block of queries meets every block of
candidates: each query row scatters its weighted postings, term by term, into a dense array of scores, partition
selection keeps its k best, and the k best of all blocks are merged per query.

Blocks meet in a grid: queries are in groups and candidates in buckets, a query block goes to every bucket and a candidate
block to every group, and the join is by both. It is a sort-merge join, which streams the candidates and holds the query
blocks of one key: of one group, about ``QUERY_BLOCKS`` or 128 MB, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare, stored

#: Weights (vectors x dimensions) of one block, which bounds a joined row to about 128 KB.
BLOCK_CELLS = 32_768
#: Blocks of queries in a group, about.
QUERY_BLOCKS = 1024
LIMIT = 1 << 31


def _weights(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 x) of ragged vectors as one array of longs, absent components zero. Beyond 64 bits: the nearest long."""
    n = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), n))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.clip(np.floor(out * 256), -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, key, embedding) as blocks (ids, keys, dims, weights)."""
    ids: list[int] = []
    keys: list[int] = []
    vectors: list[list[float]] = []

    def block() -> pa.RecordBatch:
        w = _weights(vectors)
        narrow = not w.size or np.abs(w.astype(float)).max() < LIMIT
        cells = [np.array(ids, np.int64), np.array(keys, np.int64), w.astype(np.int32) if narrow else w]
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in cells), pa.array([w.shape[1]], pa.int32())], names=["ids", "keys", "weights", "dims"])

    for batch in batches:
        for vec_id, key, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "key", "embedding")), strict=True):
            ids.append(vec_id)
            keys.append(key)
            vectors.append(v)
            if len(ids) * max(len(v), 1) >= BLOCK_CELLS:
                yield block()
                ids, keys, vectors = [], [], []
    if ids:
        yield block()


def _unpacked(ids: bytes, keys: bytes, weights: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    wide = len(weights) == 8 * len(own) * dims and dims > 0
    return own, np.frombuffer(keys, np.int64), np.frombuffer(weights, np.int64 if wide else np.int32).astype(np.int64).reshape(len(own), dims)


class Postings:
    """For each term the rows that hold it, or all rows where nearly all do, with their weights."""

    def __init__(self, weights: np.ndarray, kind: type):
        self.terms = []
        for column in np.ascontiguousarray(weights.T.astype(kind)):
            rows = np.flatnonzero(column)
            self.terms.append((None, column) if 2 * len(rows) > len(column) else (rows, column[rows]))

    def add(self, scores: np.ndarray, term: int, weight: int, spare: np.ndarray) -> None:
        rows, weights = self.terms[term]
        if rows is None:
            np.multiply(weights, weight, out=spare)
            np.add(scores, spare, out=scores)
        elif len(rows):
            scores[rows] += weights * weight


PARTS = ("ids", "keys", "weights", "dims")


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        last, postings = None, None
        for row in zip(*(batch.column(c) for c in (*(f"q_{c}" for c in PARTS), *PARTS)), strict=True):
            q_ids, q_keys, q = _unpacked(*(x.as_py() for x in row[:4]))
            raw = row[5].as_py()
            if raw != last:
                last = raw
                ids, keys, w = _unpacked(*(x.as_py() for x in row[4:]))
                top_w, postings = float(np.abs(w.astype(float)).max(initial=0)), {}
            bound = top_w * float(np.abs(q.astype(float)).max(initial=0)) * max(1, min(q.shape[1], w.shape[1]))
            kind = np.int32 if bound < LIMIT else np.int64 if bound < 2.0**62 else object
            if kind not in postings:
                postings[kind] = Postings(w, kind)
            own, scores, spare = postings[kind], np.zeros(len(ids), kind), np.zeros(len(ids), kind)
            for query_id, key, weights in zip(q_ids.tolist(), q_keys.tolist(), q, strict=True):
                scores[:] = 0
                terms = np.flatnonzero(weights[: w.shape[1]])
                for term, weight in zip(terms.tolist(), weights[terms].tolist(), strict=True):
                    own.add(scores, term, weight, spare)
                s = scores if kind is not object else np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores], np.int64)
                at = np.flatnonzero(keys != key)
                if len(at) > k:
                    cut = np.partition(s[at], len(at) - k)[len(at) - k]
                    at = at[s[at] >= cut]
                    at = at[np.lexsort((ids[at], ~s[at]))][:k]  # ~ turns the order round without an overflow
                out[0] += [query_id] * len(at)
                out[1] += [key] * len(at)
                out[2] += ids[at].tolist()
                out[3] += s[at].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "key", "vec_id", "score"])


def usable(embedding: str = "embedding") -> Column:
    """Neither null nor holding a null or a component that isn't finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _taken(df: DataFrame, key: Column) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), key.cast("long").alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())


def _grid(candidates: DataFrame, queries: DataFrame, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """The blocks of both that meet, and the query blocks by the keys they meet at."""
    packed = lambda df: df.mapInArrow(_blocks, "ids binary, keys binary, weights binary, dims int")
    asked = stored(packed(queries), "query-blocks")
    groups = max(1, -(-asked.count() // QUERY_BLOCKS))
    n = max(1, -(-(buckets or int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // groups))
    number = lambda k, *of: F.expr(f"pmod(xxhash64({', '.join(of)}), {k})")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    own = packed(candidates).withColumn("bucket", number(n, "keys", "ids")).withColumn("group", every(groups))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in PARTS], number(groups, "keys", "ids").alias("group")).withColumn("bucket", every(n))
    return own.join(asked.hint("merge"), ["group", "bucket"]), asked


def _top(candidates: DataFrame, queries: DataFrame, k: int, buckets: int | None) -> DataFrame:
    """The k best of each query row (vec_id, key, embedding) among the candidate rows with another key."""
    met = _grid(candidates, queries, buckets)[0].select(*[f"q_{c}" for c in PARTS], *PARTS)
    best = met.mapInArrow(lambda batches: _scored(batches, k), "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Both tables have vec_id and embedding; a query has one row, and candidates with its vec_id take no part. Rows with a
    null id or an unusable vector take no part; vectors of different lengths are compared where both have components.
    With fewer than k candidates all are returned; scores beyond a long become the nearest long. Further columns are not
    read. ``buckets``: parts of the candidates, the session's shuffle partitions by default.
    """
    prepare(vectors.sparkSession)
    return _top(_taken(vectors, F.col("vec_id")), _taken(queries, F.col("vec_id")), k, buckets)


def top_k_self(vectors: DataFrame, every: int = 50, k: int = 5, buckets: int | None = None) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own.

    Rows are numbered and written once, since rows may repeat: each repeated row is a query, and a candidate for its likes.
    """
    prepare(vectors.sparkSession)
    own = stored(_taken(vectors, F.monotonically_increasing_id()), "numbered-vectors")
    return _top(own, own.where(F.col("vec_id") % every == 0), k, buckets)


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
