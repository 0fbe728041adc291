"""Queries over retrieval: documents as chunks, benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..runtime import table
from .base import query
from .text_queries import TOKENS_SQL

_BM25 = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS plus FROM tf, n GROUP BY term, n),
idf AS (SELECT term, df, plus, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s)"""

_HASH = """hv AS (SELECT {i} AS id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {i})) AS v FROM (
  SELECT {i}, CAST(('0x' || substr(md5(t), 31, 2)) AS INTEGER) % 128 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {i}, unnest([x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> '']) AS t FROM {t}) GROUP BY 1, 2))"""
_DENSE = _HASH.format(i="doc_id", t="documents") + ", " + _HASH.format(i="item_id", t="benchmark").replace("hv AS", "qv AS", 1) + """,
ds AS (SELECT qv.id AS query_id, hv.id AS doc_id, sum(qv.v * hv.v) AS score FROM qv JOIN hv USING (bucket) GROUP BY ALL),
da AS (SELECT q.id AS query_id, d.id AS doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT id FROM qv) q CROSS JOIN (SELECT DISTINCT id FROM hv) d LEFT JOIN ds ON ds.query_id = q.id AND ds.doc_id = d.id),
dn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM da)"""
_FUSED = f"""{_BM25}, {_DENSE}, both_lists AS (SELECT query_id, doc_id, 0 AS li, rank, round(score, 9) AS score FROM dn WHERE rank <= {{depth}} UNION ALL SELECT query_id, doc_id, 1, rank, score FROM kw WHERE rank <= {{depth}} AND score > 0),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf_score, max(rank) FILTER (WHERE li = 0) AS r0, max(rank) FILTER (WHERE li = 1) AS r1, max(score) FILTER (WHERE li = 0) AS s0, max(score) FILTER (WHERE li = 1) AS s1, min(li * 1000000 + rank) AS f1 FROM both_lists GROUP BY ALL),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, f1) AS INTEGER) AS rank FROM f)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text")


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def e7_bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    terms = R.postings(docs, "doc_id")
    return R.idf(terms, R.corpus_size(docs, terms)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM kw WHERE rank <= 5 AND score > 0")
def i3_bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(_docs(spark, d), _asked(spark, d), "doc_id", "item_id", 5).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM kw WHERE rank <= 10 AND score > 0")
def i3_block_max(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by bounds of blocks: exact."""
    return R.bm25_block_max(_docs(spark, d), _asked(spark, d), "doc_id", "item_id", 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, kw.doc_id, q.term, round(plus, 3) AS idf, CAST(coalesce(tf, 0) AS BIGINT) AS tf FROM kw JOIN q USING (query_id) JOIN idf USING (term) LEFT JOIN tf ON tf.doc_id = kw.doc_id AND tf.term = q.term WHERE rank <= 2 AND score > 0")
def i3b_bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _asked(spark, d)
    return R.bm25_explain(docs, asked, R.bm25_search(docs, asked, "doc_id", "item_id", 2), "doc_id", "item_id")


@query(f"SELECT count(DISTINCT term) AS n_terms FROM (SELECT unnest({TOKENS_SQL.format('text')}) AS term FROM documents)")
def i3c_vocabulary_size(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).agg(F.count_distinct("term").alias("n_terms"))


@query(f"WITH {_BM25} SELECT query_id, term, qn, idf IS NOT NULL AS in_corpus FROM q LEFT JOIN idf USING (term)")
def d8_query_postings(spark: SparkSession, d: str) -> DataFrame:
    terms = R.postings(_docs(spark, d), "doc_id").select("term").distinct().withColumn("known", F.lit(True))
    return R.query_terms(_asked(spark, d), "item_id").join(terms, "term", "left").select("query_id", "term", "qn", F.coalesce("known", F.lit(False)).alias("in_corpus"))


_COS = "round(list_sum([CAST(x AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE) FOR x, i IN q.embedding]), 9)"
_VEC = f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, {_COS} AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"WITH {_VEC} SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def i1_dense_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.dense_search(v, v.where("id % 50 = 0"), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_WITHIN = f"WITH {_VEC} SELECT query_id, CAST(label AS BIGINT) AS label, id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= {{n}}"


@query(_WITHIN.format(n=2))
def i2_dense_within(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.dense_search(v, v.where("id % 50 = 0"), 2, within="label").select("query_id", "label", "id", "rank", F.round("score", 6).alias("score"))


@query(_WITHIN.format(n=1))
def f7_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.dense_search(v, v.where("id % 50 = 0"), 1, within="label").select("query_id", "label", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE label = 3) WHERE rank <= 5")
def c7_metadata_prefilter(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.dense_search(v.where("label = 3"), v.where("id % 50 = 0"), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED.format(depth=10)} SELECT query_id, doc_id, rank, round(rrf_score, 9) AS rrf_score, r0 AS semantic_rank, r1 AS keyword_rank FROM fused")
def i4_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _docs(spark, d), _asked(spark, d)
    dense = R.dense_search(R.dense_vectors(docs, "doc_id"), R.dense_vectors(asked, "item_id"), 10).withColumnRenamed("id", "doc_id")
    fused = R.fuse([dense, R.bm25_search(docs, asked, "doc_id", "item_id", 10)], "doc_id")
    return fused.select("query_id", "doc_id", "rank", F.round("rrf_score", 9).alias("rrf_score"), F.col("ranks")[0].alias("semantic_rank"), F.col("ranks")[1].alias("keyword_rank"))


@query(f"WITH {_FUSED.format(depth=15)} SELECT query_id, doc_id, rank, round(rrf_score, 9) AS rrf_score FROM fused WHERE rank <= 5")
def i5_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_docs(spark, d), _asked(spark, d), 5).select("query_id", "doc_id", "rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""WITH {_FUSED.format(depth=10)} SELECT query_id, doc_id, printf('rrf %.4f  [semantic ', rrf_score) || CASE WHEN r0 IS NULL THEN '—' ELSE printf('#%d (%.2f)', r0, s0) END || ', keyword ' || CASE WHEN r1 IS NULL THEN '—' ELSE '#' || r1 END || ']' AS why FROM fused WHERE rank <= 3""")
def i6_fusion_text(spark: SparkSession, d: str) -> DataFrame:
    # BM25 scores are long sums; their two digits in the text are cut, so that a tie in rounding can't differ
    fused = R.hybrid(_docs(spark, d), _asked(spark, d), 3)
    why = R.fusion_text(F.col("rrf_score"), F.col("ranks"), F.col("source_scores"))
    return fused.select("query_id", "doc_id", F.regexp_replace(why, r"keyword (#\d+) \([\d.]+\)", "keyword $1").alias("why"))


_LOGIT = f"CASE WHEN len(list_distinct({TOKENS_SQL.format('b.text')})) = 0 THEN -3.0 ELSE 6.0 * len(list_intersect(list_distinct({TOKENS_SQL.format('b.text')}), {TOKENS_SQL.format('d.text')})) / len(list_distinct({TOKENS_SQL.format('b.text')})) - 3.0 END"
_RERANKED = f"rr AS (SELECT query_id, fused.doc_id, fused.rank AS old, rrf_score, {_LOGIT} AS logit FROM fused JOIN documents d ON d.doc_id = fused.doc_id JOIN benchmark b ON b.item_id = query_id WHERE fused.rank <= 10), re AS (SELECT *, 1 / (1 + exp(-logit)) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-logit)), 9) DESC, old) AS INTEGER) AS rank FROM rr)"


def _reranked(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    docs, asked = _docs(spark, d), _asked(spark, d)
    terms = asked.select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    hits = R.hybrid(docs, asked, 10).join(docs, "doc_id").join(terms, "query_id")
    return R.rerank(hits, R.overlap_logit(F.col("asked"), T.tokens(F.col("text"))), "doc_id", n, "rrf_score")


@query(f"WITH {_FUSED.format(depth=30)}, {_RERANKED} SELECT query_id, doc_id, rank, round(score, 6) AS score, round(rrf_score, 9) AS retrieval_score, round(logit, 6) AS rerank_logit, score >= 0.15 AS above_floor FROM re")
def i7_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.round("retrieval_score", 9).alias("retrieval_score"), F.round("rerank_logit", 6).alias("rerank_logit"), "above_floor")


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(1 / (1 + exp(-(count(*) OVER (PARTITION BY query_id) - (rank - 1)))), 9) AS score FROM kw WHERE rank <= 10 AND score > 0")
def i7b_noop_rerank(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    hits = R.bm25_search(_docs(spark, d), _asked(spark, d), "doc_id", "item_id", 10).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return R.rerank(hits, R.no_op_logit(F.col("n"), F.col("rank")), "doc_id").select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {_FUSED.format(depth=30)}, {_RERANKED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM re WHERE rank <= 3")
def i8_reranked_search(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 3).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED.format(depth=30)}, {_RERANKED} SELECT query_id, doc_id, round(score, 6) AS score FROM re WHERE score >= 0.15")
def c8_relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).where("above_floor").select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED.format(depth=30)}, {_RERANKED} SELECT query_id, doc_id, rank FROM re WHERE rank <= 5 AND score >= 0.15")
def c9_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 5).where("above_floor").select("query_id", "doc_id", "rank")


@query(f"WITH {_BM25}, b AS (SELECT query_id, source AS candidate, max(score) AS score FROM kw JOIN documents USING (doc_id) WHERE rank <= 10 AND score > 0 GROUP BY ALL) SELECT q.item_id AS query_id, c.candidate, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT item_id FROM benchmark) q CROSS JOIN (SELECT DISTINCT source AS candidate FROM documents) c LEFT JOIN b ON b.query_id = q.item_id AND b.candidate = c.candidate")
def e34_best_per_candidate(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    owners = docs.select("doc_id", F.col("source").alias("candidate"))
    hits = R.bm25_search(_docs(spark, d), asked, "doc_id", "item_id", 10).join(owners, "doc_id")
    return R.best_per_candidate(hits, owners, asked.select(F.col("item_id").alias("query_id"))).select("query_id", "candidate", F.round("score", 6).alias("score"))
