"""Queries over plug-ins, profile loading, incremental ingest, and plan shapes that others are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import plugins as L
from ..operators import profile as P
from ..operators import retrieval as R
from ..runtime import fresh_dir, prepare, table
from ..streaming.ingest import current, ingest, keyword_search, statistics, structured_rows
from .base import AS_OF, brands, html_lines, query
from .search_queries import _BM25, _FUSED, _RERANKED, _reranked
from .search_queries import _HASH as HASH_SQL
from .text_queries import _COHERENT, _JOB, FLAT_CHUNKS, TOKENS_SQL, jobs, with_headings

_WORDS = "[x FOR x IN regexp_split_to_array(lower({}), '\\s+') IF x <> '']"


@query(f"""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM (
  SELECT doc_id, CAST(('0x' || substr(md5(t), 31, 2)) AS INTEGER) % 128 AS bucket, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS t FROM documents) GROUP BY 1, 2)""")
def l1_embedder(spark: SparkSession, d: str) -> DataFrame:
    v = L.embedded(table(spark, d, "documents"), "doc_id", "text", L.hash_embedder())
    return v.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select("doc_id", "bucket", F.round("value", 6).alias("value"))


_SHARED = f"CAST(len(list_intersect(list_distinct({_WORDS.format('b.text')}), list_distinct({_WORDS.format('d.text')}))) - 2 AS DOUBLE)"


@query(f"WITH {_BM25}, h AS (SELECT query_id, kw.doc_id, rank AS old, {_SHARED} AS logit FROM kw JOIN documents d ON d.doc_id = kw.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10 AND score > 0) SELECT query_id, doc_id, logit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-logit)), 9) DESC, old) AS INTEGER) AS rank FROM h")
def l2_reranker(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    hits = R.bm25_search(docs, asked, "doc_id", "item_id", 10).join(docs, "doc_id").join(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    out = R.rerank(hits, L.scorer(L.shared_words)(F.col("query"), F.col("text")), "doc_id")
    return out.select("query_id", "doc_id", F.col("rerank_logit").alias("logit"), "rank")


@query(f"WITH {_FUSED.format(depth=30)} SELECT 'bm25' AS config, query_id, doc_id, rank FROM kw WHERE rank <= 5 AND score > 0 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dn WHERE rank <= 5")
def l3_search_functions(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return L.compared({"bm25": lambda: R.bm25_search(docs, asked, "doc_id", "item_id", 5), "dense": lambda: R.dense_search(R.dense_vectors(docs, "doc_id"), R.dense_vectors(asked, "item_id"), 5).withColumnRenamed("id", "doc_id")}, 5)


@query("WITH a AS (SELECT label AS query_id, vec_id AS vector_key, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings), b AS (SELECT label AS query_id, vec_id AS vector_key, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS INTEGER) AS rank FROM embeddings), u AS (SELECT * FROM a WHERE rank <= 40 UNION ALL SELECT * FROM b WHERE rank <= 40) SELECT query_id, vector_key, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM u GROUP BY ALL")
def l4_id_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("vector_key"))
    lists = [e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(o))).where("rank <= 40").withColumn("score", F.lit(0.0)) for o in (F.asc("vector_key"), F.desc("vector_key"))]
    return R.fuse(lists, "vector_key").select("query_id", "vector_key", F.round("rrf_score", 9).alias("rrf_score"))


_COS = "round(list_sum([CAST(x AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE) FOR x, i IN q.embedding]), 9)"


@query(f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) AS r FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE r <= 20")
def d7_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.dense_search(v, v.where("id % 50 = 0"), 20, include_self=False).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_FUSED.format(depth=10)} SELECT query_id, doc_id, r0 IS NOT NULL AS in_dense, r1 IS NOT NULL AS in_keyword FROM fused")
def d9_ranked_merge(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    fused = R.hybrid(docs, asked, 10_000, depth=10)
    return fused.select("query_id", "doc_id", F.col("ranks")[0].isNotNull().alias("in_dense"), F.col("ranks")[1].isNotNull().alias("in_keyword"))


@query(f"WITH {_FUSED.format(depth=30)}, {_RERANKED} SELECT query_id, doc_id, round(score, 6) AS relevance, rank FROM re")
def g4_rerank_order(spark: SparkSession, d: str) -> DataFrame:
    """All hits, by relevance and then by the order they came in."""
    return _reranked(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("relevance"), "rank")


_LEVEL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END"


@query(f"""WITH j AS ({_JOB}), c AS ({_COHERENT}), x AS (SELECT o_custkey, start_year * 12 + coalesce(start_month, 1) - 1 AS s, CASE WHEN is_current THEN {AS_OF * 12} WHEN end_year IS NOT NULL THEN end_year * 12 + coalesce(end_month, 1) - 1 END AS e FROM c),
r AS (SELECT o_custkey, s, max(e) AS e FROM x WHERE e > s GROUP BY 1, 2), g AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
t AS (SELECT o_custkey, CAST(sum(greatest(0, e - greatest(s, coalesce(m, s)))) AS INTEGER) AS months FROM g GROUP BY 1),
k AS (SELECT o_custkey, max({_LEVEL}) AS ladder, bool_or(o_orderstatus = 'O') AS employed FROM orders GROUP BY 1)
SELECT 'c' || o_custkey AS resume_id, coalesce(months, 0) AS total_experience_months, ['unknown', 'school', 'diploma', 'bachelor', 'master', 'doctorate'][ladder + 1] AS highest_degree, employed AS currently_employed FROM k LEFT JOIN t USING (o_custkey)""")
def i20_load_profiles(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    level = F.when(first == "1", "doctorate").when(first == "2", "master").when(first == "3", "bachelor").when(first == "4", "diploma").otherwise("school")
    own = jobs(spark, d).join(table(spark, d, "orders").select("o_orderkey", level.alias("level")), "o_orderkey")
    job = F.struct(F.lit("x").alias("company"), "start_year", "start_month", "end_year", "end_month", "is_current")
    records = own.groupBy("o_custkey").agg(F.collect_list(job).alias("experience"), F.collect_list(F.struct("level")).alias("education"))
    profile = F.struct(F.lit("n").alias("full_name"), F.array(F.lit("s")).alias("skills"), "experience", "education")
    out = P.load_profiles(records.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("resume_id"), profile.alias("profile")), AS_OF * 12)
    return out.select("resume_id", "total_experience_months", "highest_degree", "currently_employed")


_RECORD_JOB = f"rj AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE start_year END AS start_year, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE start_month END AS start_month, end_year, end_month, is_current FROM ({_JOB})), c AS ({_COHERENT.replace('FROM j', 'FROM rj')})"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Customers as extracted records: orders as jobs and schools, bought brands as skills, some in other letters or in short."""
    k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    level = F.when(first == "1", " Doctorate").when(first == "2", "master").when(first == "3", "BACHELOR").when(first == "4", "certificate").otherwise("school")
    own = jobs(spark, d).join(table(spark, d, "orders").select("o_orderkey", level.alias("level")), "o_orderkey")
    job = F.struct("o_orderkey", F.concat(F.lit("company "), k).alias("company"), F.when(k % 19 == 0, 1900).otherwise(F.col("start_year")).alias("start_year"), F.when(k % 17 == 0, 13).otherwise(F.col("start_month")).alias("start_month"), "end_year", "end_month", "is_current")
    school = F.struct("o_orderkey", "level", (F.col("start_year") - 3).alias("start_year"), F.when(k % 7 == 0, 3000).otherwise(F.col("start_year")).cast("int").alias("end_year"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("o_orderkey"))
    by_job = own.groupBy("o_custkey").agg(in_order(job).alias("experience"), in_order(school).alias("education"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    name = F.when(F.col("l_linenumber") == 1, F.upper("p_brand")).when(F.col("l_linenumber") == 2, F.regexp_replace("p_brand", "^Brand#", "b")).when(F.col("l_linenumber") == 3, F.concat(F.lit("kind "), F.col("p_partkey") % 9)).otherwise(F.col("p_brand"))
    skills = lines.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", name.alias("name")))), lambda x: F.struct(x["name"].alias("name"))).alias("skills"))
    c = table(spark, d, "customer").join(by_job, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey").join(skills, F.col("c_custkey") == F.col("o_custkey"), "left")
    empty = F.array().cast("array<struct<name:string>>")
    profile = F.struct(F.concat(F.lit("Name "), F.col("c_custkey") % 40).alias("full_name"), F.concat(F.lit("x@"), F.col("c_nationkey") % 5).alias("email"), F.coalesce("skills", empty).alias("skills"), "experience", "education")
    return c.select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("resume_id"), F.col("c_mktsegment").alias("job_id"), profile.alias("profile"))


@query(f"WITH {_RECORD_JOB} SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS resume_id, 'company ' || o_orderkey AS company, start_year, start_month, end_year, end_month, is_current, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(start_year * 12 + coalesce(start_month, 1) - 1, -1) DESC, o_orderkey) - 1 AS INTEGER) AS position FROM c")
def i20_experience(spark: SparkSession, d: str) -> DataFrame:
    return P.loaded(records(spark, d), AS_OF * 12, AS_OF)["experience"].select("resume_id", "company", "start_year", "start_month", "end_year", "end_month", "is_current", "position")


@query("""WITH n AS (SELECT o_custkey, o_orderkey * 10 + l_linenumber AS nth, CASE l_linenumber WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'b' || substr(p_brand, 7) WHEN 3 THEN 'kind ' || p_partkey % 9 ELSE p_brand END AS surface FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
f AS (SELECT o_custkey, lower(surface) AS form, arg_min(surface, nth) AS surface FROM n GROUP BY 1, 2)
SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS resume_id, surface, coalesce(p_brand, surface) AS canonical, p_brand IS NOT NULL AS known FROM f LEFT JOIN (SELECT DISTINCT p_brand FROM part) ON form IN (lower(p_brand), 'b' || substr(p_brand, 7))""")
def i20_skills(spark: SparkSession, d: str) -> DataFrame:
    words = brands(spark, d).withColumn("alias_pos", F.length("alias"))
    return P.loaded(records(spark, d), AS_OF * 12, AS_OF, words)["skills"].select("resume_id", "surface", "canonical", "known")


@query(f"WITH k AS (SELECT o_custkey, o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'doctorate' WHEN '2' THEN 'master' WHEN '3' THEN 'bachelor' WHEN '4' THEN 'unknown' ELSE 'school' END AS level, CAST(year(o_orderdate) - 3 AS INTEGER) AS start_year, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS end_year FROM orders) SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS resume_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS edu_no, level, start_year, end_year FROM k")
def i20_education(spark: SparkSession, d: str) -> DataFrame:
    return P.loaded(records(spark, d), AS_OF * 12, AS_OF)["education"].select("resume_id", "edu_no", "level", "start_year", "end_year")


@query(f"""WITH {_RECORD_JOB}, x AS (SELECT o_custkey, start_year * 12 + coalesce(start_month, 1) - 1 AS s, CASE WHEN is_current THEN {AS_OF * 12} WHEN end_year IS NOT NULL THEN end_year * 12 + coalesce(end_month, 1) - 1 END AS e FROM c),
r AS (SELECT o_custkey, s, max(e) AS e FROM x WHERE e > s GROUP BY 1, 2), g AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
t AS (SELECT o_custkey, CAST(sum(greatest(0, e - greatest(s, coalesce(m, s)))) AS INTEGER) AS months FROM g GROUP BY 1),
k AS (SELECT o_custkey, max(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 0 ELSE 1 END) AS ladder, bool_or(o_orderstatus = 'O') AS employed FROM orders GROUP BY 1)
SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS resume_id, 'Name ' || c_custkey % 40 AS full_name, coalesce(months, 0) AS total_experience_months, ['unknown', 'school', 'diploma', 'bachelor', 'master', 'doctorate'][ladder + 1] AS highest_degree, employed AS currently_employed,
CASE WHEN min(c_custkey) OVER w <> c_custkey THEN 'c' || lpad(CAST(min(c_custkey) OVER w AS VARCHAR), 8, '0') END AS duplicate_of FROM k JOIN customer ON c_custkey = o_custkey LEFT JOIN t USING (o_custkey) WINDOW w AS (PARTITION BY c_mktsegment, c_custkey % 40, c_nationkey % 5)""")
def i20_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.loaded(records(spark, d), AS_OF * 12, AS_OF)["candidates"].select("resume_id", "full_name", "total_experience_months", "highest_degree", "currently_employed", "duplicate_of")


def ingested(spark: SparkSession, d: str) -> str:
    """An index fed by two streams with checkpoints of their own: all documents, and the benchmark's passages under negative ids."""
    place = fresh_dir(spark, "ingest")
    for name, key, own_id in (("documents", "doc_id", "doc_id"), ("benchmark", "item_id", F.expr("-1 - item_id"))):
        # a pattern, as the table may be one file or a folder
        own = table(spark, d, name).select(key, "text")
        ingest(spark, f"{d}/{name}.parque[t]", own.schema, f"{place}/index", f"{place}/{name}", id_col=own_id).awaitTermination()
    return f"{place}/index"


#: Documents and passages as ``ingested`` has them, and their chunks.
_TWO = FLAT_CHUNKS.replace("WITH RECURSIVE l AS", "WITH RECURSIVE documents AS (SELECT doc_id, text FROM main.documents UNION ALL SELECT -1 - item_id, text FROM benchmark), own_lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents), l AS").replace("FROM lines)", "FROM own_lines)")
_TWO += f", chunk AS (SELECT doc_id || '_' || part_index AS chunk_id, text, {TOKENS_SQL.format('text')} AS toks FROM flat), ctf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM chunk) GROUP BY ALL)"


@query(_TWO + " SELECT chunk_id, text FROM chunk")
def k1_incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All documents and passages through the streaming ingest into a fresh index."""
    return current(spark, ingested(spark, d)).select("chunk_id", "text")


@query(_TWO + ", " + HASH_SQL.format(i="chunk_id", t="chunk") + " SELECT id AS chunk_id, bucket, round(v, 6) AS value FROM hv")
def k1_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that the ingest kept beside the chunks."""
    own = current(spark, ingested(spark, d), "vectors")
    return own.select("chunk_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select("chunk_id", "bucket", F.round("value", 6).alias("value"))


@query(_TWO + " SELECT term, count(*) AS df FROM ctf GROUP BY term")
def k1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies that the ingest kept by changes."""
    return statistics(spark, ingested(spark, d))[0]


@query(_TWO + f""", sz AS (SELECT (SELECT count(*) FROM chunk) AS n, (SELECT sum(tf) FROM ctf) / (SELECT count(*) FROM chunk) AS avgdl),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ctf, sz GROUP BY term, n),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, sum(qn * CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM raw) ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN raw USING (term) JOIN ctf USING (term) JOIN (SELECT chunk_id, sum(tf) AS dl FROM ctf GROUP BY 1) USING (chunk_id), sz GROUP BY ALL)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5 AND score > 0""")
def k1_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 on the index as the ingest left it; a chunk of a passage is a hit like any other."""
    asked = table(spark, d, "benchmark").select("item_id", "text")
    return keyword_search(spark, ingested(spark, d), asked, "item_id", 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def k1_structured_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Pages through the ingest as I19's chunks; tests hold them against i19_chunking."""
    place, pages = fresh_dir(spark, "ingest"), table(spark, d, "pages").select("page_id", "html")
    lines_of = lambda docs: with_headings(html_lines(docs.select("doc_id", F.col("text").alias("html"))))
    ingest(spark, f"{d}/pages.parque[t]", pages.schema, f"{place}/index", f"{place}/checkpoint", chunker=structured_rows(lines_of), id_col="page_id", text_col="html").awaitTermination()
    return current(spark, f"{place}/index").drop("doc_id")
