"""Queries over ingest, stores, caches and evaluation."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators import segment as G
from ..operators.profile import coherent_dates, first_of_each
from ..runtime import fresh_dir, prepare, stored, table
from ..sources import store as S
from .base import SHARED, SQL, candidate_skills, candidates, doc_lines, part_people, query
from .rank_queries import _GRADE, _MUST, graded_sets, ranked, resume_chunks, rubric
from .search_queries import _BM25, _HASH
from .text_queries import _COHERENT, _JOB, _SECTIONS, FLAT_CHUNKS, TOKENS_SQL, b16_completeness, jobs, section_lines

_MANIFEST = "mf AS (SELECT split_part(url, '/', 4) AS job_id, CAST(page_id AS INTEGER) AS entry_no, CASE page_id % 9 WHEN 0 THEN '__MACOSX/x' || page_id WHEN 1 THEN 'a/.DS_Store' WHEN 2 THEN CASE WHEN page_id % 90 = 2 THEN '../up.pdf' ELSE 'b/cv.pdf' END WHEN 3 THEN 'c/cv.pdf' WHEN 4 THEN 'notes.txt' ELSE 'd' || page_id || '/Resume.DOCX' END AS entry_name, length(html) * CASE WHEN page_id % 50 = 7 THEN 10000 ELSE 1 END AS file_size, CAST(1 + length(html) // 10 AS BIGINT) AS compress_size FROM pages)"
_JUNK = "(entry_name LIKE '%/' OR starts_with(entry_name, '__MACOSX/') OR split_part(entry_name, '/', -1) IN ('.DS_Store', 'Thumbs.db', 'desktop.ini') OR starts_with(split_part(entry_name, '/', -1), '.'))"


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9+#. ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Pages as archive entries, with names of all kinds."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    text = k.cast("string")
    name = F.when(k % 9 == 0, F.concat(F.lit("__MACOSX/x"), text)).when(k % 9 == 1, "a/.DS_Store").when((k % 9 == 2) & (k % 90 == 2), "../up.pdf").when(k % 9 == 2, "b/cv.pdf").when(k % 9 == 3, "c/cv.pdf").when(k % 9 == 4, "notes.txt").otherwise(F.concat(F.lit("d"), text, F.lit("/Resume.DOCX")))
    size = F.length("html").cast("long")
    return p.select(F.split("url", "/")[3].alias("job_id"), k.cast("int").alias("entry_no"), name.alias("entry_name"), (size * F.when(k % 50 == 7, 10000).otherwise(1)).alias("file_size"), (1 + F.floor(size / 10)).alias("compress_size"))


@query(f"WITH {_MANIFEST} SELECT entry_no, {_JUNK} AS junk FROM mf")
def a3_junk(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).select("entry_no", S.is_junk(F.col("entry_name")).alias("junk"))


@query(f"WITH {_MANIFEST}, g AS (SELECT job_id, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS total, bool_or(starts_with(entry_name, '/') OR starts_with(entry_name, '../') OR contains(entry_name, '/../') OR substr(entry_name, 2, 1) = ':') AS unsafe, bool_or(file_size > 1000000 AND compress_size > 0 AND file_size > 200 * compress_size) AS bomb FROM mf WHERE NOT {_JUNK} GROUP BY job_id) SELECT job_id, n, total, [x FOR x IN [CASE WHEN n > 1000 THEN 'too many files' END, CASE WHEN total > 524288000 THEN 'too large' END, CASE WHEN unsafe THEN 'unsafe path' END, CASE WHEN bomb THEN 'suspicious ratio' END] IF x IS NOT NULL] AS reasons FROM g")
def a2_manifest_validation(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest_report(manifest(spark, d))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(zipfile.ZipInfo(f"{url.split('/')[-1]}.html"), html)
                z.writestr(zipfile.ZipInfo("__MACOSX/x"), url)
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.string()), pa.array(out, pa.binary())], names=["job_id", "content"])


@query("SELECT CAST(page_id AS VARCHAR) AS job_id, 0 AS entry_no, split_part(url, '/', -1) || '.html' AS entry_name, CAST(octet_length(encode(html)) AS BIGINT) AS file_size, 1 AS n FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 1, '__MACOSX/x', CAST(octet_length(encode(url)) AS BIGINT), 1 FROM pages")
def a2_archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each page as an archive, and the archives' directories."""
    prepare(spark)
    archives = table(spark, d, "pages").select("page_id", "url", "html").mapInArrow(_zipped, "job_id string, content binary")
    return S.archive_entries(archives).where("error is null").select("job_id", "entry_no", "entry_name", "file_size", F.lit(1).alias("n"))


@query(f"WITH {_MANIFEST}, b AS (SELECT *, split_part(entry_name, '/', -1) AS base, row_number() OVER (PARTITION BY job_id, split_part(entry_name, '/', -1) ORDER BY entry_no) AS n FROM mf WHERE NOT {_JUNK}) SELECT job_id, entry_no, CASE WHEN n = 1 THEN base ELSE CASE WHEN contains(entry_name, '/') THEN split_part(entry_name, '/', -2) ELSE 'dup' END || '_' || base END AS name, CASE WHEN NOT regexp_matches(lower(base), '\\.(pdf|docx)$') THEN 'unsupported_format' WHEN file_size > 26214400 THEN 'too_large' ELSE 'pending' END AS status FROM b")
def a4_flatten(spark: SparkSession, d: str) -> DataFrame:
    return S.flattened(manifest(spark, d))


_ERROR = "CASE WHEN doc_id % 37 = 5 THEN 'file needs a Password' WHEN doc_id % 41 = 7 THEN 'cross reference table is broken' END"
_REPORT = f"ff AS (SELECT lang AS job_id, CAST(doc_id AS VARCHAR) AS name, {_ERROR} AS error, CASE WHEN {_ERROR} IS NULL THEN text END AS text FROM documents), fr AS (SELECT job_id, name, error, length(text) AS n_chars, substr(sha256(text), 1, 16) AS content_hash, first_value(name) OVER (PARTITION BY job_id, sha256(text), coalesce(length(text) >= 200, false) ORDER BY name) AS first FROM ff), rep AS (SELECT job_id, name, CASE WHEN contains(lower(error), 'password') THEN 'encrypted' WHEN error IS NOT NULL THEN 'corrupt' WHEN n_chars < 200 THEN 'empty_text' WHEN first = name THEN 'parsed' ELSE 'duplicate' END AS status, CAST(n_chars AS INTEGER) AS n_chars, content_hash, CASE WHEN n_chars >= 200 AND first <> name THEN first END AS duplicate_of, error AS detail FROM fr)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, some of which their parser could not read."""
    k = F.col("doc_id")
    error = F.when(k % 37 == 5, "file needs a Password").when(k % 41 == 7, "cross reference table is broken")
    return table(spark, d, "documents").select(F.col("lang").alias("job_id"), k.cast("string").alias("name"), F.col("text").alias("content"), error.alias("error"))


@query(f"WITH {_REPORT} SELECT * FROM rep")
def a18_file_report(spark: SparkSession, d: str) -> DataFrame:
    return S.file_report(files(spark, d))


@query(f"WITH {_REPORT} SELECT name, status FROM rep WHERE status = 'empty_text'")
def c11_text_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.file_report(files(spark, d)).where("status = 'empty_text'").select("name", "status")


@query(f"WITH {_REPORT} SELECT job_id, status, count(*) AS n FROM rep GROUP BY ALL")
def e1_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.status_summary(S.file_report(files(spark, d))).select("job_id", "status", "n")


@query(f"WITH {_REPORT} SELECT job_id, count(*) FILTER (WHERE status <> 'parsed') AS not_rankable FROM rep GROUP BY job_id")
def c13_not_rankable(spark: SparkSession, d: str) -> DataFrame:
    return S.file_report(files(spark, d)).groupBy("job_id").agg(F.count_if(F.col("status") != "parsed").alias("not_rankable"))


@query(f"WITH {_REPORT} SELECT status, count(*) AS n, CASE status WHEN 'parsed' THEN 2 WHEN 'duplicate' THEN 1 ELSE 0 END AS tone FROM rep GROUP BY status")
def e22_report_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.status_summary(S.file_report(files(spark, d))).groupBy("status", "tone").agg(F.sum("n").alias("n"))


@query(f"WITH {_REPORT} SELECT count(DISTINCT job_id) AS batches, count(*) AS candidates, count(*) FILTER (WHERE status = 'duplicate') AS in_progress FROM rep")
def e21_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.file_report(files(spark, d)).agg(F.count_distinct("job_id").alias("batches"), F.count("*").alias("candidates"), F.count_if(F.col("status") == "duplicate").alias("in_progress"))


@query("SELECT content_hash, doc_id FROM (SELECT substr(sha256(text), 1, 16) AS content_hash, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def f8_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select(T.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return first_of_each(own, ["content_hash"], ["doc_id"])


@query("SELECT o_orderkey, o_totalprice, 'new' AS version FROM orders WHERE o_orderdate >= '1998-01-01' UNION ALL SELECT o_orderkey, o_totalprice, 'old' FROM orders WHERE o_orderdate < '1998-01-01'")
def a7_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    incoming = o.where("o_orderdate >= '1998-01-01'").select("o_orderkey", "o_totalprice", F.lit("new").alias("version"))
    return S.upserted(o.select("o_orderkey", "o_totalprice", F.lit("old").alias("version")), incoming, "o_orderkey")


@query("SELECT p_brand AS canonical, arg_min(p_type, p_partkey) AS known FROM part GROUP BY 1")
def a8_dimension(spark: SparkSession, d: str) -> DataFrame:
    return S.dimension(table(spark, d, "part").select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("known"), F.col("p_partkey").alias("seq")), "canonical", "known")


@query("SELECT chunk_id, vec_id FROM (SELECT vec_id // 3 AS chunk_id, vec_id, row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id DESC) AS n FROM embeddings) WHERE n = 1")
def a9_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("chunk_id"), "vec_id", F.col("vec_id").alias("load_seq"))
    return S.latest_vectors(own).select("chunk_id", "vec_id")


@query("SELECT conv_id AS chunk_id, role AS section, CAST(turn AS VARCHAR) AS chunk_index, CAST(conv_id AS VARCHAR) AS resume_id FROM conversations")
def a10_metadata(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("role").alias("section"), F.col("turn").alias("chunk_index"), F.col("conv_id").alias("resume_id"), "text")
    return S.vector_metadata(c)


@query("SELECT count(*) AS n, count(DISTINCT label) AS n_resumes, (SELECT list(vec_id ORDER BY vec_id) FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)) AS first FROM embeddings")
def a12_inspection(spark: SparkSession, d: str) -> DataFrame:
    return S.inspect_index(table(spark, d, "embeddings").withColumnRenamed("label", "resume_id"), "vec_id")


@query("SELECT doc_id AS resume_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a13_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.uncovered(table(spark, d, "documents").select(F.col("doc_id").alias("resume_id")), table(spark, d, "labels").select(F.col("doc_id").alias("resume_id")))


@query("WITH k AS (SELECT DISTINCT text, lang = 'en' AS early FROM documents) SELECT substr(sha256('hash-128|' || text), 1, 24) AS key, length(text) AS size, NOT bool_or(early) AS computed_later FROM k GROUP BY text")
def a14_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A cache filled by one batch of documents, and then by all: texts that it has are not computed again."""
    docs, path = table(spark, d, "documents"), fresh_dir(spark, "cache")
    compute = lambda later: lambda new: new.select("key", F.length("text").cast("long").alias("size"), F.lit(later).alias("computed_later"))
    S.cached(spark, docs.where("lang = 'en'"), path, "hash-128", compute(False))
    return S.cached(spark, docs, path, "hash-128", compute(True))


@query("SELECT doc_id, substr(sha256('v1|' || text), 1, 32) AS key FROM documents")
def a15_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cache_key("v1", F.col("text")).alias("key"))


_BATCH = "t AS (SELECT 'skills' AS name, resume_id FROM skill UNION ALL SELECT 'vectors', 'c' || vec_id FROM embeddings UNION ALL SELECT 'files', 'c' || doc_id FROM documents UNION ALL SELECT 'candidates', resume_id FROM cand)"


def batch_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parents with children, vectors and files; some of them belong to nobody."""
    own = lambda name, key: table(spark, d, name).select(F.concat(F.lit("c"), F.col(key)).alias("resume_id"))
    return {"candidates": candidates(spark, d), "skills": candidate_skills(spark, d), "vectors": own("embeddings", "vec_id"), "files": own("documents", "doc_id")}


@query(f"WITH {_BATCH} SELECT name, count(*) FILTER (WHERE job_id <> 'MACHINERY') AS kept, count(*) FILTER (WHERE job_id = 'MACHINERY') AS deleted, count(*) FILTER (WHERE job_id IS NULL) AS orphans, count(DISTINCT t.resume_id) FILTER (WHERE job_id <> 'MACHINERY') AS n_resumes FROM t LEFT JOIN cand ON cand.resume_id = t.resume_id GROUP BY name", "cand", "skill")
def a16_batch_delete(spark: SparkSession, d: str) -> DataFrame:
    tables = batch_tables(spark, d)
    left = None
    for name, df in S.batch_deleted(tables, "candidates", "resume_id", "MACHINERY").items():
        own = df.agg(F.count_distinct("resume_id").alias("n_resumes")).select(F.lit(name).alias("name"), "n_resumes")
        left = own if left is None else left.unionByName(own)
    return S.delete_report(tables, "candidates", "resume_id", "MACHINERY").join(left, "name")


@query("SELECT resume_id, email, duplicate_of FROM dups", "dups")
def a17_migration(spark: SparkSession, d: str) -> DataFrame:
    return S.backfilled(part_people(spark, d)).select("resume_id", "email", "duplicate_of")


def written_texts(spark: SparkSession, d: str, key: str) -> str:
    """Each benchmark item as a text file of its own, in a folder named by ``key``."""
    path = fresh_dir(spark, "texts")
    table(spark, d, "benchmark").select(F.col("item_id").alias(key), "text").repartition(key).write.partitionBy(key).text(path)
    return path


@query("SELECT 'b' AS job_id, CAST(item_id AS BIGINT) AS item_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS length, sha256(text || chr(10)) AS content_sha256 FROM benchmark")
def a1_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    found = S.scan_directory(spark, written_texts(spark, d, "item_id"), "b", (".txt",))
    return found.select("job_id", F.col("item_id").cast("long").alias("item_id"), "length", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT lang AS job_id, doc_id, source, n_chars, sha256(text) AS text_sha256 FROM documents")
def a5_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON, a folder per batch, and the union of all read back with their schema."""
    path = fresh_dir(spark, "records")
    docs = table(spark, d, "documents").select(F.col("lang").alias("job_id"), "doc_id", "source", "n_chars", "text")
    docs.write.partitionBy("job_id").json(path)
    back = S.read_records(spark, path, docs.select("doc_id", "source", "n_chars", "text", "job_id").schema, lines=True)
    return back.select("job_id", "doc_id", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CAST(item_id AS BIGINT) AS key, text FROM benchmark")
def a6_text_files(spark: SparkSession, d: str) -> DataFrame:
    found = S.read_texts(spark, written_texts(spark, d, "key"))
    return found.select(F.col("key").cast("long").alias("key"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("SELECT vec_id, label, 'second' AS model FROM embeddings UNION ALL SELECT vec_id, label, 'other' FROM embeddings")
def a11_index_reset(spark: SparkSession, d: str) -> DataFrame:
    """An index is written, reset by writing it again with other rows, and another model's rows stay."""
    path, own = fresh_dir(spark, "index"), table(spark, d, "embeddings").select("vec_id", "label")
    S.write_index(own.withColumn("model", F.lit("other")), path)
    S.write_index(own.select((F.col("vec_id") + 1).alias("vec_id"), "label", F.lit("second").alias("model")), path)
    S.write_index(own.withColumn("model", F.lit("second")), path)
    return spark.read.parquet(path).select("vec_id", "label", "model")


@query("SELECT source, lang, count(*) AS n, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def h1_chunk_union(spark: SparkSession, d: str) -> DataFrame:
    """All documents and those with labels, which are in both sets and count once."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    both = docs.join(labels, "doc_id").unionByName(docs, allowMissingColumns=True)
    return first_of_each(both, ["doc_id"], ["n_chars", F.col("quality").isNull()]).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"))


# -- evaluation ----------------------------------------------------------------------------------------------------

_RUN = f"{_BM25}, run AS (SELECT query_id, doc_id, rank FROM kw WHERE rank <= 50 AND score > 0), lab AS (SELECT query_id, doc_id, CAST(2 * quality + (1 - toxic) AS INTEGER) AS grade FROM run JOIN labels USING (doc_id)), gr AS (SELECT run.*, grade FROM run LEFT JOIN lab USING (query_id, doc_id)), nr AS (SELECT query_id, count(*) AS n_rel FROM lab WHERE grade >= 2 GROUP BY 1)"


def judged(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """Pooled relevance: each document that was found for a query and has labels, with its grade."""
    own = table(spark, d, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    return hits.select("query_id", "doc_id").distinct().join(own, "doc_id").select("query_id", "doc_id", "grade")


def run(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return R.bm25_search(docs, asked, "doc_id", "item_id", 50).select("query_id", "doc_id", "rank")


def graded_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stored run with grades, and its labels."""
    own = stored(run(spark, d), "run")
    labels = judged(spark, d, own)
    return own.join(labels, ["query_id", "doc_id"], "left"), labels


_NDCG = "dcg AS (SELECT query_id, sum((2 ** coalesce(grade, 0) - 1) / log2(rank + 1)) AS dcg FROM gr WHERE rank <= {k} GROUP BY 1), idl AS (SELECT query_id, sum((2 ** grade - 1) / log2(r + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM lab) WHERE r <= {k} GROUP BY 1)"


@query(f"WITH {_RUN}, {_NDCG.format(k=20)} SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END, 6) AS ndcg_20 FROM idl LEFT JOIN dcg USING (query_id)")
def i16_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg_at(*graded_run(spark, d), 20, "query_id").select("query_id", F.round("ndcg_20", 6).alias("ndcg_20"))


@query(f"WITH {_RUN} SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (WHERE grade >= 2), 0), 6) AS mrr FROM gr GROUP BY 1")
def i17_mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.mrr(graded_run(spark, d)[0], "query_id").select("query_id", F.round("mrr", 6).alias("mrr"))


#: Chunks of a candidate that are reranked for a job.
RERANKED = 10
CUTOFFS = (10, 20, 45)
CONFIGURATIONS = {"dense": ("dense", False), "bm25": ("bm25", False), "hybrid": ("hybrid", False), "rerank": ("rerank", False), "prefilter": ("rerank", True)}

SHARED |= {
    "jq": (("rubric",), f"SELECT query_id, text, {TOKENS_SQL.format('text')} AS toks FROM (SELECT jd_id AS query_id, array_to_string(list_concat(list_concat(list_sort(list(DISTINCT lower(canonical_skill)) FILTER (WHERE canonical_skill IS NOT NULL AND weight >= 2)), list_sort(list(DISTINCT lower(canonical_skill)) FILTER (WHERE canonical_skill IS NOT NULL AND weight < 2))), list(search_query ORDER BY req_no) FILTER (WHERE kind = 'soft')), ' ') AS text FROM rubric GROUP BY jd_id)"),
    "jterm": (("jq",), SHARED["sterm"][1].replace("sq", "jq")),
    "jkw": (("ctf", "csize", "craw", "jterm", "chunk"), SHARED["ckw"][1].replace("sterm", "jterm")),
    "jhv": (("jq",), _HASH.format(i="query_id", t="jq").split(" AS (", 1)[1][:-1]),
    "jdn": (("chv", "jhv", "chunk"), SHARED["cdn"][1].replace("shv", "jhv").replace("SELECT query_id, doc_id, chunk_id, row_number()", "SELECT query_id, doc_id, chunk_id, round(coalesce(score, 0), 9) AS score, row_number()", 1)),
    "jfr": (("jkw", "jdn"), SHARED["cfr"][1].replace("cdn", "jdn").replace("ckw", "jkw").replace("rank <= 30", f"rank <= {3 * RERANKED}")),
}

_RANKINGS = f"""{_MUST}, sc AS (SELECT 'dense' AS base, query_id, doc_id, score FROM jdn WHERE rank = 1 UNION ALL SELECT 'bm25', query_id, doc_id, score FROM jkw WHERE rank = 1 AND score > 0 UNION ALL SELECT 'hybrid', query_id, doc_id, rrf FROM jfr WHERE rank = 1
UNION ALL SELECT 'rerank', query_id, doc_id, max(1 / (1 + exp(-CASE WHEN len(jq.toks) = 0 THEN -3.0 ELSE 6.0 * len(list_intersect(list_distinct(jq.toks), chunk.toks)) / len(list_distinct(jq.toks)) - 3.0 END))) FROM (SELECT query_id, doc_id, chunk_id FROM jfr WHERE rank <= {RERANKED}) JOIN chunk USING (doc_id, chunk_id) JOIN jq USING (query_id) GROUP BY ALL),
cf AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{b}', {str(p).lower()})" for k, (b, p) in CONFIGURATIONS.items())}) v(config, base, pre)),
gr AS (SELECT config, gs.jd_id, gs.id, NOT pre OR list_has_all(skills, must) AND years_ok AS allowed, coalesce(round(sc.score, 9), 0) AS score, {_GRADE} AS grade FROM gs CROSS JOIN cf LEFT JOIN sc ON sc.base = cf.base AND sc.query_id = gs.jd_id AND sc.doc_id = gs.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY config, jd_id ORDER BY allowed DESC, CASE WHEN allowed THEN -score ELSE 0 END, CASE WHEN allowed THEN -id ELSE id END) AS rank, row_number() OVER (PARTITION BY config, jd_id ORDER BY grade DESC) AS ir, count(*) FILTER (WHERE grade >= 2) OVER (PARTITION BY config, jd_id) AS n_rel FROM gr)"""
_METRICS = ", ".join(f"count(*) FILTER (WHERE grade >= 2 AND rank <= {k}) / any_value(n_rel) AS recall_{k}, sum((2 ** grade - 1) / log2(rank + 1)) FILTER (WHERE rank <= {k}) / sum((2 ** grade - 1) / log2(ir + 1)) FILTER (WHERE ir <= {k}) AS ndcg_{k}" for k in CUTOFFS)
_CONFIGS = f"{_RANKINGS}, m AS (SELECT config, jd_id, 1.0 / min(rank) FILTER (WHERE grade >= 2) AS mrr, {_METRICS} FROM rk WHERE n_rel > 0 GROUP BY ALL), cm AS (SELECT config, count(*) AS n_queries, avg(mrr) AS mrr, {', '.join(f'avg({c}_{k}) AS {c}_{k}' for k in CUTOFFS for c in ('recall', 'ndcg'))} FROM m GROUP BY config)"
_NEEDS = ("jkw", "jdn", "jfr", "chunk", "jq", "cskills", "rubric")
_NAMES = ["mrr", *[f"{m}_{k}" for k in CUTOFFS for m in ("recall", "ndcg")]]


def job_queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text: one query a job, of its skills and its soft requirements, the same for all configurations."""
    r = rubric(spark, d)
    skills = lambda test: F.array_sort(F.collect_set(F.when(test, F.lower("canonical_skill"))))
    soft = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "soft", F.struct("req_no", "search_query")))), lambda x: x["search_query"])
    return r.groupBy("jd_id").agg(F.array_join(F.concat(skills(F.col("weight") >= 2), skills(F.col("weight") < 2), soft), " ").alias("text")).select(F.col("jd_id").cast("long").alias("query_id"), "text")


def candidate_rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored: (config, query_id, candidate, place) of every candidate for every job in five configurations, and labels.

    One search within candidates serves them all: the best chunk by embedding, by keyword, fused, and reranked.
    """
    asked, chunks = job_queries(spark, d), resume_chunks(spark, d)
    sets = stored(E.graded(graded_sets(spark, d)).select(F.col("jd_id").cast("long").alias("query_id"), F.col("id").alias("candidate"), "grade", (F.size(F.array_except("must", "skills")) == 0).alias("has_all"), "years_ok"), "graded-sets")
    pairs = chunks.select("doc_id").distinct().join(sets.select("query_id", F.col("candidate").alias("doc_id")), "doc_id")
    best = R.best_within(chunks, asked, pairs, RERANKED, "doc_id", depth=3 * RERANKED)
    # one pass over candidates: the scores of all methods side by side
    hits = best.select(F.struct("query_id", "base").alias("query_id"), F.col("doc_id").alias("candidate"), "score")
    methods = asked.select(F.explode(F.array(*[F.struct(F.col("query_id"), F.lit(name).alias("base")) for name in R.BASES])).alias("query_id"))
    scores = R.best_per_candidate(hits, sets.select("candidate"), methods).select("query_id.query_id", "query_id.base", "candidate", "score")
    own = scores.join(sets.select("query_id", "candidate", (F.col("has_all") & F.col("years_ok")).alias("passes")), ["query_id", "candidate"])
    kinds = F.array(*[F.struct(F.lit(k).alias("config"), F.lit(b).alias("base"), F.lit(p).alias("pre")) for k, (b, p) in CONFIGURATIONS.items()])
    own = own.select("*", F.explode(F.filter(kinds, lambda x: x["base"] == F.col("base"))).alias("kind"))
    place = E.ranking_place(~F.col("kind.pre") | F.col("passes"), F.col("score"), F.col("candidate"))
    return stored(own.select("kind.config", "query_id", "candidate", place.alias("place")), "rankings"), sets.select("query_id", "candidate", "grade")


@query(f"WITH {_CONFIGS} SELECT config, n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM cm", *_NEEDS)
def i18_configurations(spark: SparkSession, d: str) -> DataFrame:
    """Dense, BM25, fusion, reranking, and reranking of whom the prefilter lets through, over all candidates of all jobs."""
    return E.compare_configs(*candidate_rankings(spark, d), CUTOFFS).select("config", "n_queries", *[F.round(c, 6).alias(c) for c in _NAMES])


@query(f"WITH {_CONFIGS} SELECT config, {', '.join(f'abs({c} - max({c}) OVER ()) < 1e-9 AS best_{c}' for c in _NAMES)} FROM cm", *_NEEDS)
def e37_best_marked(spark: SparkSession, d: str) -> DataFrame:
    return E.best_marked(E.compare_configs(*candidate_rankings(spark, d), CUTOFFS), _NAMES).select("config", *[f"best_{c}" for c in _NAMES])


@query(f"WITH {_RANKINGS} SELECT config, jd_id AS query_id, {', '.join(f'round(CASE WHEN any_value(n_rel) > 0 THEN count(*) FILTER (WHERE grade >= 2 AND rank <= {k}) / any_value(n_rel) END, 6) AS recall_{k}' for k in CUTOFFS)} FROM rk GROUP BY ALL", *_NEEDS)
def i15_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of all candidates with a grade of two or more, how many each configuration has within its first k."""
    scores, labels = candidate_rankings(spark, d)
    keys = ("config", "query_id")
    first = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("rank") <= max(CUTOFFS))
    graded = stored(first.join(labels, ["query_id", "candidate"]).select(*keys, "rank", "grade"), "graded-first")
    out = reduce(lambda a, b: a.join(b, list(keys)), [E.recall_at(graded, labels, k, *keys, of=("query_id",)) for k in CUTOFFS])
    return out.select("config", F.col("query_id").cast("int").alias("query_id"), *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in CUTOFFS])


@query(f"WITH {_RUN} SELECT round(avg(a / n_rel), 6) AS mean_recall, count(*) AS n_queries FROM (SELECT query_id, count(*) FILTER (WHERE grade >= 2) AS a FROM gr WHERE rank <= 10 GROUP BY 1) JOIN nr USING (query_id)")
def e35_mean_recall(spark: SparkSession, d: str) -> DataFrame:
    graded, labels = graded_run(spark, d)
    found = graded.where("rank <= 10").groupBy("query_id").agg(F.count_if(F.col("grade") >= E.RELEVANT).alias("a"))
    rel = labels.groupBy("query_id").agg(F.count_if(F.col("grade") >= E.RELEVANT).alias("n_rel"))
    value = F.when(F.col("n_rel") > 0, F.col("a") / F.col("n_rel"))
    return found.join(rel, "query_id").agg(F.round(F.avg(value), 6).alias("mean_recall"), F.count(value).alias("n_queries"))


_SETS = "st AS (SELECT o_orderkey, list_sort(list(DISTINCT p_brand)) AS found, list_sort(list(DISTINCT CASE WHEN p_partkey % 7 = 0 THEN p_brand || 'x' ELSE p_brand END)) AS truth FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def sets(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    own = own.join(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    truth = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand"))
    return own.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("p_brand")).alias("found"), F.sort_array(F.collect_set(truth)).alias("truth"))


@query(f"WITH {_SETS}, s AS (SELECT CAST(sum(len(list_intersect(found, truth))) AS BIGINT) AS tp, CAST(sum(len([x FOR x IN found IF NOT list_contains(truth, x)])) AS BIGINT) AS fp, CAST(sum(len([x FOR x IN truth IF NOT list_contains(found, x)])) AS BIGINT) AS fn FROM st) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s")
def e24_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.prf(sets(spark, d)).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_SETS} SELECT value, count(*) AS n FROM (SELECT unnest([x FOR x IN truth IF NOT list_contains(found, x)]) AS value FROM st) GROUP BY value ORDER BY n DESC, value LIMIT 5")
def e25_most_missed(spark: SparkSession, d: str) -> DataFrame:
    return E.most_common(sets(spark, d), F.array_except("truth", "found"))


@query(f"WITH {_SETS} SELECT o_orderkey, CAST(len(list_intersect(found, truth)) AS INTEGER) AS hits, CAST(len([x FOR x IN found IF NOT list_contains(truth, x)]) AS INTEGER) AS extra, CAST(len([x FOR x IN truth IF NOT list_contains(found, x)]) AS INTEGER) AS missing FROM st")
def h4_set_compare(spark: SparkSession, d: str) -> DataFrame:
    return sets(spark, d).select("o_orderkey", F.size(F.array_intersect("found", "truth")).alias("hits"), F.size(F.array_except("found", "truth")).alias("extra"), F.size(F.array_except("truth", "found")).alias("missing"))


_PROFILES = f"""j AS ({_JOB}), c AS ({_COHERENT}),
nj AS (SELECT o_custkey, count(*) AS n FROM j GROUP BY 1),
pr AS (SELECT c_custkey, c_name, c_acctbal, cand.degree, n FROM customer JOIN cand ON cand.id = c_custkey JOIN nj ON nj.o_custkey = c_custkey),
yr AS (SELECT count(*) AS n_matched, avg(CAST(j.start_year IS NOT DISTINCT FROM c.start_year AS INTEGER)) AS start_year, avg(CAST(j.end_year IS NOT DISTINCT FROM c.end_year AS INTEGER)) AS end_year FROM j JOIN c USING (o_orderkey) WHERE (o_orderkey % 10 = 0 OR o_orderkey % 11 <> 0) AND o_orderkey % 13 <> 0)"""


def profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Profiles as extracted and as they are known: dates are put in order, names and contacts misread here and there,
    some companies are longer or others than they should be, and every thirteenth job is missing."""
    c = table(spark, d, "customer").join(candidates(spark, d).select(F.col("id").alias("c_custkey"), "degree"), "c_custkey")
    k = F.col("o_orderkey")
    number = F.lpad(k.cast("string"), 10, "0")
    known_as, read_as = F.concat(F.lit("co "), number), F.concat(F.when((k % 10 != 0) & (k % 11 == 0), "other ").otherwise("Co. "), number, F.when(k % 10 == 0, " Inc").otherwise(""))
    of = lambda df, company: df.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", company.alias("company"), "start_year", "end_year"))), lambda x: x.dropFields("o_orderkey")).alias("jobs"))
    has = lambda c, test: F.when(test, F.col(c))
    acct, known = F.col("c_acctbal"), F.col("degree") != "unknown"
    none = F.array().cast("array<struct<company:string,start_year:int,end_year:int>>")
    profile = lambda df, name, email, phone, level, schools: c.join(df, "c_custkey", "left").join(jobs(spark, d).select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"), name.alias("name"), email.alias("email"), phone.alias("phone"), level.alias("level"), F.coalesce("jobs", none).alias("jobs"), schools.cast("int").alias("n_education"))
    truth = profile(of(jobs(spark, d), known_as), F.col("c_name"), has("c_name", acct > 0), has("c_name", acct > 1000), F.col("degree"), known)
    found = coherent_dates(jobs(spark, d).where(k % 13 != 0))
    return profile(of(found, F.regexp_replace(read_as, r"Co\.", "CO")), F.upper(F.translate("c_name", "#", "-")), has("c_name", acct > -500), has("c_name", acct > 1200), F.when(acct < 9000, F.col("degree")), F.when(acct < 8000, known.cast("int")).otherwise(2)), truth


@query(f"""WITH {_PROFILES}, fj AS (SELECT c_custkey, pr.n, count(c.o_orderkey) AS m FROM pr LEFT JOIN c ON c.o_custkey = c_custkey AND c.o_orderkey % 13 <> 0 GROUP BY ALL)
SELECT count(*) AS n, any_value(n_matched) AS n_matched, round(avg(CAST({_NORM.format("translate(c_name, '#', '-')")} = {_NORM.format('c_name')} AS INTEGER)), 6) AS name, round(avg(CAST((c_acctbal > -500) = (c_acctbal > 0) AS INTEGER)), 6) AS email, round(avg(CAST((c_acctbal > 1200) = (c_acctbal > 1000) AS INTEGER)), 6) AS phone,
round(avg(CAST(fj.n = fj.m AS INTEGER)), 6) AS job_count, round(any_value(start_year), 6) AS start_year, round(any_value(end_year), 6) AS end_year,
round(avg(CAST((c_acctbal < 9000 AND degree IN ('master', 'doctorate')) = (degree IN ('master', 'doctorate')) AS INTEGER)), 6) AS postgraduate, round(avg(CAST(CASE WHEN c_acctbal < 8000 THEN CAST(degree <> 'unknown' AS INTEGER) ELSE 2 END = CAST(degree <> 'unknown' AS INTEGER) AS INTEGER)), 6) AS education_count FROM pr JOIN fj USING (c_custkey), yr""", "cand")
def e26_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = E.field_accuracies(*profiles(spark, d), "id")
    return out.select("n", "n_matched", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("n", "n_matched")])


_FAR = "abs(l_quantity - l_linenumber * 5)"


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_FAR} < 0.05) AS exact, count(*) FILTER (WHERE {_FAR} <= 1) AS close, (SELECT list(line ORDER BY far DESC, line) FROM (SELECT {_FAR} AS far, l_orderkey * 10 + l_linenumber AS line FROM lineitem ORDER BY far DESC, line LIMIT 5)) AS worst FROM lineitem")
def e27_tolerance(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_quantity", (F.col("l_linenumber") * 5).alias("truth"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return E.tolerance(own, "l_quantity", "truth", "line")


@query(f"WITH b AS (SELECT source, {_NORM.format('lines.text')} AS norm, l.doc_id IS NOT NULL AS is_truth FROM lines JOIN documents USING (doc_id) LEFT JOIN labels l ON l.doc_id = lines.doc_id WHERE trim(lines.text) <> '') SELECT count(*) AS n, count(f.norm) AS verbatim FROM b LEFT JOIN (SELECT DISTINCT source, norm FROM b WHERE NOT is_truth) f ON f.source = b.source AND f.norm = b.norm WHERE is_truth", "lines")
def e28_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a source's labelled documents as truth, those of its other documents as found."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("is_truth")), "doc_id", "left")
    own = doc_lines(spark, d).where(F.trim("text") != "").join(docs, "doc_id").select("source", T.comparison_form(F.col("text")).alias("form"), "is_truth")
    return E.verbatim(own.where("is_truth"), own.where("is_truth is null"), "source", "form")


def _companies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of each customer's orders the name on the first line as found, the kind of thing on the second as known."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name")), F.col("p_partkey") == F.col("l_partkey"))
    own = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), F.col("o_orderkey") == F.col("l_orderkey"))
    found = own.where("l_linenumber = 1").select("k", F.col("o_orderkey").alias("found_no"), F.col("name").alias("found_name"))
    return found, own.where("l_linenumber = 2").select("k", F.col("o_orderkey").alias("truth_no"), F.element_at(F.split("name", " "), -1).alias("truth_name"))


@query()
def d11_company_match(spark: SparkSession, d: str) -> DataFrame:
    """A greedy one-to-one match is a sequential choice; tests compare it with plain Python."""
    return E.matched_companies(*_companies(spark, d), "k")


@query()
def e29_unmatched_companies(spark: SparkSession, d: str) -> DataFrame:
    found, truth = _companies(spark, d)
    return found.join(E.matched_companies(found, truth, "k"), ["k", "found_no"], "left_anti").groupBy("k").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT lower(p_name) AS surface, min(p_brand) AS canonical FROM part GROUP BY 1), n AS (SELECT DISTINCT unnest(list_concat([lower(p_name), lower(p_name) || ' set', lower(p_type)], string_split(lower(p_name), ' '))) AS name FROM part) SELECT name, coalesce(arg_min(canonical, printf('%05d', 10000 - length(surface)) || surface), name) AS canonical FROM n LEFT JOIN v ON contains(surface, name) OR contains(name, surface) GROUP BY name")
def d12_surface_containment(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    own, names = F.lower("p_name"), p.select(F.explode(F.concat(F.array(F.lower("p_name"), F.concat(F.lower("p_name"), F.lit(" set")), F.lower("p_type")), F.split(F.lower("p_name"), " "))).alias("name"))
    return E.canonicalised(names, p.groupBy(own.alias("surface")).agg(F.min("p_brand").alias("canonical")))


@query(f"WITH {_SECTIONS}, body AS (SELECT doc_id, string_agg(text, chr(10)) AS body FROM s WHERE opens IS NULL GROUP BY 1) SELECT s.doc_id, s.line_no, trim(s.text) AS text FROM s LEFT JOIN body USING (doc_id) WHERE trim(s.text) <> '' AND NOT coalesce(contains(body, trim(s.text)), false)", "page_lines")
def d13_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that no chunk of theirs holds: headings, which sections consume."""
    lines = section_lines(spark, d)
    truth = lines.select("doc_id", "line_no", F.trim("text").alias("text")).where("text <> ''")
    return E.lost_lines(truth, G.chunks(lines).select("doc_id", "text"), "doc_id")


@query(FLAT_CHUNKS + ", em AS (SELECT DISTINCT doc_id, regexp_extract(text, '^([A-Za-z]{4,})', 1) AS employer FROM lines) SELECT doc_id, part_index, count(*) AS n_employers FROM flat JOIN em USING (doc_id) WHERE employer <> '' AND contains(flat.text, employer) GROUP BY ALL HAVING count(*) > 1", "lines")
def d14_citation_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents that name several of their document's employers: the words that its lines begin with."""
    employers = doc_lines(spark, d).select("doc_id", F.regexp_extract("text", "^([A-Za-z]{4,})", 1).alias("employer"))
    return E.mixed_chunks(G.flat_chunks(table(spark, d, "documents")), employers, "doc_id", "part_index")


@query("SELECT conv_id, r.role FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT DISTINCT role FROM conversations) r WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r.role)")
def d15_section_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "role").distinct()
    wanted = c.select("conv_id").distinct().join(c.select("role").distinct(), F.lit(True), "cross")  # roles are a handful
    return wanted.join(c, ["conv_id", "role"], "left_anti")


@query("SELECT l.doc_id, quality, lang FROM labels l JOIN documents USING (doc_id)")
def d10_record_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query(SQL["b16_completeness"].replace("SELECT resume_id, [x FOR", "SELECT value, count(*) AS n FROM (SELECT unnest(issues) AS value FROM (SELECT resume_id, [x FOR", 1) + ")) GROUP BY value ORDER BY n DESC, value LIMIT 5")
def e30_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """What B16 reports of the candidates' profiles."""
    return E.most_common(b16_completeness(spark, d), F.col("issues"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, l_returnflag, l_linestatus, l_linenumber LIMIT 1")
def e32_failure_cluster(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    own = table(spark, d, "lineitem").where("l_discount >= 0.05").groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 3")
    return own.orderBy(F.desc("n"), *keys).limit(1)


SHARED["named_lines"] = (("page_lines",), "SELECT * FROM page_lines UNION ALL SELECT page_id, -1, 'Name ' || page_id, false, false, false, 10.0 FROM pages WHERE page_id % 4 <> 0")


@query(f"WITH {_SECTIONS.replace('page_lines', 'named_lines')}, c AS (SELECT * FROM s WHERE opens IS NULL) SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) FILTER (WHERE trim(text) <> '') > 0 AND coalesce(arg_min(text, line_no) FILTER (WHERE section_seq = 0 AND section = 'HEADER'), '') = ''", "named_lines")
def e33_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Pages with chunks that carry no candidate name: three in four begin with one before their first section."""
    lines = section_lines(spark, d)
    names = table(spark, d, "pages").where("page_id % 4 <> 0").select(F.col("page_id").alias("doc_id"), F.lit(-1).alias("line_no"), F.concat(F.lit("Name "), "page_id").alias("text"), F.lit(False).alias("is_bullet"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_heading"), F.lit(10.0).alias("font_size"))
    return G.chunks(lines.unionByName(names)).where(F.coalesce("candidate_name", F.lit("")) == "").select("doc_id").distinct()


@query("SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents")
def f6_rank(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(order).alias("rank"))


@query("SELECT jd_id, resume_id, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY passed DESC, round(score, 12) DESC, id) AS INTEGER) AS place, NOT passed AS excluded FROM scored", "scored")
def h2_append_excluded(spark: SparkSession, d: str) -> DataFrame:
    """A job's ranked candidates, then those that its filter excluded."""
    own = ranked(spark, d)
    last = own.groupBy("jd_id").agg(F.coalesce(F.max("rank"), F.lit(0)).alias("m"))
    rest = own.where("rank is null").join(last, "jd_id").withColumn("place", F.col("m") + F.row_number().over(Window.partitionBy("jd_id").orderBy(F.round("score", 12).desc(), "id")))
    return own.where("rank is not null").select("jd_id", "resume_id", F.col("rank").alias("place"), F.lit(False).alias("excluded")).unionByName(rest.select("jd_id", "resume_id", "place", F.lit(True).alias("excluded")))
