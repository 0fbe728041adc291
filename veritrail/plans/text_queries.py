"""Queries over scalar functions, segmentation and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import STOPWORDS, heading_aliases
from ..operators import segment as S
from ..runtime import table
from .base import AS_OF, doc_lines, page_lines, query, turns

_GLYPH = "[" + "•▪◦‣*·●–⁃-" + "]"
_UP = "upper(replace({}, 'ß', 'SS'))"
_HEADING = "trim(regexp_replace(" + _UP.format("regexp_replace(regexp_replace(regexp_replace(trim({}), '^#+', ''), '^\\s+|\\s+$', '', 'g'), '[:\\-_–—]+$', '')") + ", '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, line_no, regexp_matches(text, '^\\s*{_GLYPH}\\s*\\S') AS is_bullet, CASE WHEN regexp_matches(text, '^\\s*{_GLYPH}\\s*\\S') THEN regexp_replace(text, '^\\s*{_GLYPH}\\s*', '') ELSE regexp_replace(text, '^\\s+', '') END AS text FROM lines", "lines")
def b1_strip_bullet(spark: SparkSession, d: str) -> DataFrame:
    return S.marked_bullets(doc_lines(spark, d))


@query(f"SELECT doc_id, line_no, {_HEADING.format('text')} AS heading FROM lines", "lines")
def b2_normalise_heading(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).select("doc_id", "line_no", T.heading(F.col("text")).alias("heading"))


@query("SELECT doc_id, string_agg(CASE WHEN is_bullet THEN '- ' || text ELSE text END, chr(10) ORDER BY line_no) AS text FROM turns GROUP BY doc_id", "turns")
def b3_lines_to_text(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "is_bullet"))).alias("part"))
    return rows.select("doc_id", S.part_text(F.col("part")).alias("text"))


@query("SELECT doc_id, '[' || upper(source) || ']' || chr(10) || text AS embedding_text FROM documents")
def b4_contextual_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.upper("source"), F.lit("]\n"), F.col("text")).alias("embedding_text"))


@query("SELECT p_partkey, trim(regexp_replace('  - ' || p_name || '  , ;', '\\s+', ' ', 'g'), ' .,;•-') AS name FROM part")
def b5_skill_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.skill_surface(F.concat(F.lit("  - "), "p_name", F.lit("  , ;"))).alias("name"))


@query("SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9+#./ -]', ' ', 'g'), '\\s+', ' ', 'g'), ' .-') AS cleaned FROM lines", "lines")
def b6_vocabulary_clean(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).select("doc_id", "line_no", T.vocabulary_form(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9+#. ]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM lines", "lines")
def b7_evaluation_norm(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).select("doc_id", "line_no", T.comparison_form(F.col("text")).alias("norm"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS_SQL = (
    f"flatten([CASE WHEN regexp_matches(t, '[.\\-]') THEN list_concat([t], [p FOR p IN regexp_split_to_array(t, '[.\\-]') IF length(p) > 1 AND p NOT IN ({_STOP})]) ELSE [t] END "
    f"FOR t IN [trim(r, '.-') FOR r IN regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9+#.\\-]*')] IF t <> '' AND t NOT IN ({_STOP})])"
)


@query(f"SELECT doc_id, {TOKENS_SQL.format('text')} AS tokens FROM documents")
def b8_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("SELECT vec_id, [round(CAST(x AS DOUBLE) * 3 / sqrt(list_sum([CAST(y AS DOUBLE) * 3 * (CAST(y AS DOUBLE) * 3) FOR y IN embedding])), 5) + 0.0 FOR x IN embedding] AS unit FROM embeddings")
def b9_l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, d, "embeddings").select("vec_id", F.transform(T.unit(tripled), lambda x: F.round(x, 5) + F.lit(0.0)).alias("unit"))


@query("SELECT a.vec_id, round(list_sum([CAST(x AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR x, i IN a.embedding]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def b10_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(T.dot(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM (
  SELECT doc_id, CAST(('0x' || substr(md5(t), 31, 2)) AS INTEGER) % 128 AS bucket, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> '']) AS t FROM documents) GROUP BY 1, 2)""")
def b11_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import hash_embeddings

    return hash_embeddings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "bucket", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS relevance FROM customer")
def b12_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(T.sigmoid(F.col("c_acctbal") / 1000), 6).alias("relevance"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 20 BETWEEN 1 AND 12 THEN CAST(p_size % 20 AS INTEGER) END AS month,
  CASE WHEN 1900 + p_size * 3 BETWEEN 1950 AND {AS_OF + 1} THEN CAST(1900 + p_size * 3 AS INTEGER) END AS job_year,
  CASE WHEN 1900 + p_size * 3 BETWEEN 1950 AND {AS_OF + 6} THEN CAST(1900 + p_size * 3 AS INTEGER) END AS education_year FROM part""")
def b13_month_year(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("int")
    return table(spark, d, "part").select("p_partkey", T.valid_month(size % 20).alias("month"), T.valid_year(1900 + size * 3, AS_OF).alias("job_year"), T.valid_year(1900 + size * 3, AS_OF, 6).alias("education_year"))


_JOB = "SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS start_year, CAST(month(o_orderdate) AS INTEGER) AS start_month, CAST(year(o_orderdate) + o_orderkey % 4 - 1 AS INTEGER) AS end_year, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 12 END AS INTEGER) AS end_month, o_orderstatus = 'O' AS is_current FROM orders"
_COHERENT = "SELECT o_orderkey, o_custkey, CASE WHEN NOT is_current AND end_year < start_year THEN end_year ELSE start_year END AS start_year, start_month, CASE WHEN is_current THEN NULL WHEN end_year < start_year THEN start_year ELSE end_year END AS end_year, CASE WHEN is_current THEN NULL ELSE end_month END AS end_month, is_current FROM j"


@query(f"WITH j AS ({_JOB}) {_COHERENT}")
def b14_date_coherence(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.profile import coherent_dates

    return coherent_dates(jobs(spark, d))


@query(f"WITH j AS ({_JOB}), c AS ({_COHERENT}), x AS (SELECT o_orderkey, start_year * 12 + coalesce(start_month, 1) - 1 AS start_index, CASE WHEN is_current THEN {AS_OF * 12} WHEN end_year IS NOT NULL THEN end_year * 12 + coalesce(end_month, 1) - 1 END AS end_index FROM c) SELECT o_orderkey, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, CAST(CASE WHEN start_index IS NULL OR end_index IS NULL THEN 0 ELSE greatest(0, end_index - start_index) END AS INTEGER) AS duration FROM x")
def b15_month_index(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.profile import coherent_dates, month_spans

    return month_spans(coherent_dates(jobs(spark, d)), AS_OF * 12).select("o_orderkey", "start_index", "end_index", "duration")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs, some with their dates the wrong way round."""
    k, when = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year(when).alias("start_year"), F.month(when).alias("start_month"), (F.year(when) + k % 4 - 1).cast("int").alias("end_year"), F.when(k % 5 != 0, 1 + k % 12).cast("int").alias("end_month"), (F.col("o_orderstatus") == "O").alias("is_current"))


@query("SELECT resume_id, [x FOR x IN [CASE WHEN id % 10 = 0 THEN 'no name found' END, CASE WHEN degree = 'unknown' THEN 'no work experience found' END, CASE WHEN s.n IS NULL THEN 'no skills found' END, CASE WHEN degree <> 'unknown' AND months = 0 THEN 'experience found but no usable dates' END, CASE WHEN degree IN ('unknown', 'school') THEN 'no education found' END] IF x IS NOT NULL] AS issues FROM cand LEFT JOIN (SELECT resume_id, count(*) AS n FROM skill GROUP BY 1) s USING (resume_id)", "cand", "skill")
def b16_completeness(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.profile import completeness
    from .base import candidate_skills, candidates

    n = candidate_skills(spark, d).groupBy("resume_id").agg(F.count("*").alias("n_skills"))
    c = candidates(spark, d).join(n, "resume_id", "left")
    known = F.col("degree") != "unknown"
    return c.select("resume_id", completeness(F.when(F.col("id") % 10 != 0, F.col("full_name")), known.cast("int"), F.coalesce("n_skills", F.lit(0)), F.col("months"), (known & (F.col("degree") != "school")).cast("int")).alias("issues"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def b17_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|encrypt') THEN 'encrypted' ELSE 'corrupt' END AS status, substr(text, 1, 120) AS detail FROM documents")
def b18_error_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.error_status(F.col("text")).alias("status"), F.substring("text", 1, 120).alias("detail"))


@query("SELECT resume_id, (tenths // 12 + CASE WHEN tenths % 12 > 6 OR (tenths % 12 = 6 AND tenths // 12 % 2 = 1) THEN 1 ELSE 0 END) / 10.0 AS years FROM (SELECT resume_id, CAST(months AS INTEGER) * 10 AS tenths FROM cand)", "cand")
def b21_years(spark: SparkSession, d: str) -> DataFrame:
    """Ties (three and nine months) go to the even digit."""
    from .base import candidates

    return candidates(spark, d).select("resume_id", T.years_of(F.col("months")).alias("years"))


@query("SELECT url, regexp_replace(substr('chunks_' || regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 63), '[_-]+$', '') AS collection FROM (SELECT DISTINCT url FROM pages)")
def b22_collection_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url").distinct().select("url", T.collection_key(F.col("url")).alias("collection"))


@query("SELECT doc_id, arg_min(text, line_no) AS candidate_name FROM lines WHERE trim(text) <> '' GROUP BY doc_id", "lines")
def b23_first_line(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).where(F.trim("text") != "").groupBy("doc_id").agg(F.min_by("text", "line_no").alias("candidate_name"))


@query("SELECT jd_id, array_to_string(list_concat(list_concat(list(lower(text) ORDER BY req_no) FILTER (WHERE kind = 'hard'), list(lower(text) ORDER BY req_no) FILTER (WHERE kind = 'soft' AND weight >= 2)), list(lower(text) ORDER BY req_no) FILTER (WHERE kind = 'soft' AND weight < 2)), ' ') AS query FROM rubric GROUP BY jd_id", "rubric")
def b24_query_text(spark: SparkSession, d: str) -> DataFrame:
    from .rank_queries import rubric

    kind = F.when(F.col("kind") == "hard", 0).when(F.col("weight") >= 2, 1).otherwise(2)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "req_no", F.lower("text").alias("text")))), lambda x: x["text"])
    return rubric(spark, d).groupBy("jd_id").agg(F.concat_ws(" ", ordered).alias("query"))


@query("SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text, CAST(min(line_no) AS INTEGER) AS line_no FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER w, '[.!?:;]$'), true) OR (upper(text[1]) = text[1] AND lower(text[1]) <> text[1]) THEN 1 ELSE 0 END AS starts FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))) GROUP BY doc_id, run", "lines")
def f1_merge_wrapped(spark: SparkSession, d: str) -> DataFrame:
    lines = doc_lines(spark, d).withColumns({"is_bullet": F.lit(False), "font_size": F.lit(10.0), "page": F.lit(1)})
    return S.merge_wrapped(lines).select("doc_id", "text", "line_no")


_ALIAS = ", ".join(f"('{a}', '{c}')" for a, c in heading_aliases())


@query(f"SELECT doc_id, line_no, {_HEADING.format('text')} AS norm, canonical FROM page_lines LEFT JOIN (VALUES {_ALIAS}, ('HEADING', 'OTHER')) a(alias, canonical) ON alias = {_HEADING.format('text')}", "page_lines")
def d2_section_alias(spark: SparkSession, d: str) -> DataFrame:
    aliases = F.broadcast(S.alias_table(spark).withColumnRenamed("norm", "alias"))
    norm = page_lines(spark, d).select("doc_id", "line_no", T.heading(F.col("text")).alias("norm"))
    return norm.join(aliases, F.col("alias") == F.col("norm"), "left").drop("alias")


#: A page's lines with its headings by number: the first names a known section, so that later ones can open OTHER.
_SECTION_LINES = "sl AS (SELECT doc_id, line_no, CASE WHEN is_heading AND row_number() OVER (PARTITION BY doc_id, is_heading ORDER BY line_no) = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'Work Experience:' WHEN 1 THEN '# Projects' ELSE 'skills' END ELSE text END AS text, is_bullet, is_bold, is_heading, font_size FROM page_lines)"
_SECTIONS = f"""{_SECTION_LINES}, k AS (SELECT sl.*, a.canonical FROM sl LEFT JOIN (VALUES {_ALIAS}) a(alias, canonical) ON alias = {_HEADING.format('text')}),
b AS (SELECT *, quantile_cont(font_size, 0.5) FILTER (WHERE NOT is_bold AND font_size > 0) OVER (PARTITION BY doc_id) AS body, coalesce(bool_or(canonical IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM k),
o AS (SELECT *, coalesce(canonical, CASE WHEN seen AND NOT is_bullet AND len([w FOR w IN regexp_split_to_array(trim(text), '\\s+') IF w <> '']) <= 5 AND (is_heading OR coalesce(font_size >= body + 2, false) OR (is_bold AND coalesce(font_size >= body + 1, false))) THEN 'OTHER' END) AS opens FROM b),
s AS (SELECT doc_id, line_no, text, is_bullet, is_bold, opens, canonical, CAST(count(opens) OVER w AS INTEGER) AS section_seq, coalesce(last_value(opens IGNORE NULLS) OVER w, 'HEADER') AS section FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def with_headings(lines: DataFrame) -> DataFrame:
    """The first heading of a page becomes one that sections know."""
    first = F.row_number().over(Window.partitionBy("doc_id", "is_heading").orderBy("line_no")) == 1
    name = F.when(F.col("doc_id") % 3 == 0, "Work Experience:").when(F.col("doc_id") % 3 == 1, "# Projects").otherwise("skills")
    return lines.withColumn("text", F.when(F.col("is_heading") & first, name).otherwise(F.col("text")))


def section_lines(spark: SparkSession, d: str) -> DataFrame:
    return with_headings(page_lines(spark, d))


@query(f"WITH {_SECTIONS} SELECT doc_id, line_no, section_seq, section FROM s WHERE opens IS NULL", "page_lines")
def f2_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.content(S.sections(section_lines(spark, d))).select("doc_id", "line_no", "section_seq", "section")


_ENTRIES = """r AS (SELECT *, sum(CAST(is_bullet AS INTEGER)) OVER (PARTITION BY {k} ORDER BY line_no) AS run FROM {t}),
e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY line_no) = 1 OR (NOT is_bullet AND (coalesce(lag(is_bullet) OVER (PARTITION BY {k} ORDER BY line_no), false) OR (is_bold AND coalesce(bool_or(is_bold AND NOT is_bullet) OVER (PARTITION BY {k}, run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)))) THEN 1 ELSE 0 END AS starts FROM r),
n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY {k} ORDER BY line_no) AS INTEGER) AS entry FROM e)"""


@query("WITH " + _ENTRIES.format(k="doc_id", t="turns") + " SELECT doc_id, line_no, entry FROM n", "turns")
def f3_entries(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(turns(spark, d), "doc_id").select("doc_id", "line_no", "entry")


#: Parts of a flat document: lines in order, a new part when the next would not fit, heading lines repeated.
FLAT_CHUNKS = """WITH RECURSIVE l AS (SELECT doc_id, line_no, text, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS m FROM lines),
h AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS head, CAST(sum(n) AS BIGINT) AS head_n FROM l WHERE line_no < 3 GROUP BY doc_id),
walk AS (SELECT l.doc_id, l.line_no, 1 AS part_index, l.n AS size FROM l WHERE line_no = 0
  UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN total > 600 AND w.size + l.n > 600 THEN w.part_index + 1 ELSE w.part_index END, CASE WHEN total > 600 AND w.size + l.n > 600 THEN head_n + l.n ELSE w.size + l.n END
  FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.line_no = w.line_no + 1 JOIN h ON h.doc_id = l.doc_id),
p AS (SELECT doc_id, part_index, string_agg(text, chr(10) ORDER BY line_no) AS body FROM walk JOIN l USING (doc_id, line_no) GROUP BY ALL),
flat AS (SELECT * FROM (SELECT doc_id, CAST(part_index AS INTEGER) AS part_index, CASE WHEN part_index > 1 THEN head || chr(10) || body ELSE body END AS text FROM p JOIN h USING (doc_id)) WHERE trim(text) <> '')"""


@query(FLAT_CHUNKS + " SELECT doc_id, part_index, text FROM flat", "lines")
def f4_packing(spark: SparkSession, d: str) -> DataFrame:
    return S.flat_chunks(table(spark, d, "documents"))


@query(FLAT_CHUNKS + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_index) AS INTEGER) AS chunk_index, part_index, length(text) AS char_count FROM flat", "lines")
def f5_numbering(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("part_index")
    return S.flat_chunks(table(spark, d, "documents")).select("doc_id", F.row_number().over(order).alias("chunk_index"), "part_index", F.length("text").alias("char_count"))


@query()
def i19_chunking(spark: SparkSession, d: str) -> DataFrame:
    """Needs F4's fold by entry, which SQL has no form for; tests compare it with plain Python."""
    return S.chunks(section_lines(spark, d))


@query()
def b25_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return S.rebuilt(S.chunks(section_lines(spark, d)))


@query(FLAT_CHUNKS + ", c AS (SELECT length(text) AS x FROM flat) SELECT count(*) AS n, CAST(min(x) AS INTEGER) AS smallest, CAST(floor(quantile_cont(x, 0.5)) AS INTEGER) AS median, CAST((SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS m FROM c) WHERE r = least(m, CAST(floor(m * 0.9) AS BIGINT) + 1)) AS INTEGER) AS p90, CAST(max(x) AS INTEGER) AS largest, count(*) FILTER (WHERE x < 40) AS below_40, count(*) FILTER (WHERE x > 1200) AS above_1200 FROM c", "lines")
def e13_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return S.size_report(S.flat_chunks(table(spark, d, "documents")).select(F.length("text").alias("char_count")))


@query(f"WITH {_SECTIONS} SELECT section, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM s WHERE opens IS NULL GROUP BY section", "page_lines")
def e14_per_section(spark: SparkSession, d: str) -> DataFrame:
    return S.content(S.sections(section_lines(spark, d))).groupBy("section").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {_SECTIONS}, u AS (SELECT doc_id, line_no, text FROM s WHERE opens IS NOT NULL AND canonical IS NULL) SELECT doc_id, list_sort(list(DISTINCT text)) AS unknown_headings, list(text ORDER BY line_no)[1:3] AS first_three FROM u GROUP BY doc_id", "page_lines")
def e16_unknown_headings(spark: SparkSession, d: str) -> DataFrame:
    u = S.sections(section_lines(spark, d)).where("unknown_heading")
    firsts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), 1, 3)
    return u.groupBy("doc_id").agg(F.sort_array(F.collect_set("text")).alias("unknown_headings"), firsts.alias("first_three"))


@query(f"WITH {_SECTIONS}, {_ENTRIES.format(k='doc_id, section_seq', t='(SELECT * FROM s WHERE opens IS NULL)')}, f AS (SELECT doc_id, section, max(entry) AS found FROM n GROUP BY ALL), t AS (SELECT page_id AS doc_id, CAST(1 + page_id % 3 AS INTEGER) AS truth FROM pages) SELECT section, count(*) FILTER (WHERE found = truth) AS exact, count(*) FILTER (WHERE found < truth) AS under, count(*) FILTER (WHERE found > truth) AS over FROM f JOIN t USING (doc_id) GROUP BY section", "page_lines")
def e31_entry_split(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluate import split_accuracy

    own = S.entries(S.content(S.sections(section_lines(spark, d))), "doc_id", "section_seq").groupBy("doc_id", "section").agg(F.max("entry").alias("found"))
    truth = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), (1 + F.col("page_id") % 3).cast("int").alias("truth"))
    return split_accuracy(own.join(truth, "doc_id"))
