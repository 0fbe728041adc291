"""Queries by name with their SQL, and the inputs that several share in both forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The year that validators take as the present.
AS_OF = 2025


def query(sql: str | None = None, *shared: str) -> Callable[[Query], Query]:
    """Register a query; ``shared`` names common table expressions that its SQL stands on."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_shared(sql, shared)
        return f

    return keep


#: Common table expressions, each with those it needs.
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents"),
    "turns": ((), "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS line_no, text, role = 'assistant' AS is_bullet, role = 'system' AS is_bold FROM conversations"),
    "tags": ((), "SELECT page_id, CAST(generate_subscripts(regexp_extract_all(html, '<(?:h1|h2|li|b|p)>[^<]*'), 1) - 1 AS INTEGER) AS line_no, unnest(regexp_extract_all(html, '<(?:h1|h2|li|b|p)>[^<]*')) AS x FROM pages"),
    "page_lines": (("tags",), "SELECT page_id AS doc_id, line_no, regexp_replace(x, '^<[a-z0-9]+>', '') AS text, starts_with(x, '<li>') AS is_bullet, starts_with(x, '<b>') OR starts_with(x, '<h') AS is_bold, starts_with(x, '<h') AS is_heading, CASE WHEN starts_with(x, '<h1>') THEN 16.0 WHEN starts_with(x, '<h2>') THEN 13.0 WHEN starts_with(x, '<b>') THEN 11.5 ELSE 10.0 END AS font_size FROM tags"),
    "span": ((), "SELECT o_custkey, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1"),
    "pri": ((), "SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2"),
    "cand": (("span", "pri"), "SELECT c_custkey AS id, 'c' || c_custkey AS resume_id, c_mktsegment AS job_id, c_name AS full_name, CAST(coalesce(year(hi) * 12 + month(hi) - year(lo) * 12 - month(lo), 0) AS INTEGER) AS months, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'doctorate' WHEN '2' THEN 'master' WHEN '3' THEN 'bachelor' WHEN '4' THEN 'diploma' WHEN '5' THEN 'school' ELSE 'unknown' END AS degree FROM customer LEFT JOIN span ON span.o_custkey = c_custkey LEFT JOIN (SELECT * FROM pri WHERE rn = 1) p ON p.o_custkey = c_custkey"),
    "skill": ((), "SELECT DISTINCT 'c' || o_custkey AS resume_id, lower(p_brand) AS skill, p_brand AS canonical FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"),
    "degrees": ((), "SELECT * FROM (VALUES ('unknown', 0), ('school', 1), ('diploma', 2), ('bachelor', 3), ('master', 4), ('doctorate', 5)) AS t(level, ladder)"),
    "raw_req": ((), "SELECT n_regionkey AS jd_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS req_no, n_name AS text, CASE WHEN (n_nationkey + n_regionkey) % 3 = 0 THEN 'hard' ELSE 'soft' END AS kind, CAST((n_nationkey * 7) % 5 AS INTEGER) AS weight, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 7 = 4 THEN 'Brand#99' ELSE 'Brand#' || CAST(1 + (n_nationkey * 3) % 20 AS VARCHAR) END AS skill, CASE WHEN n_nationkey % 6 = 0 OR n_nationkey % 8 = 3 THEN ['Brand#' || CAST(1 + n_nationkey % 25 AS VARCHAR), 'B' || CAST(1 + (n_nationkey + 9) % 25 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS skill_alternatives, CASE WHEN n_nationkey % 5 = 0 THEN CAST(1 + n_nationkey % 3 AS INTEGER) END AS min_years, CASE n_nationkey % 7 WHEN 0 THEN ' Diploma ' WHEN 1 THEN ' Bachelor' WHEN 2 THEN 'PhD' WHEN 6 THEN 'BACHELOR ' END AS degree_level, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE passage END AS search_query FROM nation LEFT JOIN (SELECT item_id, min(text) AS passage FROM benchmark GROUP BY 1) ON item_id = n_nationkey"),
    "alts": (("raw_req",), "SELECT jd_id, req_no, list_sort(list(DISTINCT lower(coalesce(p_brand, x)))) AS any_of FROM (SELECT jd_id, req_no, unnest(skill_alternatives) AS x FROM raw_req) LEFT JOIN (SELECT DISTINCT p_brand FROM part) ON lower(x) IN (lower(p_brand), 'b' || substr(p_brand, 7)) GROUP BY ALL"),
    "req": (("raw_req", "alts"), "SELECT jd_id, req_no, text, CASE WHEN kind = 'hard' AND ((skill IS NULL AND min_years IS NULL AND deg IS NULL AND len(any_of) = 0) OR (skill IS NOT NULL AND canonical IS NULL)) THEN 'soft' ELSE kind END AS kind, greatest(1, least(3, weight)) AS weight, skill, any_of, min_years, deg AS degree_level, canonical AS canonical_skill, coalesce(search_query, text) AS search_query FROM (SELECT r.*, coalesce(any_of, []) AS any_of, CASE WHEN lower(trim(degree_level)) IN ('bachelor', 'master', 'doctorate') THEN lower(trim(degree_level)) END AS deg, v.p_brand AS canonical FROM raw_req r LEFT JOIN alts a ON a.jd_id = r.jd_id AND a.req_no = r.req_no LEFT JOIN (SELECT DISTINCT p_brand FROM part) v ON lower(v.p_brand) = lower(skill))"),
    "rubric": (("req",), "SELECT * EXCLUDE (k, first, pick), CAST(row_number() OVER (PARTITION BY jd_id ORDER BY k IS NULL, first, req_no) - 1 AS INTEGER) AS pos FROM (SELECT *, min(req_no) OVER (PARTITION BY jd_id, coalesce(k, CAST(req_no AS VARCHAR))) AS first, row_number() OVER (PARTITION BY jd_id, coalesce(k, CAST(req_no AS VARCHAR)) ORDER BY weight DESC, kind = 'hard' DESC, req_no) AS pick FROM (SELECT *, lower(canonical_skill) AS k FROM req)) WHERE pick = 1"),
    "spec": (("rubric", "degrees"), "SELECT jd_id, max(min_years) FILTER (WHERE kind = 'hard') AS min_years, arg_max(degree_level, ladder) FILTER (WHERE kind = 'hard' AND degree_level IS NOT NULL) AS min_degree, list_sort(coalesce(list(DISTINCT canonical_skill) FILTER (WHERE kind = 'hard' AND canonical_skill IS NOT NULL), [])) AS required_skills, list_sort(coalesce(list(array_to_string(any_of, ', ')) FILTER (WHERE kind = 'hard' AND len(any_of) > 0), [])) AS alternatives FROM rubric LEFT JOIN degrees ON level = degree_level GROUP BY jd_id"),
    "cskills": (("cand", "skill"), "SELECT cand.*, coalesce(list_sort(list(skill) FILTER (WHERE skill IS NOT NULL)), []) AS skills FROM cand LEFT JOIN skill USING (resume_id) GROUP BY ALL"),
    "filtered": (("cskills", "spec", "degrees"), "SELECT c.*, s.jd_id, list_concat(list_concat([x FOR x IN [CASE WHEN coalesce(s.min_years, 0) > 0 AND months / 12.0 < s.min_years THEN printf('%.1f years, needs %d+', months / 12.0, s.min_years) END, CASE WHEN s.min_degree IS NOT NULL AND h.ladder < n.ladder THEN c.degree || ', needs ' || s.min_degree END] IF x IS NOT NULL], ['missing ' || x FOR x IN s.required_skills IF NOT list_contains(c.skills, lower(x))]), ['none of ' || x FOR x IN s.alternatives IF NOT list_has_any(string_split(x, ', '), c.skills)]) AS reasons FROM cskills c CROSS JOIN spec s JOIN degrees h ON h.level = c.degree LEFT JOIN degrees n ON n.level = s.min_degree"),
    "attrs": ((), "SELECT 'c' || c_custkey AS resume_id, 'nation' AS attribute, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'c' || c_custkey, 'region', r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer"),
    "parts": ((), "SELECT p_partkey AS id, 'p' || p_partkey AS resume_id, p_type AS job_id, p_name AS full_name, p_brand AS email FROM part"),
    "dups": (("parts",), "SELECT *, CASE WHEN first_value(id) OVER w <> id THEN first_value(resume_id) OVER w END AS duplicate_of FROM parts WINDOW w AS (PARTITION BY job_id, lower(trim(full_name)), lower(trim(email)) ORDER BY id)"),
    "hit_grades": ((), "SELECT doc_id, CAST(2 * quality + (1 - toxic) AS INTEGER) AS grade FROM labels"),
}


def with_shared(sql: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for x in SHARED[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return sql
    own = sql.strip()
    recursive = own.startswith("WITH RECURSIVE ")
    own = own.replace("WITH RECURSIVE ", "WITH ", 1) if recursive else own
    more = ", " + own[5:] if own.startswith("WITH ") else " " + own
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS MATERIALIZED ({SHARED[n][1]})" for n in order) + more


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("line_no"), "text", (F.col("role") == "assistant").alias("is_bullet"), (F.col("role") == "system").alias("is_bold"))


def html_lines(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, html) as formatted lines."""
    tags = pages.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit("(<(?:h1|h2|li|b|p)>[^<]*)"), 1)).alias("line_no", "x"))
    starts = lambda s: F.startswith("x", F.lit(s))
    size = F.when(starts("<h1>"), 16.0).when(starts("<h2>"), 13.0).when(starts("<b>"), 11.5).otherwise(10.0)
    return tags.select("doc_id", "line_no", F.regexp_replace("x", "^<[a-z0-9]+>", "").alias("text"), starts("<li>").alias("is_bullet"), (starts("<b>") | starts("<h")).alias("is_bold"), starts("<h").alias("is_heading"), size.alias("font_size"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return html_lines(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """id, resume_id, job_id, full_name, months, degree: a customer as a candidate."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    month = lambda c: F.year(c) * 12 + F.month(c)
    by_priority = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    span = by_priority.groupBy("o_custkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("most"))
    first = F.substring("most", 1, 1)
    degree = F.when(first == "1", "doctorate").when(first == "2", "master").when(first == "3", "bachelor").when(first == "4", "diploma").when(first == "5", "school").otherwise("unknown")
    c = table(spark, d, "customer").join(span, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("resume_id"), F.col("c_mktsegment").alias("job_id"), F.col("c_name").alias("full_name"), F.coalesce(month("hi") - month("lo"), F.lit(0)).alias("months"), degree.alias("degree"))


def candidate_skills(spark: SparkSession, d: str) -> DataFrame:
    """resume_id, skill, canonical: the brands a customer bought, once each."""
    bought = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = bought.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return own.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("resume_id"), F.lower("p_brand").alias("skill"), F.col("p_brand").alias("canonical")).distinct()


def raw_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Rubric rows as written: one job per region, one requirement per nation, every other one with a benchmark passage to search for."""
    n = F.col("n_nationkey")
    brand = lambda k: F.concat(F.lit("Brand#"), k.cast("string"))
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    level = n % 7
    passage = table(spark, d, "benchmark").groupBy("item_id").agg(F.min("text").alias("passage"))
    return table(spark, d, "nation").join(passage, F.col("item_id") == n, "left").select(
        F.col("n_regionkey").alias("jd_id"),
        (F.row_number().over(order) - 1).alias("req_no"),
        F.col("n_name").alias("text"),
        F.when((n + F.col("n_regionkey")) % 3 == 0, "hard").otherwise("soft").alias("kind"),
        ((n * 7) % 5).cast("int").alias("weight"),
        F.when(n % 4 == 3, None).when(n % 7 == 4, "Brand#99").otherwise(brand(1 + (n * 3) % 20)).alias("skill"),
        F.when((n % 6 == 0) | (n % 8 == 3), F.array(brand(1 + n % 25), F.concat(F.lit("B"), (1 + (n + 9) % 25).cast("string")))).otherwise(F.array().cast("array<string>")).alias("skill_alternatives"),
        F.when(n % 5 == 0, (1 + n % 3).cast("int")).alias("min_years"),
        F.when(level == 0, " Diploma ").when(level == 1, " Bachelor").when(level == 2, "PhD").when(level == 6, "BACHELOR ").alias("degree_level"),
        F.when(n % 2 != 0, F.col("passage")).alias("search_query"),
    )


def brands(spark: SparkSession, d: str) -> DataFrame:
    """alias, canonical: the vocabulary of this data's skills, each by its name and in short."""
    own = table(spark, d, "part").select(F.col("p_brand").alias("canonical")).distinct()
    return own.select(F.explode(F.array(F.lower("canonical"), F.regexp_replace(F.lower("canonical"), "^brand#", "b"))).alias("alias"), "canonical")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """resume_id, attribute, value."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    wide = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("resume_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
    return wide.unpivot("resume_id", ["nation", "region", "segment"], "attribute", "value")


def part_people(spark: SparkSession, d: str) -> DataFrame:
    """Rows with names that repeat, for duplicate detection."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("resume_id"), F.col("p_type").alias("job_id"), F.col("p_name").alias("full_name"), F.col("p_brand").alias("email"))
