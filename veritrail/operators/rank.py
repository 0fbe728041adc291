"""Rubrics, hard filters with reasons, scores and shortlists.

A rubric is rows (jd_id, req_no, text, kind, weight, skill, skill_alternatives, min_years, degree_level); candidates are
(id, resume_id, months, degree, skills as lower-case array). All jobs and candidates are handled in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import FLOOR

IN_DATABASE, MET = 0.95, 0.5


def normalised(requirements: DataFrame, words: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Weights within 1..3, known degrees, canonical skills; a hard requirement that nothing can check, or
    whose skill is unknown to ``words`` (alias, canonical), becomes soft.

    ``any_of`` holds the alternatives as lower-case canonical names, each once; one that is unknown keeps its own form.
    Alternatives are something to check. With ``strict_reference`` they are not, and are compared as they are written.
    """
    level = F.lower(F.trim("degree_level"))
    own = requirements.withColumns({"weight": F.greatest(F.lit(1), F.least(F.lit(3), F.col("weight"))), "degree_level": F.when(level.isin("bachelor", "master", "doctorate"), level), "search_query": F.coalesce("search_query", "text")})
    own = own.join(words.select(F.col("alias").alias("_alias"), F.col("canonical").alias("canonical_skill")), F.lower("skill") == F.col("_alias"), "left").drop("_alias")
    asked = requirements.select("jd_id", "req_no", F.explode("skill_alternatives").alias("_x"))
    if not strict_reference:
        known = words.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
        asked = asked.join(known, F.lower(F.trim("_x")) == F.col("_alias"), "left").withColumn("_x", F.coalesce("_canonical", F.trim("_x")))
    groups = asked.groupBy("jd_id", "req_no").agg(F.array_sort(F.collect_set(F.lower("_x"))).alias("any_of"))
    own = own.join(groups, ["jd_id", "req_no"], "left").withColumn("any_of", F.coalesce("any_of", F.array().cast("array<string>")))
    unchecked = F.col("skill").isNull() & F.col("min_years").isNull() & F.col("degree_level").isNull()
    if not strict_reference:
        unchecked = unchecked & (F.size("any_of") == 0)
    unknown = F.col("skill").isNotNull() & F.col("canonical_skill").isNull()
    return own.withColumn("kind", F.when((F.col("kind") == "hard") & (unchecked | unknown), "soft").otherwise(F.col("kind")))


def deduped(requirements: DataFrame) -> DataFrame:
    """E5: of requirements with one canonical skill the weightiest, hard before soft, first on ties, in the place of the
    first; those without a skill follow. pos is the new place."""
    key = F.lower("canonical_skill")
    same = Window.partitionBy("jd_id", F.coalesce(key, F.col("req_no").cast("string")))
    best = F.row_number().over(same.orderBy(F.desc("weight"), (F.col("kind") == "hard").desc(), "req_no"))
    own = requirements.withColumn("_first", F.min("req_no").over(same)).withColumn("_n", best).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("jd_id").orderBy(key.isNull(), "_first", "req_no")) - 1
    return own.withColumn("pos", place).drop("_first", "_n")


def filter_spec(rubric: DataFrame) -> DataFrame:
    """Per job the largest min_years, the highest degree, the required skills and the any-of groups of its hard rows."""
    hard = F.col("kind") == "hard"
    return rubric.groupBy("jd_id").agg(
        F.max(F.when(hard, F.col("min_years"))).alias("min_years"),
        F.max_by(F.when(hard, F.col("degree_level")), F.when(hard & F.col("degree_level").isNotNull(), T.degree_rank(F.col("degree_level")))).alias("min_degree"),
        F.array_sort(F.collect_set(F.when(hard, F.col("canonical_skill")))).alias("required_skills"),
        F.array_sort(F.collect_list(F.when(hard & (F.size("any_of") > 0), F.col("any_of")))).alias("any_of"),
    )


def with_skills(candidates: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills of each candidate as one array; those without any keep an empty one."""
    own = skills.groupBy("resume_id").agg(F.array_sort(F.collect_set(F.lower("canonical"))).alias("skills"))
    return candidates.join(own, "resume_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def reasons(spec: str = "spec") -> Column:
    """Why a candidate fails; empty if it passes. ``spec`` is a struct of filter_spec beside the candidate's columns."""
    s = F.col(spec)
    # fixed values: the wording of reasons
    years = F.when((F.coalesce(s["min_years"], F.lit(0)) > 0) & (F.col("months") / 12 < s["min_years"]), F.format_string("%.1f years, needs %d+", T.years_of(F.col("months")), s["min_years"]))
    degree = F.when(s["min_degree"].isNotNull() & (T.degree_rank(F.col("degree")) < T.degree_rank(s["min_degree"])), F.concat(F.col("degree"), F.lit(", needs "), s["min_degree"]))
    missing = F.transform(F.filter(s["required_skills"], lambda x: ~F.array_contains(F.col("skills"), F.lower(x))), lambda x: F.concat(F.lit("missing "), x))
    none = F.transform(F.filter(s["any_of"], lambda x: ~F.arrays_overlap(x, F.col("skills"))), lambda x: F.concat(F.lit("none of "), F.array_join(x, ", ")))
    return F.concat(F.array_compact(F.array(years, degree)), missing, none)


def hard_filtered(candidates: DataFrame, specs: DataFrame) -> DataFrame:
    """Every candidate against every job's filter, with reasons and passed. Jobs are few beside candidates; the join is
    on a constant, so Spark broadcasts the specs only while they are under its threshold."""
    row = specs.select("jd_id", F.struct(*[c for c in specs.columns if c != "jd_id"]).alias("spec"))
    own = candidates.join(row, F.lit(True), "cross").withColumn("reasons", reasons())
    return own.withColumn("passed", F.size("reasons") == 0).drop("spec")


def scored_requirements(filtered: DataFrame, rubric: DataFrame, hits: DataFrame | None = None, gate_database_quotes: bool = False) -> DataFrame:
    """A row for each passer and soft requirement: score, source, and with ``hits`` (jd_id, req_no, resume_id,
    hit_score, quote: the candidate's best chunk) the evidence.

    A named skill counts by the database alone, with the best chunk as quote; only what names no skill is scored by
    retrieval, and there a quote below the floor is not shown. ``gate_database_quotes`` holds all quotes to the floor.
    """
    soft = rubric.where("kind = 'soft'").select("jd_id", "req_no", "weight", "canonical_skill", F.col("text").alias("requirement"))
    # what the skills say is settled before hits come in, so that no list of skills moves with a pair
    own = filtered.where("passed").select("jd_id", "resume_id", "skills").join(soft, "jd_id").withColumn("has", F.array_contains("skills", F.lower("canonical_skill"))).drop("skills")
    if hits is not None:
        own = own.join(hits.select("jd_id", "req_no", "resume_id", "hit_score", "quote"), ["jd_id", "req_no", "resume_id"], "left")
    else:
        own = own.withColumns({"hit_score": F.lit(None).cast("double"), "quote": F.lit(None).cast("string")})
    named, has = F.col("canonical_skill").isNotNull(), F.col("has")
    score = F.when(named & has, IN_DATABASE).when(named, 0.0).otherwise(F.coalesce("hit_score", F.lit(0.0)))
    source = F.when(named & has, "database").when(named | F.col("hit_score").isNull(), "missing").otherwise("retrieval")
    above = F.col("hit_score") >= FLOOR
    shown = (source == "database") & (above if gate_database_quotes else F.lit(True)) | (source == "retrieval") & above
    return own.select("jd_id", "resume_id", "req_no", "requirement", "weight", score.alias("score"), source.alias("source"), F.when(shown, F.col("quote")).alias("quote"))


def candidate_scores(filtered: DataFrame, evidence: DataFrame) -> DataFrame:
    """The weighted mean of a passer's scores and how many requirements it meets; 0 for the others."""
    own = evidence.groupBy("jd_id", "resume_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.count_if(F.col("score") >= MET).alias("met"), F.count("*").alias("n_soft"))
    joined = filtered.drop("skills").join(own, ["jd_id", "resume_id"], "left")
    return joined.withColumns({"score": F.coalesce("score", F.lit(0.0)), "met": F.coalesce("met", F.lit(0)), "n_soft": F.coalesce("n_soft", F.lit(0))})


def shortlist(scores: DataFrame, size: int | None = None, include_excluded: bool = True) -> DataFrame:
    """Rank 1.. of passers by score, then id; excluded ones follow with a null rank."""
    order = Window.partitionBy("jd_id").orderBy(F.desc("passed"), F.round("score", 12).desc(), "id")
    ranked = scores.withColumn("rank", F.when(F.col("passed"), F.row_number().over(order)))
    if size is not None:
        ranked = ranked.where(F.col("rank").isNull() | (F.col("rank") <= size))
    return ranked if include_excluded else ranked.where("passed")


def preview(quote: Column, width: int = 64) -> Column:
    """The first line of a quote, cut; that of a preview is the same again."""
    return F.substring(F.split(quote, "\n")[0], 1, width)


def previews(evidence: DataFrame, n: int = 3, width: int = 64) -> DataFrame:
    """Of each passer the n requirements with the highest weighted score, and the first line of their quote, cut."""
    order = Window.partitionBy("jd_id", "resume_id").orderBy(F.round(F.col("score") * F.col("weight"), 9).desc(), "req_no")
    own = evidence.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return own.withColumn("preview", preview(F.col("quote"), width))


def response(ranked: DataFrame, evidence: DataFrame, size: int) -> DataFrame:
    """The shortlist as rows for a reader: scores at four digits, evidence by weighted score."""
    key = F.struct((-F.round(F.col("score") * F.col("weight"), 9)).alias("k"), "req_no", "requirement", F.round("score", 4).alias("score"), "source", "quote")
    own = evidence.groupBy("jd_id", "resume_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.dropFields("k")).alias("evidence"))
    return ranked.where(F.col("rank") <= size).join(own, ["jd_id", "resume_id"], "left").select("jd_id", "rank", "resume_id", F.round("score", 4).alias("score"), "met", "n_soft", "evidence")


def whole_response(ranked: DataFrame, rubric: DataFrame, spec: DataFrame, duplicates: DataFrame, size: int) -> DataFrame:
    """The answer to a request as rows (jd_id, part, place, name, value, notes), so that no job's candidates are one row.

    shortlist: rank, resume_id, score at four digits, other members of its duplicate group (jd_id, resume_id, other_ids) on the
    list; excluded: resume_id and reasons; rubric: place, text, weight, kind with skill and degree; spec: degree, years,
    required skills and any-of groups; counts: passed, all.
    """
    none = F.array().cast("array<string>")
    row = lambda df, part, place, name, value, notes: df.select("jd_id", F.lit(part).alias("part"), place.cast("int").alias("place"), name.alias("name"), value.cast("double").alias("value"), notes.alias("notes"))
    null, c = F.lit(None), F.col
    listed = ranked.where(c("rank") <= size).join(duplicates, ["jd_id", "resume_id"], "left")
    counts = ranked.groupBy("jd_id").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"))
    parts = [
        row(listed, "shortlist", c("rank"), c("resume_id"), F.round("score", 4), F.coalesce("other_ids", none)),
        row(ranked.where("rank is null"), "excluded", null, c("resume_id"), null, c("reasons")),
        row(rubric, "rubric", c("pos"), c("text"), c("weight"), F.array_sort(F.array_compact(F.array("kind", "canonical_skill", "degree_level")))),
        row(spec, "spec", null, F.coalesce("min_degree", F.lit("")), c("min_years"), F.concat("required_skills", F.transform("any_of", lambda x: F.array_join(x, ", ")))),
        row(counts, "counts", c("n_passed"), F.lit("passed"), c("n"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def having_all(candidates: DataFrame, bridge: DataFrame, wanted: DataFrame, key: str = "skill") -> DataFrame:
    """Relational division: candidates that have every wanted skill."""
    n = wanted.select(key).distinct().agg(F.count("*").alias("n"))
    own = bridge.join(wanted.select(key).distinct(), key, "left_semi").groupBy("resume_id").agg(F.count_distinct(key).alias("has")).crossJoin(F.broadcast(n)).where("has = n")
    return candidates.join(own, "resume_id", "left_semi")
