"""Profiles: dates and durations of jobs, issues, degrees, skills."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as K
from ..functions import text as T
from ..functions.tables import skill_aliases
from ..runtime import prepare, stored
from .dedupe import likely_duplicates


def coherent_dates(jobs: DataFrame) -> DataFrame:
    """A current job has no end; years the wrong way round are swapped, months stay."""
    swapped = ~F.col("is_current") & (F.col("end_year") < F.col("start_year"))
    swapped = F.coalesce(swapped, F.lit(False))
    return jobs.withColumns({
        "start_year": F.when(swapped, F.col("end_year")).otherwise(F.col("start_year")),
        "end_year": F.when(F.col("is_current"), None).when(swapped, F.col("start_year")).otherwise(F.col("end_year")),
        "end_month": F.when(~F.col("is_current"), F.col("end_month")),
    })


def month_spans(jobs: DataFrame, today: int) -> DataFrame:
    """start_index, end_index (``today`` for a current job) and duration, 0 if either is missing."""
    end = F.when(F.col("is_current"), F.lit(today)).otherwise(T.month_index(F.col("end_year"), F.col("end_month")))
    own = jobs.withColumns({"start_index": T.month_index(F.col("start_year"), F.col("start_month")), "end_index": end})
    return own.withColumn("duration", F.greatest(F.lit(0), F.coalesce(F.col("end_index") - F.col("start_index"), F.lit(0))))


def completeness(name: Column, n_jobs: Column, n_skills: Column, months: Column, n_degrees: Column) -> Column:
    """What a profile lacks."""
    said = [(F.coalesce(name, F.lit("")) == "", K.NO_NAME), (n_jobs == 0, K.NO_WORK), (n_skills == 0, K.NO_SKILLS), ((n_jobs > 0) & (months == 0), K.NO_DATES), (n_degrees == 0, K.NO_EDUCATION)]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in said]))


def _before(*keys: str, order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def covered(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of half-open spans per key; spans that touch join, empty and reversed ones are dropped."""
    own = spans.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    reach = own.withColumn("_reach", F.max(end).over(_before(*keys, order=start)))
    fresh = reach.withColumn("_new", F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))))
    return fresh.groupBy(*keys).agg(F.sum(F.greatest(F.col("_new"), F.lit(0))).alias("covered"), F.count_if(F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).alias("n_islands"))


def gaps(spans: DataFrame, keys: list[str], start: str, end: str, today: int | Column, least: int = 6) -> DataFrame:
    """whether a key has a gap of ``least`` between spans or since the last one."""
    own = spans.withColumn("_gap", F.col(start) - F.max(end).over(_before(*keys, order=start)))
    return own.groupBy(*keys).agg((F.coalesce(F.max("_gap"), F.lit(0)) >= least).alias("_between"), (F.lit(today) - F.max(end) >= least).alias("_since")).select(*keys, (F.col("_between") | F.col("_since")).alias("has_gap"))


def highest_degree(degrees: DataFrame, key: str, level: str = "level") -> DataFrame:
    """The level highest on the ladder."""
    return degrees.groupBy(key).agg(F.coalesce(F.max_by(level, T.degree_rank(F.col(level))), F.lit("unknown")).alias("highest_degree"))


def chronological(jobs: DataFrame, key: str, tie: str, start: str = "start_index") -> DataFrame:
    """position 0 is the latest start; jobs without one come last."""
    order = Window.partitionBy(key).orderBy(F.coalesce(start, F.lit(-1)).desc(), tie)
    return jobs.withColumn("position", F.row_number().over(order) - 1)


def current_role(jobs: DataFrame, key: str, what: str) -> DataFrame:
    """the first current job, else the latest."""
    return jobs.groupBy(key).agg(F.min_by(what, F.struct(~F.col("is_current"), "position")).alias(what))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """F8: the first row of each key; order-stable, unlike dropDuplicates."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def vocabulary(spark: object) -> DataFrame:
    """alias_pos, alias (cleaned), canonical; of one alias the last entry counts, in the place of the first."""
    rows = spark.createDataFrame(skill_aliases(), "alias_pos int, raw string, canonical string")
    cleaned = rows.select("alias_pos", T.vocabulary_form(F.col("raw")).alias("alias"), "canonical")
    return cleaned.groupBy("alias").agg(F.min("alias_pos").alias("alias_pos"), F.max_by("canonical", "alias_pos").alias("canonical"))


#: Aliases that one automaton holds; a larger vocabulary is met by a join.
AUTOMATON = 20_000


def _longest_inside(batches: Iterator[pa.RecordBatch], words: list[tuple[str, int, str]]) -> Iterator[pa.RecordBatch]:
    """The canonical of the longest alias that stands in each text, the first by place among those of one length."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for alias, place, canonical in words:
        automaton.add_word(alias, (-len(alias), place, canonical))
    automaton.make_automaton()
    for batch in batches:
        found = [min((x for _, x in automaton.iter(t)), default=None) for t in batch.column("cleaned").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("surface"), pa.array([x and x[2] for x in found], pa.string())], names=["surface", "c3"])


def longest_alias(texts: DataFrame, words: DataFrame, automaton: int | None = None) -> DataFrame:
    """(surface, c3) for texts (surface, cleaned): the canonical of the longest alias, of four letters or more, in each.

    A vocabulary of up to ``AUTOMATON`` aliases is read as one automaton, which finds all of them in one pass of a text; a
    larger one meets the texts in a join.
    """
    own = words.where(F.length("alias") >= 4).select("alias", "alias_pos", "canonical")
    limit = AUTOMATON if automaton is None else automaton
    held = [tuple(r) for r in own.limit(limit + 1).collect()]
    if held and len(held) <= limit:
        prepare(texts.sparkSession)
        return texts.select("surface", "cleaned").mapInArrow(lambda it: _longest_inside(it, held), "surface string, c3 string").where("c3 is not null")
    return texts.join(own, F.col("cleaned").contains(F.col("alias"))).groupBy("surface").agg(F.min_by("canonical", F.struct(-F.length("alias"), "alias_pos")).alias("c3"))


def canonical_skills(surfaces: DataFrame, surface: str, words: DataFrame | None = None) -> DataFrame:
    """D3: canonical name and whether it is known, for each distinct surface.

    Passes: the cleaned surface is an alias; it is one without its parenthesis; the longest alias of four letters or
    more that it contains. An unknown surface keeps its own trimmed form. Surfaces are made distinct first.
    """
    words = words if words is not None else F.broadcast(vocabulary(surfaces.sparkSession))  # a fixed table of under 200 rows
    own = surfaces.select(surface).distinct().withColumn("cleaned", T.vocabulary_form(F.col(surface)))
    own = own.withColumn("bare", T.vocabulary_form(F.regexp_replace(surface, r"\s*\([^)]*\)", "")))
    exact = words.select(F.col("alias").alias("cleaned"), F.col("canonical").alias("c1"))
    bare = words.select(F.col("alias").alias("bare"), F.col("canonical").alias("c2"))
    looked = stored(own.join(exact, "cleaned", "left").join(bare, "bare", "left"), "surfaces")
    left = looked.where("c1 is null and c2 is null and cleaned <> ''").select(F.col(surface).alias("surface"), "cleaned")
    inside = longest_alias(left, words).withColumnRenamed("surface", surface)
    found = looked.join(inside, surface, "left").withColumn("found", F.coalesce("c1", "c2", "c3"))
    return found.select(surface, "cleaned", F.coalesce("found", F.trim(surface)).alias("canonical"), F.col("found").isNotNull().alias("known"))


def unknown_skills(canonical: DataFrame, counts: DataFrame, surface: str, n: int = 20) -> DataFrame:
    """The commonest cleaned surfaces that the vocabulary doesn't know."""
    own = canonical.where("not known and cleaned <> ''").join(counts, surface).groupBy("cleaned").agg(F.sum("n").alias("n"))
    return own.orderBy(F.desc("n"), "cleaned").limit(n)


def loaded(records: DataFrame, today: int, as_of: int, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records (resume_id, job_id, profile) as the tables candidates, experience, education and skills.

    ``profile`` has full_name, email, and as arrays of structs skills (name), experience (company, title, start and end
    year and month, is_current) and education (level, start_year, end_year). Months and years out of range become null
    (B13), dates are put in order (B14) and jobs numbered from the latest (F9); of skills with one lower-case name the first
    counts (F8), with its canonical name (D3, looked up once for each distinct surface); a degree that isn't known is
    unknown; likely duplicates are marked (D5). Nothing but the rows of a record meets to make its tables.
    """
    child = lambda field, no: records.select("resume_id", F.posexplode(f"profile.{field}").alias(no, "_x")).select("resume_id", no, "_x.*")
    valid = lambda c: (c, (T.valid_year(F.col(c), as_of) if c.endswith("year") else T.valid_month(F.col(c))))
    jobs = coherent_dates(child("experience", "job_no").withColumns(dict(map(valid, ("start_year", "start_month", "end_year", "end_month")))))
    spans = month_spans(jobs, today)
    experience = chronological(spans, "resume_id", "job_no")
    education = child("education", "edu_no").withColumns(dict(map(valid, ("start_year", "end_year")))).withColumn("level", F.lower(F.trim("level")))
    education = education.withColumn("level", F.when(F.col("level").isin(*K.DEGREES), F.col("level")).otherwise("unknown"))
    named = child("skills", "skill_no").withColumn("surface", F.trim("name")).where("surface <> ''").withColumn("_form", F.lower("surface"))
    once = first_of_each(named, ["resume_id", "_form"], ["skill_no"]).select("resume_id", "skill_no", "surface")
    skills = once.join(canonical_skills(once, "surface", words).drop("cleaned"), "surface").select("resume_id", "skill_no", "surface", "canonical", "known")
    months = covered(spans, ["resume_id"], "start_index", "end_index").select("resume_id", F.col("covered").cast("int").alias("months"))
    now = spans.groupBy("resume_id").agg(F.max("is_current").alias("currently_employed"))
    own = records.join(months, "resume_id", "left").join(highest_degree(education, "resume_id"), "resume_id", "left").join(now, "resume_id", "left")
    total = F.coalesce("months", F.lit(0))
    size = lambda field: F.coalesce(F.size(f"profile.{field}"), F.lit(0))
    issues = completeness(F.col("profile.full_name"), size("experience"), size("skills"), total, size("education"))
    people = own.select("resume_id", "job_id", F.col("profile.full_name").alias("full_name"), F.col("profile.email").alias("email"), total.alias("total_experience_months"), F.coalesce("highest_degree", F.lit("unknown")).alias("highest_degree"), F.coalesce("currently_employed", F.lit(False)).alias("currently_employed"), issues.alias("issues"))
    candidates = likely_duplicates(people.withColumn("id", F.col("resume_id"))).drop("id")
    return {"candidates": candidates, "experience": experience, "education": education, "skills": skills}


def load_profiles(records: DataFrame, today: int) -> DataFrame:
    """One candidate row per record (resume_id, profile): validated dates, months covered, degree, issues.

    ``profile`` has full_name, skills, experience, education as arrays of structs.
    """
    jobs = records.select("resume_id", F.posexplode("profile.experience").alias("job_no", "j")).select("resume_id", "job_no", "j.*")
    spans = month_spans(coherent_dates(jobs), today)
    months = covered(spans, ["resume_id"], "start_index", "end_index").select("resume_id", F.col("covered").cast("int").alias("total_experience_months"))
    degrees = highest_degree(records.select("resume_id", F.explode("profile.education").alias("e")).select("resume_id", F.lower("e.level").alias("level")), "resume_id")
    now = spans.groupBy("resume_id").agg(F.max("is_current").alias("currently_employed"))
    own = records.join(months, "resume_id", "left").join(degrees, "resume_id", "left").join(now, "resume_id", "left")
    total = F.coalesce("total_experience_months", F.lit(0))
    issues = completeness(F.col("profile.full_name"), F.size("profile.experience"), F.size("profile.skills"), total, F.size("profile.education"))
    return own.select("resume_id", F.col("profile.full_name").alias("full_name"), total.alias("total_experience_months"), F.coalesce("highest_degree", F.lit("unknown")).alias("highest_degree"), F.coalesce("currently_employed", F.lit(False)).alias("currently_employed"), issues.alias("issues"))
