"""Quality of retrieval, extraction and chunking against known answers. What is undefined is NULL, never NaN."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import prepare

RELEVANT = 2


def recall_at(ranked: DataFrame, labels: DataFrame, k: int, *keys: str, of: tuple[str, ...] | None = None) -> DataFrame:
    """Share of the relevant labels (grade 2 or more) that are within the first k; null where there are none.

    ranked: keys, rank, grade of what was found; labels: ``of`` (keys, or fewer of them, if several runs are held against
    one set of labels) and grade, of all that is known, found or not.
    """
    of = of or keys
    every = labels.groupBy(*of).agg(F.count_if(F.col("grade") >= RELEVANT).alias("b"))
    every = every.join(ranked.select(*keys).distinct(), list(of), "inner" if of != keys else "left")
    found = ranked.where((F.col("grade") >= RELEVANT) & (F.col("rank") <= k)).groupBy(*keys).agg(F.count("*").alias("a"))
    return every.join(found, list(keys), "left").select(*keys, F.when(F.col("b") > 0, F.coalesce("a", F.lit(0)) / F.col("b")).alias(f"recall_{k}"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg_at(ranked: DataFrame, labels: DataFrame, k: int, *keys: str, of: tuple[str, ...] | None = None) -> DataFrame:
    """I16: discounted gain of the first k over that of the best order of all labels; null if that is 0.

    ``of``: the keys of labels, where ``keys`` has more of them: several runs are held against one set of labels.
    """
    of = of or keys
    dcg = ranked.where(F.col("rank") <= k).groupBy(*keys).agg(F.sum(_gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = labels.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("grade")))).where(F.col("_r") <= k)
    ideal = best.groupBy(*of).agg(F.sum(_gain(F.col("grade"), F.col("_r"))).alias("ideal"))
    every = ideal.join(ranked.select(*keys).distinct(), list(of), "inner" if of != keys else "left")
    return every.join(dcg, list(keys), "left").select(*keys, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias(f"ndcg_{k}"))


def mrr(ranked: DataFrame, *keys: str) -> DataFrame:
    """One over the rank of the first relevant hit, else 0."""
    return ranked.groupBy(*keys).agg(F.coalesce(1 / F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def ranking_place(allowed: Column, score: Column, number: Column) -> Column:
    """What candidates are ordered by, ascending: by score and then the later number first; those that a filter
    excluded are appended by number."""
    return F.struct((~allowed).cast("int").alias("last"), F.when(allowed, -F.round(score, 9)).otherwise(0.0).alias("score"), F.when(allowed, -number).otherwise(number).alias("number"))


def compare_configs(scores: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = (10, 20, 45)) -> DataFrame:
    """Mean recall, nDCG and MRR of each configuration.

    scores: config, query_id, candidate, place (a struct that orders a configuration's candidates for a query); every
    candidate has a row, so nobody is missing from a ranking. labels: query_id, candidate, grade. Queries without a relevant
    label are undefined and don't count in the means. Only the first of each ranking are sorted; where the first relevant
    candidate stands is a count of those before it.
    """
    keys = ("config", "query_id")
    known = labels.groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("n_rel")).where("n_rel > 0").select("query_id")
    own = scores.join(known, "query_id", "left_semi")
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("rank") <= max(cutoffs))
    graded = first.select(*keys, "candidate", "rank").join(labels, ["query_id", "candidate"], "left")
    best = own.join(labels.where(F.col("grade") >= RELEVANT), ["query_id", "candidate"], "left_semi").groupBy(*keys).agg(F.min("place").alias("best"))
    before = own.join(best, list(keys)).where("place < best").groupBy(*keys).agg(F.count("*").alias("before"))
    out = own.select(*keys).distinct().join(best, list(keys), "left").join(before, list(keys), "left")
    out = out.select(*keys, F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.coalesce("before", F.lit(0)))).alias("mrr"))
    for k in cutoffs:
        for metric in (recall_at, ndcg_at):
            out = out.join(metric(graded, labels, k, *keys, of=("query_id",)), list(keys), "left")
    return out.groupBy("config").agg(F.count("*").alias("n_queries"), F.avg("mrr").alias("mrr"), *[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for k in cutoffs for m in ("recall", "ndcg")])


def best_marked(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Which configuration is best in each metric, ties within 1e-9."""
    everything = Window.partitionBy(F.lit(0))  # one row for each configuration
    return metrics.withColumns({f"best_{m}": F.abs(F.col(m) - F.max(m).over(everything)) < 1e-9 for m in names})


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(sets: DataFrame, found: str = "found", truth: str = "truth") -> DataFrame:
    """Micro precision, recall and F1 over rows with two arrays."""
    own = sets.agg(F.sum(F.size(F.array_intersect(found, truth))).alias("tp"), F.sum(F.size(F.array_except(found, truth))).alias("fp"), F.sum(F.size(F.array_except(truth, found))).alias("fn"))
    p, r = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return own.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _safe(2 * p * r, p + r).alias("f1"))


def most_common(arrays: DataFrame, values: Column, n: int = 5) -> DataFrame:
    """The n values that occur in most rows."""
    return arrays.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def tolerance(rows: DataFrame, a: str, b: str, key: str | None = None, n: int = 5) -> DataFrame:
    """How many differ by under 0.05, how many by at most 1, and with ``key`` the n that are furthest off."""
    off = F.abs(F.col(a) - F.col(b))
    total = rows.agg(F.count("*").alias("n"), F.count_if(off < 0.05).alias("exact"), F.count_if(off <= 1.0).alias("close"))
    if key is None:
        return total
    far = rows.select(off.alias("off"), key).where("off is not null").orderBy(F.desc("off"), key).limit(n)
    return total.crossJoin(F.broadcast(far.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("off")).alias("k"), key))), lambda x: x[key]).alias("worst"))))


def split_accuracy(found: DataFrame) -> DataFrame:
    """Per section, how often the number of entries is right, too small, too large."""
    f, t = F.coalesce("found", F.lit(0)), F.col("truth")
    return found.groupBy("section").agg(F.count_if(f == t).alias("exact"), F.count_if(f < t).alias("under"), F.count_if(f > t).alias("over"))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, truth_no, found_no) from rows sorted by key, found rows before truth rows, each by number.

    Only the found rows of the key at hand that are not taken yet are held, by name.
    """
    key, free, begun = None, {}, False
    for batch in batches:
        out: list[list] = [[], [], []]
        for k, kind, no, name in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "no", "name")), strict=True):
            if not begun or k != key:
                key, free, begun = k, {}, True
            if kind == 0:
                free.setdefault(name, deque()).append(no)
                continue
            # numbers wait in order, so the first of a name is its smallest
            if best := min(((own[0], f) for f, own in free.items() if f in name or name in f), default=None):
                own = free[best[1]]
                own.popleft()
                if not own:
                    del free[best[1]]
                out[0].append(k)
                out[1].append(no)
                out[2].append(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("key").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["key", "truth_no", "found_no"])


def matched_companies(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Greedy one-to-one match of names within a document: equal, or one inside the other. (key, found_no, truth_no)

    Truth rows take, in order, the first found row not yet taken. Both sides come as one sorted stream: no pair is built but
    those that match, and of a document only the names not taken are held.
    """
    prepare(found.sparkSession)
    rows = lambda df, kind, side: df.where(F.col(f"{side}_name") != "").select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(f"{side}_no").cast("long").alias("no"), F.col(f"{side}_name").alias("name"))
    both = rows(found, 0, "found").unionByName(rows(truth, 1, "truth")).where("key is not null").repartition("key").sortWithinPartitions("key", "kind", "no")
    kind = found.schema[key].dataType.simpleString()
    out = both.mapInArrow(_taken, f"key {kind}, truth_no long, found_no long")
    return out.select(F.col("key").alias(key), F.col("truth_no").cast(truth.schema["truth_no"].dataType), F.col("found_no").cast(found.schema["found_no"].dataType))


def canonicalised(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(name, canonical): the canonical of the longest surface that holds the name or stands in it, ties first by
    surface; else the name itself. names: name; vocabulary: surface, canonical.

    A string that stands in another begins with three of its letters in a row (or fewer, if it has fewer), so the two
    meet by that piece instead of all with all.
    """
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, n))).otherwise(F.array().cast("array<string>")))))
    start = lambda c: F.substring(c, 1, 3)
    n, v = names.select("name").distinct(), vocabulary.where("surface <> ''").select("surface", "canonical")
    known = n.where("name <> ''")
    holds = v.withColumn("piece", F.explode(pieces(F.col("surface")))).join(known.withColumn("piece", start(F.col("name"))), "piece").where(F.col("surface").contains(F.col("name")))
    inside = known.withColumn("piece", F.explode(pieces(F.col("name")))).join(v.withColumn("piece", start(F.col("surface"))), "piece").where(F.col("name").contains(F.col("surface")))
    best = holds.select("name", "surface", "canonical").unionByName(inside.select("name", "surface", "canonical")).groupBy("name").agg(F.min_by("canonical", F.struct(-F.length("surface"), "surface")).alias("canonical"))
    return n.join(best, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def lost_lines(truth: DataFrame, chunked: DataFrame, key: str) -> DataFrame:
    """Lines (key, text) of truth that stand in no chunk (key, text) of the same document."""
    body = chunked.groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("body"))
    return truth.join(body, key, "left").where(~F.coalesce(F.col("body").contains(F.col("text")), F.lit(False))).drop("body")


def mixed_chunks(chunked: DataFrame, employers: DataFrame, key: str, *chunk: str) -> DataFrame:
    """Chunks (key, chunk.., text) that name more than one employer (key, employer) of their own document, and how many."""
    met = chunked.join(employers.where("employer <> ''").distinct(), key).where(F.col("text").contains(F.col("employer")))
    return met.groupBy(key, *chunk).agg(F.count("*").alias("n_employers")).where("n_employers > 1")


def verbatim(truth: DataFrame, found: DataFrame, key: str, form: str) -> DataFrame:
    """How many truth bullets there are, and how many have the form of a bullet found in the same document."""
    there = found.select(key, form).distinct().withColumn("there", F.lit(1))
    return truth.join(there, [key, form], "left").agg(F.count("*").alias("n"), F.count("there").alias("verbatim"))


def field_accuracies(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per field the share of documents whose profile is right; of years, the share of matched jobs.

    Profiles: name, email, phone, level, jobs (array of structs company, start_year, end_year, in order), n_education.
    Names are compared in B7 form, contact details by presence; jobs are paired by D11 on their companies' B7 form, and
    their years compared, null equal to null; a level counts as right if both or neither are postgraduate.
    """
    f, t = (lambda c: F.col(f"f.{c}")), (lambda c: F.col(f"t.{c}"))
    own = truth.select(key, F.struct(*[c for c in truth.columns if c != key]).alias("t")).join(found.select(key, F.struct(*[c for c in found.columns if c != key]).alias("f")), key)
    share = lambda c: F.avg(c.cast("int"))
    post = lambda c: F.coalesce(c.isin("master", "doctorate"), F.lit(False))
    jobs = lambda df, side: df.select(key, F.posexplode("jobs").alias(f"{side}_no", "j")).select(key, f"{side}_no", T.comparison_form(F.col("j.company")).alias(f"{side}_name"), F.struct("j.start_year", "j.end_year").alias(side))
    found_jobs, truth_jobs = jobs(found, "found"), jobs(truth, "truth")
    pairs = matched_companies(found_jobs, truth_jobs, key).join(found_jobs.drop("found_name"), [key, "found_no"]).join(truth_jobs.drop("truth_name"), [key, "truth_no"])
    right = lambda c: F.avg(F.col(f"found.{c}").eqNullSafe(F.col(f"truth.{c}")).cast("int")).alias(c)
    years = pairs.agg(F.count("*").alias("n_matched"), right("start_year"), right("end_year"))
    return own.agg(
        F.count("*").alias("n"),
        share(T.comparison_form(f("name")).eqNullSafe(T.comparison_form(t("name")))).alias("name"),
        share(f("email").isNotNull() == t("email").isNotNull()).alias("email"),
        share(f("phone").isNotNull() == t("phone").isNotNull()).alias("phone"),
        share(F.size(f("jobs")) == F.size(t("jobs"))).alias("job_count"),
        share(post(f("level")) == post(t("level"))).alias("postgraduate"),
        share(f("n_education") == t("n_education")).alias("education_count"),
    ).crossJoin(F.broadcast(years))  # one row each


def graded(sets: DataFrame) -> DataFrame:
    """Grade 0..3 from must, nice, skills (arrays), years_ok, degree_ok, role_ok."""
    missing = F.size(F.array_except("must", "skills")) > 0
    some = F.size(F.array_intersect("must", "skills")) > 0
    nice = F.size(F.array_intersect("nice", "skills")) > 0
    grade = F.when(missing, F.when(some & F.col("years_ok"), 1).otherwise(0)).when(~F.col("years_ok") | ~F.col("degree_ok"), 1).when(F.col("role_ok") & nice, 3).otherwise(2)
    return sets.withColumn("grade", grade)


def relaxed(bridge: DataFrame, must: DataFrame, least: int = 5, eligible: DataFrame | None = None) -> DataFrame:
    """Per job the must-have skills that stay, so that ``least`` candidates reach grade 2; the rarest go first.

    must: jd_id, skill; bridge: resume_id, skill. Grade 2 takes all skills, and years and degree that don't change: who has
    these is in ``eligible`` (jd_id, resume_id), everyone by default. All prefixes by frequency are counted in one ordered
    scan: a candidate has the first n skills of a job if the n-th it has is the n-th there is. At least one skill stays; what
    goes is in ``nice``.
    """
    freq = bridge.groupBy("skill").agg(F.count_distinct("resume_id").alias("freq"))
    own = must.join(freq, "skill", "left").withColumn("place", F.row_number().over(Window.partitionBy("jd_id").orderBy(F.coalesce("freq", F.lit(0)).desc(), "skill")))
    met = bridge.join(own, "skill")
    if eligible is not None:
        met = met.join(eligible, ["jd_id", "resume_id"], "left_semi")
    have = met.withColumn("nth", F.row_number().over(Window.partitionBy("jd_id", "resume_id").orderBy("place"))).where("nth = place")
    n = have.groupBy("jd_id", "place").agg(F.count("*").alias("n"))
    keep = n.where(F.col("n") >= least).groupBy("jd_id").agg(F.max("place").alias("keep"))
    kept = own.join(keep, "jd_id", "left").withColumn("stays", F.col("place") <= F.greatest(F.coalesce("keep", F.lit(1)), F.lit(1)))
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("skill"))))
    return kept.groupBy("jd_id").agg(of(F.col("stays")).alias("must"), of(~F.col("stays")).alias("nice"), F.count_if(~F.col("stays")).alias("n_relaxed"))
