"""Ranking, profiles, duplicates, fairness, evaluation and retrieval against hand-made cases and plain Python."""

import math
import random
import types

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import dedupe as D
from veritrail.operators import evaluate as E
from veritrail.operators import fairness as A
from veritrail.operators import profile as P
from veritrail.operators import rank as R
from veritrail.operators import retrieval as X


def test_interval_union(spark):
    r = random.Random(1)
    rows = [("fixture", 0, 12), ("fixture", 6, 24), ("fixture", 24, 30), ("fixture", 40, 41)]
    for k in range(40):
        for _ in range(r.randrange(1, 9)):
            s = r.randrange(50)
            rows.append((f"k{k}", s, s + r.randrange(-2, 9)))
    got = {x.key: x.covered for x in P.covered(spark.createDataFrame(rows, "key string, s int, e int"), ["key"], "s", "e").collect()}
    want = {}
    for k, s, e in rows:
        want.setdefault(k, set()).update(range(s, e))
    assert got == {k: len(v) for k, v in want.items() if v} and got["fixture"] == 31


def test_dates(spark):
    rows = [(1, 2023, 5, 2021, 7, False), (2, 2020, None, None, None, True), (3, None, None, 2020, 1, False)]
    got = {x.id: x for x in P.month_spans(P.coherent_dates(spark.createDataFrame(rows, "id int, start_year int, start_month int, end_year int, end_month int, is_current boolean")), 2025 * 12).collect()}
    assert (got[1].start_year, got[1].end_year, got[1].start_month) == (2021, 2023, 5)
    assert got[2].duration == 60 and got[3].duration == 0


def test_canonical_skills(spark):
    got = {x.s: (x.canonical, x.known) for x in P.canonical_skills(spark.createDataFrame([(t,) for t in ("Torch", "Power BI (DAX)", "HTML", "Zig ", "advanced kubernetes work", "", "K8S")], "s string"), "s").collect()}
    assert got == {"Torch": ("PyTorch", True), "Power BI (DAX)": ("Power BI", True), "HTML": ("HTML", False), "Zig ": ("Zig", False), "advanced kubernetes work": ("Kubernetes", True), "": ("", False), "K8S": ("Kubernetes", True)}


def test_profiles(spark):
    job = "struct<company:string,start_year:int,start_month:int,end_year:int,end_month:int,is_current:boolean>"
    schema = f"resume_id string, profile struct<full_name:string,skills:array<string>,experience:array<{job}>,education:array<struct<level:string>>>"
    rows = [("a", ("Ann", ["sql"], [("x", 2018, 1, 2020, 1, False), ("y", 2019, 1, 2021, 1, False)], [("Master",), ("bachelor",)])), ("b", (None, [], [], []))]
    got = {x.resume_id: x for x in P.load_profiles(spark.createDataFrame(rows, schema), 2025 * 12).collect()}
    assert (got["a"].total_experience_months, got["a"].highest_degree, got["a"].issues) == (36, "master", [])
    assert (got["b"].total_experience_months, got["b"].highest_degree, got["b"].issues) == (0, "unknown", ["no name found", "no work experience found", "no skills found", "no education found"])


def test_duplicates(spark):
    rows = [(1, "r1", "j", " Ann ", "a@x"), (2, "r2", "j", "ann", "A@X"), (3, "r3", "j", "ANN", "a@x"), (4, "r4", "k", "ann", "a@x"), (5, "r5", None, "ann", "a@x"), (6, "r6", None, "ann", "a@x"), (7, "r7", "j", "", "a@x"), (8, "r8", "j", "", "a@x"), (9, "r9", "j", None, None)]
    got = D.likely_duplicates(spark.createDataFrame(rows, "id long, resume_id string, job_id string, full_name string, email string"))
    assert {x.id: x.duplicate_of for x in got.collect()} == {1: None, 2: "r1", 3: "r1", 4: None, 5: None, 6: "r5", 7: None, 8: None, 9: None}
    assert {x.id: x.other_ids for x in D.group_members(got).collect()}[2] == ["r1", "r3"]
    assert sorted(map(tuple, D.duplicate_groups(got).collect()), key=str) == [("j", "r1", "r1", 1, 3), ("j", "r1", "r2", 2, 3), ("j", "r1", "r3", 3, 3), (None, "r5", "r5", 1, 2), (None, "r5", "r6", 2, 2)]


def spec(spark, **more):
    base = {"min_years": 5, "min_degree": "master", "required_skills": ["Python"], "any_of": [["aws", "gcp"]]} | more
    return spark.createDataFrame([("jd", *base.values())], "jd_id string, min_years int, min_degree string, required_skills array<string>, any_of array<array<string>>")


def test_hard_filter_says_why(spark):
    c = spark.createDataFrame([(1, "a", 36, "bachelor", ["sql"]), (2, "b", 72, "doctorate", ["python", "gcp"]), (3, "c", 60, "master", ["python"])], "id int, resume_id string, months int, degree string, skills array<string>")
    got = {x.resume_id: (x.reasons, x.passed) for x in R.hard_filtered(c, spec(spark)).collect()}
    assert got["a"] == (["3.0 years, needs 5+", "bachelor, needs master", "missing Python", "none of aws, gcp"], False)
    assert got["b"] == ([], True) and got["c"] == (["none of aws, gcp"], False)


def test_weighted_score_and_shortlist(spark):
    f = spark.createDataFrame([("jd", 1, "a", ["x"], True, []), ("jd", 2, "b", ["x", "y"], True, []), ("jd", 3, "c", [], False, ["no"])], "jd_id string, id int, resume_id string, skills array<string>, passed boolean, reasons array<string>")
    rubric = spark.createDataFrame([("jd", 0, "soft", 3, "X", "t0"), ("jd", 1, "soft", 1, "Y", "t1")], "jd_id string, req_no int, kind string, weight int, canonical_skill string, text string")
    got = {x.resume_id: (round(x.score, 4), x.met, x.rank) for x in R.shortlist(R.candidate_scores(f, R.scored_requirements(f, rubric))).collect()}
    assert got == {"a": (0.7125, 1, 2), "b": (0.95, 2, 1), "c": (0.0, 0, None)}


def test_rubric_dedupe(spark):
    rows = [("j", 0, "SQL", "soft", 1), ("j", 1, "Python", "soft", 2), ("j", 2, None, "soft", 3), ("j", 3, "Python", "hard", 1), ("j", 4, "python", "hard", 2)]
    got = sorted((x.pos, x.req_no) for x in R.deduped(spark.createDataFrame(rows, "jd_id string, req_no int, canonical_skill string, kind string, weight int")).collect())
    assert got == [(0, 0), (1, 4), (2, 2)]


def test_impact_ratio(spark):
    g = spark.createDataFrame([("a", "x", 10, 5, 0.5, True), ("a", "y", 20, 6, 0.3, True), ("a", "z", 3, 0, 0.0, False), ("b", "x", 10, 0, 0.0, True), ("b", "y", 10, 0, 0.0, True), ("c", "x", 12, 6, 0.5, True)], "attribute string, value string, total long, selected long, selection_rate double, reliable boolean")
    got = {x.attribute: (x.impact_ratio, x.flagged) for x in A.impact(g).collect()}
    assert got["a"] == (pytest.approx(0.6), True) and got["b"] == (None, False) and got["c"] == (None, False)


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("q", 1, 0), ("q", 2, 3)], "query_id string, rank int, grade int")
    labels = spark.createDataFrame([("q", 3)], "query_id string, grade int")
    assert E.ndcg_at(run, labels, 2, "query_id").first()["ndcg_2"] == pytest.approx(1 / math.log2(3))
    late = spark.createDataFrame([("q", k, 2 if k == 4 else 1) for k in range(1, 6)] + [("p", 1, None)], "query_id string, rank int, grade int")
    assert {x.query_id: x.mrr for x in E.mrr(late, "query_id").collect()} == {"q": 0.25, "p": 0.0}
    known = spark.createDataFrame([("q", 3), ("q", 2), ("p", 1), ("unseen", 2)], "query_id string, grade int")
    assert {x.query_id: x.recall_3 for x in E.recall_at(late, known, 3, "query_id").collect()} == {"q": 0.0, "p": None, "unseen": 0.0}
    assert {x.query_id: x.recall_9 for x in E.recall_at(late, known, 9, "query_id").collect()} == {"q": 0.5, "p": None, "unseen": 0.0}


def test_grades(spark):
    rows = [(["a"], ["b"], ["a", "b"], True, True, True), (["a"], ["b"], ["a"], True, True, True), (["a"], ["b"], ["a"], False, True, True), (["a", "c"], [], ["a"], False, True, True), (["a", "c"], [], ["a"], True, True, True)]
    s = "must array<string>, nice array<string>, skills array<string>, years_ok boolean, degree_ok boolean, role_ok boolean"
    assert [x.grade for x in E.graded(spark.createDataFrame(rows, s)).collect()] == [3, 2, 1, 0, 1]


def test_company_match(spark):
    r = random.Random(2)
    names = ["acme", "acme corp", "globex", "globex inc", "initech", ""]
    found = [(d, k, r.choice(names)) for d in range(30) for k in range(r.randrange(0, 5))]
    truth = [(d, k, r.choice(names)) for d in range(30) for k in range(r.randrange(0, 5))]
    want = set()
    for d in range(30):
        used = set()
        for _, t, b in (x for x in truth if x[0] == d):
            for _, f, a in (x for x in found if x[0] == d):
                if f not in used and a and b and (a in b or b in a):
                    used.add(f)
                    want.add((d, t, f))
                    break
    got = E.matched_companies(spark.createDataFrame(found, "k int, found_no int, found_name string"), spark.createDataFrame(truth, "k int, truth_no int, truth_name string"), "k")
    assert {tuple(x) for x in got.collect()} == want


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, id string, score double, rank int")
    got = sorted(X.fuse([hits([(1, "a", 0.9, 1), (1, "b", 0.8, 2)]), hits([(1, "b", 7.0, 1), (1, "c", 6.0, 2)])], "id").collect(), key=lambda x: x.rank)
    assert [x.id for x in got] == ["b", "a", "c"] and got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert got[0].ranks == {0: 2, 1: 1} and got[1].source_scores == {0: 0.9}


def test_bm25_against_a_plain_model(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for k in range(60)]
    docs = [(k, t + " common common") for k, t in docs]
    asked = [(k, " ".join(r.choice(words) for _ in range(4)) + " common w1 w1") for k in range(5)]
    own = {k: t.split() for k, t in docs}
    n, avg = len(own), sum(map(len, own.values())) / len(own)
    df = {w: sum(w in t for t in own.values()) for w in {x for t in own.values() for x in t}}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: low if v < 0 else v for w, v in raw.items()}
    got = {(x.query_id, x.id): x.score for x in X.bm25(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asked, "q int, text string"), "id", "q").collect()}
    for q, text in asked:
        for k, t in own.items():
            want = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split())
            assert got.get((q, k), 0.0) == pytest.approx(want, abs=1e-9)


def test_hash_embeddings(spark):
    d = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha BETA"), (3, "gamma delta")], "id int, text string")
    v = {x.id: x.embedding for x in X.dense_of(X.hash_embeddings(d, "id", "text"), "id").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot(1, 2) == pytest.approx(1.0) and dot(1, 1) == pytest.approx(1.0) and len(v[3]) == 128


def test_reranking(spark):
    h = spark.createDataFrame([(1, "a", 0.5, 1, -3.0), (1, "b", 0.4, 2, 2.0), (1, "c", 0.3, 3, 2.0)], "query_id int, id string, score double, rank int, logit double")
    got = sorted(X.rerank(h, F.col("logit"), "id").collect(), key=lambda x: x.rank)
    assert [x.id for x in got] == ["b", "c", "a"] and [x.above_floor for x in got] == [True, True, False] and got[0].retrieval_score == 0.4
    assert [x.id for x in X.rerank(h, F.col("logit"), "id", drop_below=True).orderBy("rank").collect()] == ["b", "c"]


def test_canonical_by_containment(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(0, 6))) for _ in range(60)] + ["", "a", "ab", "Zürich", "ürich"]
    surfaces = {w: f"c{k}" for k, w in enumerate(words[::2])}
    got = {x.name: x.canonical for x in E.canonicalised(spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame(list(surfaces.items()), "surface string, canonical string")).collect()}
    for w in words:
        held = [s for s in surfaces if w and s and (s in w or w in s)]
        assert got[w] == (surfaces[min(held, key=lambda s: (-len(s), s))] if held else w)


def test_extraction_measures(spark):
    lines = spark.createDataFrame([(1, "Kept line"), (1, "HEADING"), (2, "no chunks at all")], "doc_id int, text string")
    chunked = spark.createDataFrame([(1, 1, "- Kept line of Acme"), (1, 2, "Acme and Bolt and Acme")], "doc_id int, part int, text string")
    assert sorted(x.text for x in E.lost_lines(lines, chunked, "doc_id").collect()) == ["HEADING", "no chunks at all"]
    names = spark.createDataFrame([(1, "Acme"), (1, "Bolt"), (1, "Bolt"), (1, ""), (2, "Kept")], "doc_id int, employer string")
    assert [(x.part, x.n_employers) for x in E.mixed_chunks(chunked, names, "doc_id", "part").collect()] == [(2, 2)]
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "k int, form string")
    assert tuple(E.verbatim(truth, spark.createDataFrame([(1, "a"), (1, "a"), (3, "b")], "k int, form string"), "k", "form").first()) == (4, 2)


def test_field_accuracies(spark):
    schema = "id int, name string, email string, phone string, level string, jobs array<struct<company:string,start_year:int,end_year:int>>, n_education int"
    truth = [(1, "Ann-Lee", "a@b", None, "master", [("x", 2001, None), ("y", 2005, 2007)], 1), (2, "Bo", None, "1", "school", [], 0), (3, "Cy", None, None, None, [("z", 1999, 2000)], 2)]
    found = [(1, "ANN LEE", "a@b", "9", "doctorate", [("x", 2001, None), ("y", 2004, 2007)], 1), (2, "Bob", None, "1", "bachelor", [("w", 1, 2)], 0), (3, "cy", "c@d", None, None, [("q", 1, 2), ("Z", 1999, 2001)], 1)]
    got = E.field_accuracies(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), "id").first().asDict()
    # Bo's job has no partner, Cy's z has one behind q
    want = {"n": 3, "n_matched": 3, "name": 2 / 3, "email": 2 / 3, "phone": 2 / 3, "job_count": 1 / 3, "start_year": 2 / 3, "end_year": 2 / 3, "postgraduate": 1.0, "education_count": 2 / 3}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("automaton", [None, 0])
def test_longest_alias(spark, automaton):
    words = spark.createDataFrame([(0, "data", "Data"), (1, "data base", "DB"), (2, "base data", "BD"), (3, "sql", "SQL"), (4, "tabase", "T")], "alias_pos int, alias string, canonical string")
    texts = [("a", "big data base work"), ("b", "base data base"), ("c", "sql only"), ("d", "database"), ("e", "x"), ("f", "data")]
    got = {x.surface: x.c3 for x in P.longest_alias(spark.createDataFrame(texts, "surface string, cleaned string"), words, automaton).collect()}
    assert got == {"a": "DB", "b": "DB", "d": "T", "f": "Data"}


@pytest.mark.parametrize("strict", [False, True])
def test_alternatives_are_canonical_and_checkable(spark, strict):
    words = spark.createDataFrame([("k8s", "Kubernetes"), ("kubernetes", "Kubernetes"), ("sql", "SQL")], "alias string, canonical string")
    schema = "jd_id int, req_no int, text string, kind string, weight int, skill string, skill_alternatives array<string>, min_years int, degree_level string, search_query string"
    rows = [(1, 0, "t", "hard", 9, None, [" K8s ", "kubernetes", "Nomad"], None, None, None), (1, 1, "t", "hard", 1, None, [], None, None, None), (1, 2, "t", "hard", 1, "zig", ["sql"], None, None, None), (1, 3, "t", "hard", 1, "SQL", None, None, None, "q")]
    got = {x.req_no: (x.kind, x.weight, x.any_of, x.canonical_skill) for x in R.normalised(spark.createDataFrame(rows, schema), words, strict).collect()}
    assert got[1] == ("soft", 1, [], None) and got[2][0] == "soft" and got[3] == ("hard", 1, [], "SQL")
    assert got[0] == (("soft", 3, [" k8s ", "kubernetes", "nomad"], None) if strict else ("hard", 3, ["kubernetes", "nomad"], None))


def test_relaxation_on_grades(spark):
    bridge = [(f"c{k}", s) for k in range(10) for s in ("a", "b", "c") if (s, k) not in (("b", 0), ("c", 0), ("c", 1), ("c", 2))]
    must = spark.createDataFrame([(j, s) for j in (1, 2) for s in ("a", "b", "c", "z")], "jd_id int, skill string")
    eligible = spark.createDataFrame([(1, f"c{k}") for k in range(10)] + [(2, f"c{k}") for k in (0, 1, 2, 3)], "jd_id int, resume_id string")
    df = spark.createDataFrame(bridge, "resume_id string, skill string")
    got = {x.jd_id: (x.must, x.nice, x.n_relaxed) for x in E.relaxed(df, must, 4, eligible).collect()}
    assert got == {1: (["a", "b", "c"], ["z"], 1), 2: (["a"], ["b", "c", "z"], 3)}
    assert {x.must[-1] for x in E.relaxed(df, must, 4).collect()} == {"c"}


def test_loaded_tables(spark):
    schema = "resume_id string, job_id string, profile struct<full_name:string,email:string,skills:array<struct<name:string>>,experience:array<struct<company:string,start_year:int,start_month:int,end_year:int,end_month:int,is_current:boolean>>,education:array<struct<level:string,start_year:int,end_year:int>>>"
    rows = [("r1", "j", (" Ann", "a@x", [("Torch",), ("torch",), (" ",), ("Zig",)], [("A", 2010, 13, 2008, 1, False), ("B", 2015, 1, None, None, True), ("C", 1800, 1, 2001, 2, False)], [(" Master ", 2001, 2005), ("guild", 9999, None)])), ("r2", "j", ("ann", "A@x ", [], [], []))]
    t = P.loaded(spark.createDataFrame(rows, schema), 2025 * 12, 2025)
    assert sorted((x.position, x.company, x.start_year, x.start_month, x.end_year) for x in t["experience"].collect()) == [(0, "B", 2015, 1, None), (1, "A", 2008, None, 2010), (2, "C", None, 1, 2001)]
    assert sorted((x.skill_no, x.surface, x.canonical, x.known) for x in t["skills"].collect()) == [(0, "Torch", "PyTorch", True), (3, "Zig", "Zig", False)]
    assert sorted((x.edu_no, x.level, x.start_year) for x in t["education"].collect()) == [(0, "master", 2001), (1, "unknown", None)]
    got = {x.resume_id: (x.highest_degree, x.currently_employed, x.duplicate_of, x.total_experience_months) for x in t["candidates"].collect()}
    assert got["r2"] == ("unknown", False, "r1", 0) and got["r1"][:3] == ("master", True, None) and got["r1"][3] > 120


def test_worst_five(spark):
    rows = spark.createDataFrame([(k, float(k % 4), 0.0) for k in range(9)] + [(9, None, 0.0)], "id int, a double, b double")
    x = E.tolerance(rows, "a", "b", "id").first()
    assert (x.n, x.exact, x.close, x.worst) == (10, 3, 5, [3, 7, 2, 6, 1])


def test_quotes_and_the_floor(spark):
    f = spark.createDataFrame([("jd", 1, "a", ["x"], True, [])], "jd_id string, id int, resume_id string, skills array<string>, passed boolean, reasons array<string>")
    rubric = spark.createDataFrame([("jd", 0, "soft", 3, "X", "t0"), ("jd", 1, "soft", 1, None, "t1"), ("jd", 2, "soft", 1, None, "t2"), ("jd", 3, "soft", 1, None, "t3"), ("jd", 4, "soft", 1, "Y", "t4")], "jd_id string, req_no int, kind string, weight int, canonical_skill string, text string")
    hits = spark.createDataFrame([("jd", 0, "a", 0.1, "low"), ("jd", 1, "a", 0.6, "high"), ("jd", 2, "a", 0.1, "low"), ("jd", 4, "a", 0.9, "none")], "jd_id string, req_no int, resume_id string, hit_score double, quote string")
    got = {gate: {x.req_no: (x.score, x.source, x.quote) for x in R.scored_requirements(f, rubric, hits, gate).collect()} for gate in (False, True)}
    assert got[False] == {0: (0.95, "database", "low"), 1: (0.6, "retrieval", "high"), 2: (0.1, "retrieval", None), 3: (0.0, "missing", None), 4: (0.0, "missing", None)}
    assert got[True] == {**got[False], 0: (0.95, "database", None)}


def test_vectors_of_one_pass(spark):
    """Dense vectors built within the row are those of the exploded form; texts without a word have none."""
    rows = [(1, "a b a"), (2, "  "), (3, None), (4, "Ünïcode x y\tz"), (5, "one")]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {x.id: x.embedding for x in X.dense_vectors(d, "id").collect()}
    want = {x.id: x.embedding for x in X.dense_of(X.hash_embeddings(d, "id", "text"), "id").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_search_within_groups(spark):
    """Each group's best chunks on the whole corpus' weights, as if each were ranked alone."""
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega"]
    rows = [(k, k % 4, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for k in range(60)]
    d = spark.createDataFrame(rows, "chunk_id long, grp long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "omega"), (3, "nothing")], "query_id long, text string")
    every = {(x.query_id, x.chunk_id): round(x.score, 9) for x in X.bm25(d, asked, "chunk_id", "query_id").collect()}
    got = sorted((x.query_id, x.grp, x.rank, x.chunk_id) for x in X.bm25_search(d, asked, "chunk_id", "query_id", 3, "grp").collect())
    want = []
    for q in (1, 2, 3):
        for g in range(4):
            own = sorted((-s, c) for (p, c), s in every.items() if p == q and c % 4 == g)
            want += [(q, g, n + 1, c) for n, (s, c) in enumerate(own[:3]) if s < 0]
    assert got == want


@pytest.mark.parametrize("group_rows", [4096, 4])
def test_search_by_pairs(spark, monkeypatch, group_rows):
    """Only the pairs asked for, each as if its group were searched alone, in one part or several."""
    monkeypatch.setattr(X, "GROUP_ROWS", group_rows)
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega"]
    rows = [(k, k % 4, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(60)]
    d = spark.createDataFrame(rows, "chunk_id long, grp long, text string")
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "omega"), (3, "nothing"), (4, "")], "query_id long, text string")
    pairs = [(1, 0), (1, 2), (2, 2), (3, 1), (4, 3), (1, 0), (9, 0), (2, 77)]
    p = spark.createDataFrame(pairs, "query_id long, grp long")
    score = [{(x.query_id, x.chunk_id): x.score for x in hits.collect()} for hits in (
        X.dense_search(X.dense_vectors(d, "chunk_id"), X.dense_vectors(asked, "query_id"), 1000).withColumnRenamed("id", "chunk_id"), X.bm25(d, asked, "chunk_id", "query_id"))]
    want = []
    for q, g in {x for x in pairs if x[0] < 9}:
        for index in (0, 1):
            own = sorted((-round(s, 9), c) for (a, c), s in score[index].items() if a == q and c % 4 == g and (index == 0 or s > 0))
            want += [(q, g, c, index, n + 1, -s) for n, (s, c) in enumerate(own[:5])]
    got = X.lists_within(d, asked, p, 5, "grp").collect()
    assert sorted((x.query_id, x.grp, x.chunk_id, x.list_index, x["rank"]) for x in got) == sorted(x[:5] for x in want if x[1] < 4)
    assert sorted(x.score for x in got) == pytest.approx(sorted(x[5] for x in want if x[1] < 4))
    fused = X.hybrid_within(d, asked, p, 2, "grp", depth=5).collect()
    rrf = {}
    for q, g, c, _, n, _ in want:
        rrf[q, g, c] = rrf.get((q, g, c), 0) + 1 / (60 + n)
    assert {(x.query_id, x.grp, x.chunk_id): pytest.approx(x.rrf_score) for x in fused}.items() <= rrf.items()
    best = {}
    for (q, g, _), s in rrf.items():
        best[q, g] = max(best.get((q, g), 0), s)
    assert {(x.query_id, x.grp): x.rrf_score for x in fused if x["rank"] == 1} == pytest.approx(best)


def test_configurations_against_whole_rankings(spark):
    """Recall, nDCG and MRR of rankings over all candidates, with labels that no ranking found near its top."""
    r = random.Random(4)
    scores, labels, place = [], {}, {}
    for q in range(6):
        for c in range(90):
            if r.random() < 0.2 and q:
                labels[q, c] = r.randrange(1, 4)
        for config in ("a", "b"):
            own = []
            for c in range(90):
                s, allowed = r.choice([0.0, 0.5, r.random()]), config == "a" or r.random() < 0.5
                scores.append((config, q, c, s, allowed))
                own.append(((not allowed, -s if allowed else 0, -c if allowed else c), c))
            place[config, q] = [c for _, c in sorted(own)]
    labels[5, 0] = 1
    for k in [k for k in labels if k[0] == 5]:
        labels[k] = 1  # nothing relevant for query 5
    df = spark.createDataFrame(scores, "config string, query_id long, candidate long, score double, allowed boolean")
    df = df.select("config", "query_id", "candidate", E.ranking_place(F.col("allowed"), F.col("score"), F.col("candidate")).alias("place"))
    lab = spark.createDataFrame([(*k, g) for k, g in labels.items()], "query_id long, candidate long, grade int")
    got = {x.config: x.asDict() for x in E.compare_configs(df, lab, (10, 45)).collect()}
    for config in ("a", "b"):
        values = []
        for q in range(1, 5):
            order, own = place[config, q], {c: g for (p, c), g in labels.items() if p == q}
            rel, row = {c for c, g in own.items() if g >= 2}, {}
            row["mrr"] = 1 / (1 + min(order.index(c) for c in rel))
            for k in (10, 45):
                gain = lambda gs: sum((2**g - 1) / math.log2(n + 2) for n, g in enumerate(gs))
                row[f"recall_{k}"] = len(rel & set(order[:k])) / len(rel)
                row[f"ndcg_{k}"] = gain([own.get(c, 0) for c in order[:k]]) / gain(sorted(own.values(), reverse=True)[:k])
            values.append(row)
        assert got[config]["n_queries"] == 4
        for m in values[0]:
            assert got[config][m] == pytest.approx(sum(v[m] for v in values) / 4), (config, m)


def test_dense_search_in_a_grid(spark, monkeypatch):
    """Many groups of queries give what one gives, which is brute force."""
    r = random.Random(2)
    rows = [(k, k % 3, [r.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(6)]) for k in range(150)]
    v = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    want = []
    for q in rows[::3]:
        own = sorted((-round(sum(a * b for a, b in zip(q[2], c[2], strict=True)), 9), c[0]) for c in rows)
        want += [(q[0], c, n + 1) for n, (_, c) in enumerate(own[:4])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # four blocks of queries
    try:
        for blocks in (512, 2, 1):
            monkeypatch.setattr(X, "QUERY_BLOCKS", blocks)
            assert sorted((x.query_id, x.id, x["rank"]) for x in X.dense_search(v, v.where("id % 3 = 0"), 4).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("block_chunks", "first"), [(1, 1), (4, 1), (4, 3), (1000, 1)])
def test_block_max_is_exact(spark, block_chunks, first):
    r = random.Random(block_chunks)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 12))) + " common" * (k % 3 != 0)) for k in range(120)]
    rows += [(500 + k, rows[7][1]) for k in range(4)]  # ties over the cut
    d = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "common"), (3, "common w3 w4 w5"), (4, "unknown"), (5, rows[7][1])], "query_id long, text string")
    key = lambda hits: sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 9)) for x in hits.collect())
    assert key(X.bm25_block_max(d, asked, "chunk_id", "query_id", 5, block_chunks, first)) == key(X.bm25_search(d, asked, "chunk_id", "query_id", 5))


def test_block_bounds_hold(spark):
    asked = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.0), (2, "b", 1.0)], "query_id long, term string, weight double")
    matched = spark.createDataFrame([(0, "a", 0.5), (0, "a", 1.5), (0, "b", 9.0), (1, "b", 0.25)], "block long, term string, part double")
    assert {(x.query_id, x.block): x.upper for x in X.block_bounds(asked, matched).collect()} == {(1, 0): 3.0, (2, 0): 9.0, (2, 1): 0.25}


def test_best_of_every_candidate(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (2, "b", 0.1)], "query_id long, candidate string, score double")
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "candidate string")
    asked = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    got = {(x.query_id, x.candidate): x.score for x in X.best_per_candidate(hits, every, asked).collect()}
    assert got == {(1, "a"): 0.7, (1, "b"): 0.0, (1, "c"): 0.0, (2, "a"): 0.0, (2, "b"): 0.1, (2, "c"): 0.0}


@pytest.mark.parametrize(("group_rows", "query_rows"), [(4096, 128), (4, 128), (4096, 2)])
def test_best_chunks_of_pairs(spark, monkeypatch, group_rows, query_rows):
    """Fused and reranked where a group stands, the same as by the lists; a group's row holds numbers of queries, no texts."""
    monkeypatch.setattr(X, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(X, "QUERY_ROWS", query_rows)
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "c++", "node.js"]
    rows = [(k, k % 4, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(60)] + [(60, 5, None), (61, 6, "alone"), (62, 7, "")]
    d = spark.createDataFrame(rows, "chunk_id long, grp long, text string")
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "c++ node.js"), (3, "nothing"), (4, ""), (5, "the gamma")], "query_id long, text string")
    p = asked.select("query_id").crossJoin(d.select("grp").distinct()).where("(query_id + grp) % 3 <> 0")
    lists = X.lists_within(d, asked, p, 7, "grp")
    fused = X.hybrid_within(d, asked, p, 4, "grp", depth=7)
    tokens, terms = d.select("chunk_id", T.tokens(F.col("text")).alias("tokens")), asked.select("query_id", T.tokens(F.col("text")).alias("asked"))
    again = X.rerank(fused.join(tokens, "chunk_id").join(terms, "query_id"), X.overlap_logit(F.col("asked"), F.col("tokens")), "chunk_id", 1, "rrf_score", within="grp")
    want = {}
    for base, df, score in (("dense", lists.where("list_index = 0"), "score"), ("bm25", lists.where("list_index = 1"), "score"), ("hybrid", fused, "rrf_score"), ("rerank", again, "score")):
        want |= {(x.query_id, x.grp, base): (x.chunk_id, pytest.approx(x[score])) for x in df.where("rank = 1").collect()}
    got = X.best_within(d, asked, p, 4, "grp", depth=7)
    assert {(x.query_id, x.grp, x.base): (x.chunk_id, x.score) for x in got.collect()} == want and len(want) > 40
    own = X._Within(d, asked, p, "grp", "chunk_id", "query_id").whole()
    assert dict(own.dtypes)["queries"] == "array<bigint>"


def test_decimals_of_texts_are_half_to_even(spark):
    """As printf in C writes them: by the exact value of a double, ties to even."""
    df = spark.createDataFrame([(1, 2 / 64, 0.125, 3), (2, 1 / 32 + 1 / 1024, 0.355, None)], "id int, rrf double, s double, r int")
    why = X.fusion_text(F.col("rrf"), F.create_map(F.lit(0), F.lit(4), F.lit(1), F.col("r")), F.create_map(F.lit(0), F.col("s"), F.lit(1), F.col("s")))
    got = [x.why for x in df.select("id", why.alias("why")).orderBy("id").collect()]
    assert got == ["rrf 0.0312  [semantic #4 (0.12), keyword #3 (0.12)]", "rrf 0.0322  [semantic #4 (0.35), keyword —]"]
    row = spark.createDataFrame([("c", 3, "bachelor", ["a"])], "id string, months int, degree string, skills array<string>")
    spec = spark.createDataFrame([(1, 1, None, [], [])], "jd_id int, min_years int, min_degree string, required_skills array<string>, any_of array<array<string>>")
    assert R.hard_filtered(row, spec).first()["reasons"] == ["0.2 years, needs 1+"]


def test_row_counts_count_a_skill_once(spark, tmp_path):
    """A skill has two names in the vocabulary and is one row."""
    from veritrail.plans import rank_queries as Q

    for name, rows, schema in (("part", [(1, "Brand#1"), (2, "Brand#1"), (3, "Brand#2")], "p_partkey long, p_brand string"), ("lineitem", [(7, 1), (7, 3)], "l_orderkey long, l_partkey long"), ("customer", [(5, "n", "s")], "c_custkey long, c_name string, c_mktsegment string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(7, 5, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string").withColumn("o_orderdate", F.to_timestamp(F.lit("2020-01-01"))).write.parquet(f"{tmp_path}/orders.parquet")
    assert Q.e12_row_counts(spark, str(tmp_path)).first().asDict() == {"candidates": 1, "candidate_skills": 2, "experience": 1, "skills": 2}


def test_dense_search_broadcasts_no_queries(spark):
    """However small the blocks of queries are: they go to every bucket, and a broadcast would take them through the driver."""
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(40)], "id long, embedding array<double>")
    plan = X.dense_search(v, v.where("id < 4"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hits_of_blocks_come_pair_by_pair():
    """A task holds the hits of one pair of blocks, however many pairs an Arrow batch has."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    blocks = [(list(range(9 * k, 9 * k + 9)), [int(x) for x in r.integers(0, 3, 9)], r.integers(-3, 4, (9, 4)).astype(float)) for k in range(4)]
    asked = [1, 12, 30]
    vectors = r.integers(-3, 4, (3, 4)).astype(float)
    batch = pa.RecordBatch.from_pylist([{"q_ids": asked, "q_cells": vectors.tobytes(), "ids": i, "groups": g, "cells": v.tobytes()} for i, g, v in blocks])
    for same in (True, False):
        got = list(X._matched(iter([batch]), 2, same))
        assert len(got) == 4
        for (ids, groups, cells), rows in zip(blocks, got, strict=True):
            want = []
            for q, v in zip(asked, vectors, strict=True):
                for g in sorted(set(groups)):
                    own = sorted((-float(v @ c), i) for i, h, c in zip(ids, groups, cells, strict=True) if h == g and (same or i != q))
                    want += [(q, i, g, -s) for s, i in own[:2]]
            assert sorted(tuple(x.values()) for x in rows.to_pylist()) == sorted(want)


def test_keyword_search_ranks_where_chunks_stand(spark, monkeypatch):
    """A task hands on its n best of each query, copies and all, also with queries in blocks and matches in small slices."""
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "node.js", "c++", "the", "delta-x"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(6)))) for i in range(300)] + [(1000 + i, "alpha beta") for i in range(200)] + [(2000, None)]
    d = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(r.choice(words) for _ in range(3))) for q in range(9)] + [(9, "unknown")], "query_id long, text string")
    key = lambda df: sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 9)) for x in df.collect())
    want = key(X.top(X.bm25(d, asked, "chunk_id", "query_id"), 7, ["query_id"], "chunk_id").where("score > 0"))
    for queries, matches in ((512, 1 << 20), (2, 5)):
        monkeypatch.setattr(X, "KEYWORD_QUERIES", queries)
        monkeypatch.setattr(X, "MATCHES", matches)
        assert key(X.bm25_search(d, asked, "chunk_id", "query_id", 7)) == want and want
    plan = X.bm25_search(d, asked, "chunk_id", "query_id", 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "chunk_id#" not in plan.split("hashpartitioning(", 1)[1].split(")")[0]


def _batches(n, **columns):
    import pyarrow as pa

    return iter(pa.table(columns).to_batches(n))


def test_words_are_looked_up_once_for_many_small_batches(monkeypatch):
    """the cost of a word follows distinct words, not batches; terms and vectors stay those of each text."""
    import re

    import pyarrow as pa

    odd = [None, "", " ", "...", "+-", "c++ c# .net a.b-c a-b.c. -x- +y #z the the.the é.x", "a b\x1cc\x85d", "\x0ba\x0cb\tc\r\nd"]
    rng = random.Random(7)
    texts = odd + ["".join(rng.choice("abc. -+#\n\té \x1c9") for _ in range(rng.randint(0, 30))) for _ in range(900)]
    asked = []
    monkeypatch.setattr(X, "_words", lambda texts, table=None, own=X._words: asked.append(len(texts)) or own(texts, table))
    ids = pa.array(range(len(texts)), pa.int64())
    got = {r["id"]: r for b in X._term_lists(_batches(10, id=ids, text=pa.array(texts, pa.string()))) for r in b.to_pylist()}
    assert asked == [len(texts)]
    for k, text in enumerate(texts):
        want = []
        for run in re.findall(T.TOKEN, text or ""):
            bare = run.strip(".-")
            own = [bare] if bare and bare not in T.STOPWORDS else []
            want += own + [p for p in re.split(r"[.\-]", bare) if own and re.search(r"[.\-]", bare) and len(p) > 1 and p not in T.STOPWORDS]
        assert dict(zip(got[k]["terms"], got[k]["tfs"], strict=True)) == {t: want.count(t) for t in want} and got[k]["dl"] == len(want)
    cells = {r["id"] for b in X._hashed(_batches(10, id=ids, text=pa.array(texts, pa.string()))) for r in b.to_pylist()}
    assert cells == {k for k, text in enumerate(texts) if re.sub(r"[ \t\n\x0b\f\r]+", "", text or "")}


def test_groups_are_searched_together(monkeypatch):
    """many small groups are one search, with the hits that each has by itself."""
    import pyarrow as pa

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6)))
    rows = [{"grp": g, "chunks": [{"id": g * 100 + c, "words": (w := text()), "tokens": w} for c in rng.sample(range(50), rng.randint(1, 9))], "queries": sorted(rng.sample(range(1, 6), rng.randint(1, 4)))} for g in range(80)]
    kind = pa.schema([("grp", pa.int64()), ("chunks", pa.list_(pa.struct([("id", pa.int64()), ("words", pa.string()), ("tokens", pa.string())]))), ("queries", pa.list_(pa.int64()))])

    asked = [text() for _ in range(4)]
    terms = [[{"term": t, "weight": 1.0 + ord(t) / 7} for t in sorted(set(w.split()))] for w in asked]
    block = types.SimpleNamespace(value=[{"query_id": k + 1, "words": w, "asked": sorted(set(w.split())), "terms": terms[k]} for k, w in enumerate(asked)])

    hits = lambda some, n: {(r["query_id"], r["grp"], r["list_index"], r["id"], round(r["score"], 9)) for b in X._group_hits(iter(pa.Table.from_pylist(some, kind).to_batches()), block, 4, 3.0, n) for r in b.to_pylist()}
    searched = []
    monkeypatch.setattr(X, "_unit_rows", lambda texts, known, own=X._unit_rows: searched.append(len(texts)) or own(texts, known))
    for n in (None, 3):
        searched.clear()
        together = hits(rows, n)
        assert len(searched) == 2 and together  # the queries, and all groups
        assert together == {x for r in rows for x in hits([r], n)}


def test_ranking_moves_a_text_once(spark, monkeypatch):
    """Terms are made where a group is searched; neither they nor the texts are written, and a text is in a group's row once."""
    d = spark.createDataFrame([(k, k % 3, w) for k, w in enumerate(["alpha a.b-c", "beta beta the", "c++", "", None, "alpha beta", "net.b"])], "chunk_id long, grp long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "c++ b")], "query_id long, text string")
    p = asked.select("query_id").crossJoin(d.select("grp").distinct())
    written = {}
    monkeypatch.setattr(X, "stored", lambda df, name, own=X.stored: written.setdefault(name, own(df, name)))
    own = X._Within(d, asked, p, "grp", "chunk_id", "query_id")
    assert own.whole().schema["chunks"].dataType.elementType.names == ["id", "words"]
    assert not any("words" in df.columns for name, df in written.items() if name != "asked-terms")
    counts = {r["term"]: (r["df"], r["length"]) for r in written["document-counts"].collect()}
    plain = X.counted_terms(d, "chunk_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("length"))
    assert counts.pop(None) == (7, 0) and counts == {r["term"]: (r["df"], r["length"]) for r in plain.collect()} and counts["beta"] == (2, 3)
    assert own.avgdl == pytest.approx(sum(n for _, n in counts.values()) / 7)


def test_previews_move_no_whole_quote(spark, tmp_path, monkeypatch):
    """what is written as evidence for previews holds the first 64 characters of a quote's first line."""
    from veritrail.plans import rank_queries as Q

    chunks = spark.createDataFrame([(1, 7, "x" * 500), (2, 7, "one\ntwo"), (3, 7, "")], "chunk_id long, doc_id long, text string")
    found = spark.createDataFrame([(2000, 7, "rerank", 1, 0.9), (2001, 7, "rerank", 2, 0.8), (2002, 7, "rerank", 3, 0.7)], "query_id long, doc_id long, base string, chunk_id long, score double")
    soft = spark.createDataFrame([(2, k, "soft", "q", "t", 1, None) for k in range(3)], "jd_id int, req_no int, kind string, search_query string, text string, weight int, canonical_skill string")
    passed = spark.createDataFrame([(2, 7, "c7", True, ["a"])], "jd_id int, id long, resume_id string, passed boolean, skills array<string>")
    monkeypatch.setattr(Q, "rubric", lambda spark, d: soft)
    monkeypatch.setattr(Q, "resume_chunks", lambda spark, d: chunks)
    monkeypatch.setattr(Q.S, "best_within", lambda *args: found)
    own = Q.evidence(spark, "", passed, cut=Q.R.preview)
    assert {r["quote"] for r in own.collect()} == {"x" * 64, "one", ""}
    shown = lambda df: {(r["req_no"], r["place"], r["preview"]) for r in Q.R.previews(df).collect()}
    assert shown(own) == shown(Q.evidence(spark, "", passed)) == {(0, 1, "x" * 64), (1, 2, "one"), (2, 3, "")}
