"""Sources, sinks and the incremental ingest, by round trips through a temporary folder."""

import json
import random
import zipfile

import pytest
from pyspark.sql.types import StructType

from veritrail.operators import retrieval as R
from veritrail.plans.registry import queries
from veritrail.runtime import discard_stored, shared_dir, stored
from veritrail.sources import store as S
from veritrail.streaming import ingest as I
from veritrail.streaming.ingest import current, ingest

QUERIES = queries()


def test_directory_scan(spark, tmp_path):
    for name in ("b.PDF", "a.docx", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [(x.name, bytes(x.content)) for x in S.scan_directory(spark, str(tmp_path), "j").collect()] == [("a.docx", b"a.docx"), ("b.PDF", b"b.PDF")]


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "chunks_1.json").write_text(json.dumps([{"id": 1, "t": "x"}, {"id": 2, "t": None}]))
    (tmp_path / "chunks_2.json").write_text("[]")
    assert {(x.id, x.t) for x in S.read_records(spark, str(tmp_path / "chunks*.json"), "id int, t string").collect()} == {(1, "x"), (2, None)}
    (tmp_path / "jd_1.txt").write_text("two\nlines")
    assert [(x.key, x.text) for x in S.read_texts(spark, str(tmp_path / "*.txt")).collect()] == [("jd_1", "two\nlines")]


def test_manifest(spark):
    rows = [("ok", 1, "a/x.pdf", 10, 5), ("ok", 2, "__MACOSX/x", 9, 1), ("up", 1, "..\\x.pdf".replace("..\\", "../"), 1, 1), ("win", 1, "C:\\x.pdf", 1, 1), ("bomb", 1, "x.pdf", 300_000_000, 1000), ("many", 0, ".DS_Store", 1, 1)] + [("many", k, f"{k}.pdf", 1, 1) for k in range(1, 1002)]
    got = {x.job_id: x.reasons for x in S.manifest_report(spark.createDataFrame(rows, "job_id string, entry_no int, entry_name string, file_size long, compress_size long")).collect()}
    assert got == {"ok": [], "up": ["unsafe path"], "win": ["unsafe path"], "bomb": ["suspicious ratio"], "many": ["too many files"]}


def test_archive_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/x.pdf", "x" * 5000)
        z.writestr("../up.pdf", "y")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    archives = spark.read.format("binaryFile").load(str(tmp_path / "*.zip")).selectExpr("element_at(split(path, '/'), -1) AS job_id", "content")
    got = sorted(map(tuple, S.archive_entries(archives).collect()))
    assert [x[:4] for x in got] == [("a.zip", 0, "d/x.pdf", 5000), ("a.zip", 1, "../up.pdf", 1), ("b.zip", None, None, None)]
    assert 0 < got[0][4] < 100 and got[2][5]
    assert {x.job_id: x.reasons for x in S.manifest_report(S.archive_entries(archives).where("error is null")).collect()} == {"a.zip": ["unsafe path"]}


def test_file_report(spark):
    rows = [("j", "a", "x" * 200), ("j", "b", "x" * 200), ("j", "c", "short"), ("j", "d", "short"), ("k", "e", "x" * 200)]
    got = {x.name: (x.status, x.duplicate_of) for x in S.file_report(spark.createDataFrame(rows, "job_id string, name string, content string")).collect()}
    assert got == {"a": ("parsed", None), "b": ("duplicate", "a"), "c": ("empty_text", None), "d": ("empty_text", None), "e": ("parsed", None)}


def test_files_that_cannot_be_read(spark):
    rows = [("j", "a", "x" * 200, None), ("j", "b", "x" * 200, "needs a Password"), ("j", "c", "x" * 200, "broken"), ("j", "d", None, "encrypted"), ("j", "e", "x" * 200, None), ("j", "f", None, None)]
    got = {x.name: (x.status, x.duplicate_of, x.detail) for x in S.file_report(spark.createDataFrame(rows, "job_id string, name string, content string, error string")).collect()}
    assert got == {"a": ("parsed", None, None), "b": ("encrypted", None, "needs a Password"), "c": ("corrupt", None, "broken"), "d": ("encrypted", None, "encrypted"), "e": ("duplicate", "a", None), "f": ("empty_text", None, None)}


def test_cache_computes_what_it_lacks(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def compute(new):
        seen.append(sorted(x.text for x in new.collect()))
        return new.selectExpr("key", "upper(text) as value")

    for texts in (["a", "b", "a"], ["b", "c"], ["a", "c"]):
        out = S.cached(spark, spark.createDataFrame([(t,) for t in texts], "text string"), path, "m", compute)
        assert sorted(x.value for x in out.collect()) == sorted({t.upper() for t in texts})
    assert seen == [["a", "b"], ["c"], []] and spark.read.parquet(path).count() == 3


def test_upsert_replaces_children(spark):
    kids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "resume_id string, n int")
    parents = spark.createDataFrame([("a",), ("c",)], "resume_id string")
    new = spark.createDataFrame([("a", 9)], "resume_id string, n int")
    assert sorted(map(tuple, S.children_replaced(kids, parents, new, "resume_id").collect())) == [("a", 9), ("b", 3)]


def test_batch_delete_leaves_no_orphans(spark):
    t = {"p": spark.createDataFrame([("a", "j"), ("b", "k"), ("c", None)], "resume_id string, job_id string"), "kids": spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "resume_id string, n int")}
    left = S.batch_deleted(t, "p", "resume_id", "j")
    assert sorted(x.resume_id for x in left["p"].collect()) == ["b", "c"] and [x.resume_id for x in left["kids"].collect()] == ["b"]


def test_migration_and_index(spark, tmp_path):
    out = S.migrated(spark.createDataFrame([(1,)], "a int"), StructType.fromDDL("a int, b string"))
    assert out.columns == ["a", "b"] and out.first()["b"] is None
    path = str(tmp_path / "index")
    S.write_index(spark.createDataFrame([("c1", "m1"), ("c2", "m2")], "chunk_id string, model string"), path)
    S.write_index(spark.createDataFrame([("c3", "m2")], "chunk_id string, model string"), path)
    assert sorted((x.chunk_id, x.model) for x in spark.read.parquet(path).collect()) == [("c1", "m1"), ("c3", "m2")]


def test_incremental_ingest(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    schema = StructType.fromDDL("doc_id long, text string")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, schema, index, checkpoint).awaitTermination()
        return sorted((x.chunk_id, x.text) for x in current(spark, index).collect())

    assert current(spark, index) is None
    # the long line doesn't fit behind the first: a part of its own, with both as the entry's heading lines
    assert [x for x, _ in add([(1, "one"), (2, "two\n" + "x" * 700)])] == ["1_1", "2_1", "2_2"]
    again = add([(2, "new"), (3, "three")])
    assert again == [("1_1", "one"), ("2_1", "new"), ("3_1", "three")]
    ingest(spark, source, schema, index, checkpoint).awaitTermination()
    assert sorted((x.chunk_id, x.text) for x in current(spark, index).collect()) == again


@pytest.mark.parametrize("when", ["before the rows", "between rows and manifest", "after the manifest"])
def test_ingest_survives_a_crash(spark, tmp_path, monkeypatch, when):
    """A run that dies leaves the index as it was or as it will be, and the next run ends at the same rows."""
    source, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    schema = StructType.fromDDL("doc_id long, text string")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    go = lambda: ingest(spark, source, schema, index, checkpoint, 4).awaitTermination()
    rows = lambda: sorted((x.chunk_id, x.text) for x in current(spark, index).collect())
    add([(k, f"text {k}") for k in range(20)])
    go()
    before = rows()
    add([(3, "new"), (4, ""), (99, "more")])

    def dies(*a):
        if when == "after the manifest":
            publish(*a)
        raise RuntimeError("killed")

    publish = I.publish
    with monkeypatch.context() as m:
        m.setattr(I, "chunk_rows" if when == "before the rows" else "publish", dies)
        with pytest.raises(Exception, match="killed"):
            go()
    after = sorted([x for x in before if x[0] not in ("3_1", "4_1")] + [("3_1", "new"), ("99_1", "more")])
    assert rows() == (after if when == "after the manifest" else before)
    go()
    assert rows() == after
    go()
    assert rows() == after
    # what the dead run left behind is in no version
    assert I.vacuum(spark, index, keep=1) == (when == "between rows and manifest") and rows() == after


def test_ingest_touches_only_the_buckets_of_a_batch(spark, tmp_path):
    index = str(tmp_path / "index")
    I.upsert(spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string"), 0, index, 8)
    first = I._read(spark, I._manifests(spark, index)[0])["folders"]["chunks"]
    I.upsert(spark.createDataFrame([(5, "a"), (5, "b")], "doc_id long, text string"), 1, index)
    second = I._read(spark, I._manifests(spark, index)[1])["folders"]["chunks"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert {x.text for x in current(spark, index).where("doc_id = 5").collect()} == {"b"} and current(spark, index).count() == 40


def test_ingest_writes_again_only_what_a_batch_replaces(spark, tmp_path, monkeypatch):
    """New documents leave pieces as they are; replaced ones take theirs along; a bucket with many pieces becomes one."""
    index = str(tmp_path / "index")
    up = lambda rows, k: I.upsert(spark.createDataFrame(rows, "doc_id long, text string"), k, index, 2)
    pieces = lambda k, t="chunks": {x for own in I._read(spark, I._manifests(spark, index)[k])["folders"][t].values() for x in own}
    up([(k, f"text {k}") for k in range(20)], 0)
    up([(k, f"text {k}") for k in range(100, 120)], 1)
    assert all(pieces(0, t) < pieces(1, t) and len(pieces(1, t)) == 4 for t in I.TABLES)
    up([(5, "a"), (5, "b"), (7, None), (100, "")], 2)
    left = {k: f"text {k}" for k in [*range(20), *range(100, 120)] if k not in (7, 100)} | {5: "b"}
    assert {x.doc_id: x.text for x in current(spark, index).collect()} == left and len(pieces(2) & pieces(0)) < 2
    monkeypatch.setattr(I, "CHANGES", 2)
    up([(k, f"text {k}") for k in range(200, 220)], 3)
    left |= {k: f"text {k}" for k in range(200, 220)}
    assert len(pieces(3)) < 6 and {x.doc_id: x.text for x in current(spark, index).collect()} == left
    df, n, length = I.statistics(spark, index)
    assert (n, length, {x.term: x.df for x in df.collect()}["text"]) == (len(left), 2 * len(left) - 1, len(left) - 1)


def test_two_streams_into_one_index(spark, tmp_path):
    """Each stream numbers its batches from 0 in a checkpoint of its own; none is taken for the other's."""
    schema, index = StructType.fromDDL("doc_id long, text string"), str(tmp_path / "index")
    for turn in range(2):
        for k in ("a", "b"):
            source, first = str(tmp_path / k), 10 * turn + (100 if k == "b" else 0)
            spark.createDataFrame([(first + i, f"{k} {turn} {i}") for i in range(3)], schema).coalesce(1).write.mode("append").parquet(source)
            ingest(spark, source, schema, index, str(tmp_path / f"checkpoint-{k}"), 4).awaitTermination()
    assert sorted(x.text for x in current(spark, index).collect()) == sorted(f"{k} {t} {i}" for k in "ab" for t in range(2) for i in range(3))


def test_a_published_number_is_not_overwritten(spark, tmp_path):
    index = str(tmp_path / "index")
    I.upsert(spark.createDataFrame([(1, "one")], "doc_id long, text string"), 0, index, 2)
    with pytest.raises(Exception, match="exist"):
        I.publish(spark, index, 0, {})
    assert [x.text for x in current(spark, index).collect()] == ["one"]


def test_vectors_postings_and_statistics_follow_changes(spark, tmp_path, monkeypatch):
    """After every batch, also when changes are added up, tables and statistics are those of an index built anew."""
    monkeypatch.setattr(I, "CHANGES", 2)
    index, have, r = str(tmp_path / "index"), {}, random.Random(3)
    words = ["alpha", "beta", "gamma", "c++", "node.js", ""]
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "node")], "item_id long, text string")
    for number in range(4):
        rows = [(r.randrange(12), "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(r.randrange(60)))) for _ in range(5)]
        for k, t in rows:
            have[k] = max(t, *(x for i, x in rows if i == k), "")
        I.upsert(spark.createDataFrame(rows, "doc_id long, text string"), number, index, 3, "s")
        new = I.chunk_rows(spark.createDataFrame(list(have.items()), "doc_id long, text string"))
        want = {t: sorted(map(str, df.select(*current(spark, index, t).columns).collect())) for t, df in I._derived(new).items()}
        assert {t: sorted(map(str, current(spark, index, t).collect())) for t in I.TABLES} == want
        df, n, length = I.statistics(spark, index)
        terms = I._derived(new)["postings"]
        assert sorted(map(tuple, df.collect())) == sorted((x.term, x["count"]) for x in terms.groupBy("term").count().collect())
        assert n == new.count() and length == (terms.agg({"tf": "sum"}).first()[0] or 0)
        hits = {(x.query_id, x.chunk_id): (x.rank, round(x.score, 9)) for x in I.keyword_search(spark, index, asked, "item_id", 3).collect()}
        assert hits == {(x.query_id, x.chunk_id): (x.rank, round(x.score, 9)) for x in R.bm25_search(new, asked, "chunk_id", "item_id", 3).collect()}


def test_pages_are_ingested_as_structured_chunks(spark):
    """k1_structured_ingest has the chunks that I19 makes of all pages at once."""
    d = "/root/testdata/sf0.001"
    got, want = QUERIES["k1_structured_ingest"](spark, d), QUERIES["i19_chunking"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_delete_report(spark):
    t = {"p": spark.createDataFrame([("a", "j"), ("b", "k"), ("c", None)], "resume_id string, job_id string"), "kids": spark.createDataFrame([("a", 1), ("b", 2), ("z", 3), (None, 4)], "resume_id string, n int")}
    assert sorted(map(tuple, S.delete_report(t, "p", "resume_id", "j").collect())) == [("kids", 1, 1, 2), ("p", 2, 1, 0)]


def test_discard_stored(spark):
    df = stored(spark.range(3), "numbers")
    assert df.count() == 3 and discard_stored(spark) >= 1 and discard_stored(spark) == 0


def test_stored_tables_are_in_the_shared_folder(spark):
    df = stored(spark.range(5), "numbers")
    assert df.count() == 5 and all(shared_dir(spark).removeprefix("file://") in f for f in df.inputFiles())
