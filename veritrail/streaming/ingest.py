"""K1: incremental ingest. New files become chunks, vectors and postings, batch by batch, exactly once in effect.

The index holds three tables, chunks (I19 or flat), vectors (A9) and postings (E7), each cut into buckets by document, and
the corpus' statistics: how many chunks have a term, as one small table of changes a batch, and two totals. A micro-batch writes
a piece for each bucket that its documents fall into, into a folder of its own; of older pieces it reads the ids in those buckets, and
writes again only pieces that hold a document it replaces, and those of a bucket that has come to have many. Then it publishes a
manifest: a small file that says for each table and bucket where its pieces are, which changes of statistics count, and which batch of
which stream was the last; it is put in place by one rename. Readers follow the newest manifest, so they see whole
versions only, and whatever a run that died left behind is not in any. Any number of streams, each with a checkpoint of
its own, may feed an index: a batch that a stream runs again after its manifest was published has nothing left to do.
Two that publish at once get in each other's way: the later one fails and runs again.

BM25 reads postings and statistics as they are: nothing is rebuilt when documents come, change or go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import retrieval as R
from ..operators.segment import chunks, flat_chunks
from ..runtime import file_system, remove

#: Buckets of a new index; an index keeps the number it began with.
BUCKETS = 64
#: Tables of changes in statistics after which they are added up into one, no larger than the vocabulary, and pieces of a bucket
#: after which they become one.
CHANGES = 16
#: Tasks that share a bucket's documents, at most.
SPREAD = 4
TABLES = {
    "chunks": "chunk_id string, doc_id long, section string, part_index int, text string, embedding_text string, candidate_name string",
    "vectors": "chunk_id string, doc_id long, embedding array<double>",
    "postings": "chunk_id string, doc_id long, terms array<string>, tfs array<long>, dl long",
}
TERMS = "term string, df long, length long"
#: From documents (doc_id, text) to rows of the table of chunks.
Chunker = Callable[[DataFrame], DataFrame]


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Documents without structure: lines packed into parts."""
    chunk_id = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("part_index").cast("string"))
    return flat_chunks(docs).select(chunk_id.alias("chunk_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lit("TEXT").alias("section"), F.col("part_index").cast("int").alias("part_index"), "text", F.col("text").alias("embedding_text"), F.lit("").alias("candidate_name"))


def structured_rows(lines_of: Callable[[DataFrame], DataFrame]) -> Chunker:
    """I19 over the formatted lines that ``lines_of`` makes of documents."""
    return lambda docs: chunks(lines_of(docs)).select("chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "section", "part_index", "text", "embedding_text", "candidate_name")


def _manifests(spark: SparkSession, index: str) -> dict[int, str]:
    """Published manifests by number. A folder that isn't there was never written; any other failure is one."""
    fs, path = file_system(spark, f"{index}/manifest")
    if not fs.exists(path):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return {int(n.removesuffix(".json")): f"{index}/manifest/{n}" for n in names if n.endswith(".json")}


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def publish(spark: SparkSession, index: str, number: int, manifest: dict) -> None:
    """Write a manifest under a name that nobody reads, then rename it; a number that is taken is an error."""
    fs, temporary = file_system(spark, f"{index}/manifest/.{number}-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs
    own = hadoop.FileContext.getFileContext(temporary.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    # without the option to overwrite
    own.rename(temporary, jvm.org.apache.hadoop.fs.Path(f"{index}/manifest/{number}.json"), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))


def _bucket(n: int) -> F.Column:
    return F.expr(f"cast(pmod(xxhash64(cast(doc_id as long)), {n}) as int)")


def _rows(spark: SparkSession, index: str, name: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(*[f"{index}/{x}" for x in folders]) if folders else spark.createDataFrame([], TABLES[name])


def _pieces(manifest: dict, name: str) -> list[str]:
    return sorted(x for own in manifest["folders"][name].values() for x in own)


def _changes(spark: SparkSession, index: str, folders: list[str]) -> DataFrame:
    own = spark.read.schema(TERMS).parquet(*[f"{index}/{x}" for x in folders]) if folders else spark.createDataFrame([], TERMS)
    return own.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")


def _stored_form(new: DataFrame) -> dict[str, DataFrame]:
    """Vectors and postings of chunks, a row a chunk, each counted where the chunk stands."""
    of = F.struct("chunk_id", "doc_id").alias("id")
    vectors = R.dense_vectors(new.select(of, "embedding_text"), "id", "embedding_text").select("id.chunk_id", "id.doc_id", "embedding")
    return {"vectors": vectors, "postings": R.term_lists(new.select(of, "text"), "id").where("dl > 0").select("id.chunk_id", "id.doc_id", "terms", "tfs", "dl")}


def _derived(new: DataFrame) -> dict[str, DataFrame]:
    """The tables of chunks as ``current`` gives them."""
    own = _stored_form(new)
    return {"chunks": new, "vectors": own["vectors"], "postings": R.unfolded(own["postings"])}


def _one_each(batch: DataFrame) -> DataFrame:
    """One row (doc_id, text) a document, the text that sorts last; only texts of repeated ids are compared."""
    repeated = batch.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    several = batch.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return batch.select("doc_id", "text").join(repeated, same, "left_anti").unionByName(several)


def _write(rows: DataFrame, path: str, n: int) -> set[str]:
    """Rows (doc_id, ..) as one folder a bucket, and which buckets there are."""
    spark, key = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))  # a task keeps a file open for each of its buckets, so rows aren't sorted by bucket first
    try:
        rows.withColumn("bucket", _bucket(n)).write.partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set(key, was)
    fs, of = file_system(spark, path)
    return {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(of) if f.isDirectory()}


def upsert(batch: DataFrame, number: int, index: str, buckets: int = BUCKETS, source: str = "", chunker: Chunker | None = None) -> None:
    """Replace the documents of ``batch`` (doc_id, text) in the index: all their chunks go, the new ones come.

    Of rows with one doc_id in a batch, the one whose text sorts last counts. ``source`` names the stream that numbers its
    batches; running one again changes nothing.
    """
    spark = batch.sparkSession
    known = _manifests(spark, index)
    last = _read(spark, known[max(known)]) if known else {"buckets": buckets, "folders": {t: {} for t in TABLES}, "terms": [], "n": 0, "length": 0, "sources": {}}
    if last["sources"].get(source, -1) >= number:
        return
    n = last["buckets"]
    docs = _one_each(batch)
    ids = batch.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    touched = [str(r["bucket"]) for r in ids.select(_bucket(n).alias("bucket")).distinct().collect()]  # at most n rows
    if not touched:
        return
    home, folders = f"data/{uuid.uuid4().hex}", {t: {b: list(x) for b, x in last["folders"][t].items()} for t in TABLES}
    # pieces that go: (home, bucket) of those that hold a document of the batch, and all of a bucket with many
    held = [x for b in touched for x in folders["chunks"].get(b, [])]
    found = _rows(spark, index, "chunks", held).select("doc_id", F.regexp_extract(F.input_file_name(), r"(data/[^/]+)/chunks/", 1).alias("home")).join(ids, "doc_id", "left_semi") if held else None
    gone = {(r["home"], str(r["bucket"])) for r in found.select("home", _bucket(n).alias("bucket")).distinct().collect()} if held else set()
    gone |= {(x.split("/chunks/")[0], b) for b in touched for x in folders["chunks"].get(b, []) if len(folders["chunks"][b]) >= CHANGES}
    went: dict[str, list[str]] = {}
    for name in TABLES:
        for b in touched:
            out = [x for x in folders[name].get(b, []) if (x.split(f"/{name}/")[0], b) in gone]
            went[name] = went.get(name, []) + out
            folders[name][b] = [x for x in folders[name].get(b, []) if x not in out]
    # texts move once, to the tasks that share their bucket; what is derived from them is written where it is made
    dealt = docs.repartition(_bucket(n), F.expr(f"pmod(hash(doc_id), {SPREAD})"))
    new = (chunker or chunk_rows)(dealt)
    if went["chunks"]:
        new = new.unionByName(_rows(spark, index, "chunks", sorted(went["chunks"])).join(ids, "doc_id", "left_anti"))
    written = {"chunks": _write(new, f"{index}/{home}/chunks", n)}
    own = {"chunks": _rows(spark, index, "chunks", [f"{home}/chunks/bucket={b}" for b in sorted(written["chunks"])])}
    for name, rows in _stored_form(own["chunks"]).items():
        written[name] = _write(rows, f"{index}/{home}/{name}", n)
    for name, buckets_of in written.items():
        for b in buckets_of:
            folders[name].setdefault(b, []).append(f"{home}/{name}/bucket={b}")
    # statistics change by what was written less what went; documents that stay are in both
    of = lambda name, folder, sign: _rows(spark, index, name, sorted(folder)).withColumn("sign", F.lit(sign))
    both = of("postings", [f"{home}/postings/bucket={b}" for b in written["postings"]], 1).unionByName(of("postings", went["postings"], -1))
    each = both.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x"), "sign").groupBy(F.col("x.terms").alias("term"))
    each.agg(F.sum("sign").cast("long").alias("df"), F.sum(F.col("x.tfs") * F.col("sign")).alias("length")).where("df <> 0 or length <> 0").write.parquet(f"{index}/{home}/terms")
    terms = [*last["terms"], f"{home}/terms"]
    if len(terms) > CHANGES:
        _changes(spark, index, terms).write.parquet(f"{index}/{home}/all-terms")
        terms = [f"{home}/all-terms"]
    length = spark.read.schema(TERMS).parquet(f"{index}/{home}/terms").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    count = own["chunks"].count() - _rows(spark, index, "chunks", sorted(went["chunks"])).count()
    folders = {t: {b: x for b, x in own.items() if x} for t, own in folders.items()}
    publish(spark, index, max(known, default=-1) + 1, {"buckets": n, "folders": folders, "terms": terms, "n": last["n"] + count, "length": last["length"] + length, "sources": last["sources"] | {source: number}})


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def ingest(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, buckets: int = BUCKETS, chunker: Chunker | None = None, text_col: str = "text", id_col: str | Column = "doc_id") -> StreamingQuery:
    """Read all files that are new under ``source``, chunk them and upsert chunks, vectors and postings into ``index``.

    ``id_col`` may be an expression, so that the ids of several sources stay apart.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def run(batch: DataFrame, number: int) -> None:
        docs = batch.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        upsert(docs, number, index, buckets, _stream_id(spark, checkpoint), chunker)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, index: str) -> dict | None:
    known = _manifests(spark, index)
    return _read(spark, known[max(known)]) if known else None


def current(spark: SparkSession, index: str, name: str = "chunks") -> DataFrame | None:
    """A table of the newest whole version of the index, None before the first."""
    newest = _newest(spark, index)
    if newest is None:
        return None
    own = _rows(spark, index, name, _pieces(newest, name))
    return R.unfolded(own) if name == "postings" else own


def statistics(spark: SparkSession, index: str) -> tuple[DataFrame, int, int] | None:
    """(term, df), the number of chunks and their length in terms, of the newest version."""
    newest = _newest(spark, index)
    return (_changes(spark, index, newest["terms"]), newest["n"], newest["length"]) if newest else None


def keyword_search(spark: SparkSession, index: str, queries: DataFrame, query_col: str, n: int) -> DataFrame:
    """I3 over the index: (query_id, chunk_id, score, rank) from the postings and statistics of one version."""
    newest = _newest(spark, index)
    if newest is None or not newest["n"]:
        return spark.createDataFrame([], "query_id long, chunk_id string, score double, rank int")
    postings, df = _rows(spark, index, "postings", _pieces(newest, "postings")), _changes(spark, index, newest["terms"])
    asked = R.query_terms(queries, query_col).join(R.weights(df.withColumn("n", F.lit(newest["n"]))).select("term", "idf"), "term")
    return R.keyword_best(asked, postings, newest["length"] / newest["n"] or 1.0, "chunk_id", n)


def vacuum(spark: SparkSession, index: str, keep: int = 2) -> int:
    """Remove data and manifests that none of the newest ``keep`` versions names, and say how many folders went.

    Only between runs: a batch that is being written isn't named yet.
    """
    known = _manifests(spark, index)
    named: set[str] = set()
    for k in sorted(known)[-keep:]:
        own = _read(spark, known[k])
        named |= {x for t in TABLES for x in _pieces(own, t)} | set(own["terms"])
    used = {"/".join(x.split("/")[:2]) for x in named}
    fs, path = file_system(spark, f"{index}/data")
    gone = [f"data/{f.getPath().getName()}" for f in (fs.listStatus(path) if fs.exists(path) else []) if f"data/{f.getPath().getName()}" not in used]
    for x in [*gone, *[f"manifest/{k}.json" for k in sorted(known)[:-keep]]]:
        remove(spark, f"{index}/{x}")
    return len(gone)
