"""Scans, ingest reports, upserts, deletes and caches.

There is no table format with MERGE here: an upsert is a left-anti join and a union, written to a fresh place; batches
are the partition column, so a delete rewrites only its own partition.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.dedupe import likely_duplicates
from ..runtime import file_system

# Limits of an upload.
MAX_ENTRIES, MAX_TOTAL, MAX_FILE, MAX_RATIO, RATIO_FROM, MIN_CHARS = 1000, 500 * 1024 * 1024, 25 * 1024 * 1024, 200, 1_000_000, 200
# Names that archives carry along.
JUNK = (".DS_Store", "Thumbs.db", "desktop.ini")
SUFFIXES = (".pdf", ".docx")
# What a vector keeps of its chunk.
VECTOR_FIELDS = ("resume_id", "source_file", "source_type", "candidate_name", "section", "chunk_index", "job_id")



def scan_directory(spark: SparkSession, path: str, job_id: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A1: files with a known suffix, whatever its case, in order of name. Columns of a partitioned folder come along."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    more = [c for c in files.columns if c not in ("path", "length", "modificationTime", "content")]
    own = files.where(wanted).select(F.lit(job_id).alias("job_id"), name.alias("name"), "length", "modificationTime", "content", *more)
    return own.orderBy("name")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False) -> DataFrame:
    """A5: JSON arrays of records, or with ``lines`` one record a line, as Spark writes them; several files by a glob."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: key (the file's stem) and text. Where the folder is partitioned by ``key``, that is the key."""
    own = spark.read.text(path, wholetext=True).withColumn("_f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if "key" in own.columns:
        return own.select("key", F.col("value").alias("text"))
    return own.select(F.regexp_replace("_f", r"\.[^.]*$", "").alias("key"), F.col("value").alias("text"))


def is_junk(name: Column) -> Column:
    """A3."""
    base = F.element_at(F.split(name, "/"), -1)
    return name.endswith("/") | name.startswith("__MACOSX/") | base.isin(*JUNK) | base.startswith(".")


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for job_id, content in zip(batch.column("job_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    out += [(job_id, k, x.filename, x.file_size, x.compress_size, None) for k, x in enumerate(z.infolist())]
            except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as e:
                out.append((job_id, None, None, None, None, str(e)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["job_id", "entry_no", "entry_name", "file_size", "compress_size", "error"])


def archive_entries(archives: DataFrame) -> DataFrame:
    """A2: the entries of archives (job_id, content), as ``binaryFile`` reads them, from their directories alone: nothing is
    unpacked. An archive that can't be read gives one row with its error."""
    return archives.select(F.col("job_id").cast("string").alias("job_id"), "content").mapInArrow(_directories, "job_id string, entry_no int, entry_name string, file_size long, compress_size long, error string")


def manifest_report(manifest: DataFrame) -> DataFrame:
    """A2: per batch the reasons to reject it, over its entries without junk; empty if it is accepted."""
    name = F.regexp_replace("entry_name", r"\\", "/")
    unsafe = name.startswith("/") | name.startswith("../") | name.contains("/../") | (F.substring(name, 2, 1) == ":")
    bomb = (F.col("compress_size") > 0) & (F.col("file_size") > RATIO_FROM) & (F.col("file_size") > MAX_RATIO * F.col("compress_size"))
    own = manifest.where(~is_junk(F.col("entry_name"))).groupBy("job_id").agg(F.count("*").alias("n"), F.sum("file_size").alias("total"), F.coalesce(F.bool_or(unsafe), F.lit(False)).alias("unsafe"), F.coalesce(F.bool_or(bomb), F.lit(False)).alias("bomb"))
    said = [(F.col("n") > MAX_ENTRIES, "too many files"), (F.col("total") > MAX_TOTAL, "too large"), (F.col("unsafe"), "unsafe path"), (F.col("bomb"), "suspicious ratio")]
    return own.select("job_id", "n", "total", F.array_compact(F.array(*[F.when(t, r) for t, r in said])).alias("reasons"))


def flattened(manifest: DataFrame) -> DataFrame:
    """A4: base names, a later one of the same name with its folder in front; status of what can't be taken."""
    parts = F.split("entry_name", "/")
    base = F.element_at(parts, -1)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("dup")
    own = manifest.where(~is_junk(F.col("entry_name"))).withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "_base").orderBy("entry_no")))
    named = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(folder, F.lit("_"), F.col("_base")))
    known = F.lower("_base").rlike(r"\.(pdf|docx)$")
    status = F.when(~known, "unsupported_format").when(F.col("file_size") > MAX_FILE, "too_large").otherwise("pending")
    return own.select("job_id", "entry_no", named.alias("name"), status.alias("status"))


def file_report(files: DataFrame) -> DataFrame:
    """A status per file (job_id, name, content): parsed, empty_text under 200 characters, or duplicate
    of the first parsed file of the batch with the same content. Copies of empty files are no duplicates.

    Files with an ``error`` (of their parser, if the column is there) are encrypted or corrupt by its words; it is the
    detail, and they have no content to compare.
    """
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    own = files.withColumns({"_error": error, "content": F.when(error.isNull(), F.col("content"))})
    own = own.withColumns({"content_hash": X.content_hash(F.col("content")), "n_chars": F.length("content")}).withColumn("_long", F.coalesce(F.col("n_chars") >= MIN_CHARS, F.lit(False)))
    same = Window.partitionBy("job_id", "content_hash", "_long").orderBy("name")
    first = F.first("name").over(same)
    status = F.when(F.col("_error").isNotNull(), X.error_status(F.col("_error"))).when(~F.col("_long"), "empty_text").when(first == F.col("name"), "parsed").otherwise("duplicate")
    return own.withColumn("status", status).select("job_id", "name", "status", "n_chars", "content_hash", F.when(F.col("status") == "duplicate", first).alias("duplicate_of"), F.substring("_error", 1, 200).alias("detail"))


def status_summary(report: DataFrame) -> DataFrame:
    """Files per batch and status, in reading order: problems first, then duplicates, parsed last."""
    tone = F.when(F.col("status") == "parsed", 2).when(F.col("status") == "duplicate", 1).otherwise(0)
    return report.groupBy("job_id", "status").agg(F.count("*").alias("n")).withColumn("tone", tone)


def upserted(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Rows of incoming replace those with the same keys."""
    return existing.join(incoming, list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def children_replaced(existing: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """All children of an updated parent go, the new ones come, even if there are none."""
    return existing.join(parents.select(key).distinct(), key, "left_anti").unionByName(children, allowMissingColumns=True)


def dimension(rows: DataFrame, name: str, *first: str) -> DataFrame:
    """One row per name; other columns as the first creator (by seq) had them."""
    return rows.groupBy(name).agg(*[F.min_by(c, "seq").alias(c) for c in first])


def latest_vectors(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of vectors with one key the last written."""
    order = Window.partitionBy(key).orderBy(F.desc("load_seq"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """A10: the fields a vector keeps, as strings; absent ones stay away."""
    own = [F.col(c).cast("string").alias(c) for c in VECTOR_FIELDS if c in chunks.columns]
    return chunks.select("chunk_id", *own)


def write_index(vectors: DataFrame, path: str, model: str = "model") -> None:
    """The index, a folder per model; writing it replaces the models it holds."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(model).parquet(path)


def inspect_index(vectors: DataFrame, key: str = "chunk_id", first: int = 5) -> DataFrame:
    """How many vectors of how many resumes there are, and the keys of the ``first`` ones."""
    total = vectors.agg(F.count("*").alias("n"), F.count_distinct("resume_id").alias("n_resumes"))
    some = vectors.select(key).orderBy(key).limit(first).agg(F.array_sort(F.collect_list(key)).alias("first"))
    return total.crossJoin(F.broadcast(some))  # one row each


def uncovered(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates without a vector."""
    return candidates.join(vectors.select("resume_id").distinct(), "resume_id", "left_anti")


def cached(spark: SparkSession, texts: DataFrame, path: str, model: str, compute: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """(key, ..) of all distinct texts. What the cache at ``path`` lacks is computed, by ``compute`` from (key, text), and
    appended to it first, so the next call finds it."""
    fs, of = file_system(spark, path)
    known = spark.read.parquet(path) if fs.exists(of) else None
    wanted = texts.select(text).distinct().withColumn("key", X.cache_key(model, F.col(text), 24))
    new = wanted if known is None else wanted.join(known.select("key"), "key", "left_anti")
    compute(new.select("key", F.col(text).alias("text"))).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select("key"), "key", "left_semi")


def to_compute(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts whose key (model and text) is not in the cache."""
    return texts.select(text).distinct().withColumn("key", X.cache_key(model, F.col(text), 24)).join(cache.select("key"), "key", "left_anti")


def batch_deleted(tables: dict[str, DataFrame], parent: str, key: str, job_id: str) -> dict[str, DataFrame]:
    """The tables without a batch: parents by job_id, then children, vectors and files whose parent is gone, orphans included."""
    parents = tables[parent].where(~F.col("job_id").eqNullSafe(job_id))
    return {name: parents if name == parent else df.join(parents.select(key), key, "left_semi") for name, df in tables.items()}


def delete_report(tables: dict[str, DataFrame], parent: str, key: str, job_id: str) -> DataFrame:
    """Per table the rows that stay, those that went with the batch, and the orphans that were swept with them."""
    known = tables[parent].select(key, F.col("job_id").eqNullSafe(job_id).alias("goes"))
    out = None
    for name, df in tables.items():
        own = (known if name == parent else df.select(key).join(known, key, "left")).agg(F.count_if(~F.col("goes")).alias("kept"), F.count_if("goes").alias("deleted"), F.count_if(F.col("goes").isNull()).alias("orphans"))
        own = own.select(F.lit(name).alias("name"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def backfilled(people: DataFrame) -> DataFrame:
    """A table that comes without duplicate_of gets it: the column first, then D5 over all rows."""
    whole = migrated(people, T.StructType([T.StructField("duplicate_of", T.StringType())]))
    return likely_duplicates(whole)


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that the schema has and df lacks come as nulls."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns])
