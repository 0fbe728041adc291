"""A training corpus in five stages, each written as Parquet and read again as the next one's input.

1. language ID: documents without a letter go, which have no language; a label is kept from none of the others, so that a
   corpus of which nothing teaches a language stays whole
2. line dedup: lines of recurring templates are taken out of the texts; documents stay, even if empty
3. SimHash near-dedup: of each group of linked documents the one with the smallest id stays
4. benchmark decontamination: documents that hold a benchmark window go
5. byte-level BPE: what is left, as token counts and digests of ids and of the decoded bytes

Rows with a null doc_id stay in stages 1, 2 and 4 by the operators' rules; in stage 3 they stay if their group has no
other id. Among rows with one doc_id and one text, one stays in stage 3. All stages but the last carry every column of
documents, whatever its name; empty tables give empty tables. Repeated lines go in stage 2, so that documents that hold
nothing else become empty there: empty texts are one group of stage 3, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.batches import boxed
from veritrail.llm.bpe_tree import bpe_digests
from veritrail.llm.decontaminate import contamination
from veritrail.llm.language_crf import UNKNOWN, languages
from veritrail.llm.line_templates import drop_lines
from veritrail.llm.simhash_anchors import near_duplicates
from veritrail.runtime import stored, table


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = languages(boxed(docs, "lang"), carry=("row",))
    return found.where((F.col("lang_pred") != UNKNOWN) | F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = drop_lines(boxed(docs))
    return left.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key")).distinct()
    keyed = boxed(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "text", "row")
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key", "text"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(boxed(docs), table(spark, sf_dir, "benchmark"), carry=("row",)).where(~F.col("contaminated")).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Language ID, line templates, SimHash and BPE are not expressible in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
