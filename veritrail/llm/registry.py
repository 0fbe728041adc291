"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .bpe_tree import bpe_digests
from .token_blocks import token_blocks
from .decontaminate import ORACLE as DECONTAMINATION_SQL
from .decontaminate import contamination
from .hash_ring import shard_documents
from .language_crf import languages
from .line_templates import line_digests
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import prefix_trie
from .quality_compress import quality
from .secret_worklist import secret_digests
from .simhash_anchors import near_duplicates
from .token_alignment import token_alignment
from .token_counts import token_counts
from .topk_postings import ORACLE as TOPK_SQL
from .topk_postings import top_k_self

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op7_topk_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_self(table(spark, sf_dir, "embeddings"))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), openings=True)


def op12_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Query]:
    found = [op1_token_blocks, op2_token_counts, op3_simhash_anchors, op4_decontamination, op5_language_crf, op6_line_templates, op7_topk_postings, op8_bpe_tree, op9_quality, op10_secret_worklist, op11_prefix_trie, op12_hash_ring, op13_token_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION_SQL, "op7_topk_postings": TOPK_SQL, "op11_prefix_trie": TRIE_SQL}
