"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns the columns of documents; the last returns ids and texts.
run() writes each stage as Parquet into the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, linededup, mixing, neardup, quality
from inkwell.llm.common import finished, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that the rules reject."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one."""
    return linededup.without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document may leave or come twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of every document."""
    return bpe.encode(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL has no bounded way to find near copies or to encode; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A null or empty text is rejected at first; repeated rows are copies of each other; an empty table gives an empty one."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        after = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if docs is not before:
            remove(docs)
        docs = after
    return docs
