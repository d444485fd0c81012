"""From raw documents to training shards, in stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and
read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldgraph.llm import decontam, mixing, near_dedup, quality, sharding
from veldgraph.llm.common import small_batches, stash, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject.

    Repeated rows stand or fall each for itself; null and empty texts with the
    classifier's bias; rows without a doc_id are judged like others. With no
    labels all stay. An empty table stays empty.
    """
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id.

    Null, empty and blank texts are one class. Rows that share a doc_id are one
    document and stay or go together; rows without one stay.
    """
    small_batches(spark)
    return near_dedup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 13-word window of a benchmark item, and of which short items make up less than a twentieth.

    Each row is judged by its own text, whatever its doc_id; null and empty
    texts stay. An empty benchmark takes nothing away.
    """
    small_batches(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows repeat, or go.

    Rows without words (null, empty, blank) come once. A null source is a source
    of its own. Rows that share doc_id, source and text are as one in number.
    """
    small_batches(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    Rows that share a doc_id share a shard, and so do rows without one that
    share a text; a null text has 0 bytes. An empty table has no shards.
    """
    return sharding.shards(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage{i}")
    return docs
