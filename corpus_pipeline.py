"""A corpus from raw documents to token shards: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlogic.llm import decontaminate, langid, mixing, simhash, tokenshards
from gridlogic.llm.common import remove, table, work_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that two languages compress nearly alike.

    Null and empty texts go; very long ones are judged over their whole length; rows with equal texts, ids repeated or not, stay or go together; rows without lang or doc_id are
    judged like others but teach nothing; an empty table stays empty; columns of any names stay.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    A null doc_id comes last; of rows with that doc_id one stays, chosen by the hashes of text and row, so that repeated rows become one; null and empty texts are
    alike; very long texts are hashed whole; an empty table stays empty; columns of any names stay.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay, and all if the benchmark is empty; very long texts are searched whole; repeated rows stay or go together, as do rows of one doc_id only
    if their texts are equal; columns of any names stay.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight has it drawn, in shuffled order.

    A null source counts among the unnamed ones; a source whose texts are all null or empty gets no copies; repeated rows are drawn alike; an empty table stays empty; columns of any
    names stay.
    """
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER_WEIGHT)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in ascending order of doc_id, and what is read back from them for each record: doc_id, start, n_tokens, ids_crc32.

    A null doc_id comes first; null and empty texts are an end id alone; a very long text is one record; rows of one doc_id are as many records, in the order of their texts'
    hashes; an empty table gives no record; other columns are ignored.
    """
    return tokenshards.encode_and_read(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage has written goes once the next one is written; the last one's stays, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: The first stage is not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
