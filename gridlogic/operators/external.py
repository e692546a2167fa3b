"""Joins that prepare external question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.sources.files import globless, parsed_lines


def answers_by_query(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, reference_answers) of judgements above zero (query_id, doc_id, score) and (doc_id, text)."""
    found = qrels.where("score > 0").join(corpus.select("doc_id", "text"), "doc_id")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list("text")).alias("reference_answers"))


def questions_with_answers(questions: DataFrame, queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (ord, story, question) and queries (ord, query_id, text) side by side by their place; texts must agree; only questions that have answers."""
    both = questions.join(queries, "ord").withColumn("question", F.when(F.col("question") == F.col("text"), F.col("question")).otherwise(F.raise_error(F.lit("questions and queries do not agree"))))
    return both.join(answers, "query_id").select("ord", "query_id", "story", "question", "reference_answers")


def stepgame_rows(rows: DataFrame) -> DataFrame:
    """Place as id, targets as target."""
    return rows.select(F.concat(F.lit("step-"), F.col("ord").cast("string")).alias("id"), "question", F.col("targets").alias("target"), "context")


def line_places(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(ord, and the schema's fields) of JSON lines below a folder, ord being a line's folder below root and its number there, so that files of two folders that were
    written alike can be put side by side. A folder is one file."""
    rows = parsed_lines(spark, f"{globless(root.rstrip('/'))}/*/*", schema)
    folder = F.regexp_extract("file", r"([^/]*)/[^/]*$", 1)
    return rows.where(~F.col("blank")).select(F.concat(folder, F.lit("/"), F.col("ord").cast("string")).alias("ord"), "row.*").drop("__bad")
