"""Scoring of results against a dataset: answers, grids, descriptions, and both together.

A result whose test_id the dataset lacks stays, as an error. The dataset is joined by an ordinary join: what is small enough is broadcast by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlogic.functions import layout as L
from gridlogic.functions import score as E
from gridlogic.functions import text as X
from gridlogic.operators.hold import held
from gridlogic.operators.metrics import ratio


def joined(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """Results with their dataset row, if there is one."""
    return results.join(dataset.withColumn("in_dataset", F.lit(True)), results["test_id"] == dataset["id"], "left").withColumn("in_dataset", F.coalesce("in_dataset", F.lit(False)))


def read(rows: DataFrame) -> DataFrame:
    """rows with what their description states and their grid shows, read once."""
    parsed = held(rows, __stated=X.parse_description(F.col("description")), __parsed=L.parse_art(F.col("grid")))
    return held(parsed, __model=L.compact(F.col("__parsed")))


def direction_rows(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """(test_id, query_type, truth, predicted, correct, error) of (test_id, answer) and (id, label, query_type): tasks C, D, F, H."""
    both = held(joined(results, dataset), __predicted=X.resolve_label(F.col("answer")))
    error = F.when(~F.col("in_dataset"), "not found in dataset").when(F.col("answer").isNull(), "no answer")
    truth, predicted = F.lower("label"), F.col("__predicted")
    return both.select("test_id", "query_type", truth.alias("truth"), predicted.alias("predicted"), F.coalesce(predicted == truth, F.lit(False)).alias("correct"), error.alias("error"))


def layout_rows(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """(test_id, correct, correct_count, total, accuracy, error) of (test_id, grid) and (id, description): task A."""
    both = read(joined(results, dataset))
    v = E.verify(F.col("__stated"), F.col("__model"))
    return _verdicts(both.select("test_id", "in_dataset", v.alias("v")))


def description_rows(results: DataFrame, dataset: DataFrame, strict: bool = False) -> DataFrame:
    """The same of (test_id, description) and (id, grid): task B."""
    both = read(joined(results, dataset))
    v = E.verify(F.col("__stated"), F.col("__model"), "verify_description", strict)
    return _verdicts(both.select("test_id", "in_dataset", v.alias("v")))


def _verdicts(rows: DataFrame) -> DataFrame:
    there = F.col("in_dataset")
    return rows.select("test_id", (there & F.coalesce("v.correct", F.lit(False))).alias("correct"), F.when(there, F.col("v.correct_count")).alias("correct_count"), F.when(there, F.col("v.total")).alias("total"), F.when(there, F.col("v.accuracy")).alias("accuracy"), F.when(~there, "not found in dataset").alias("error"))


def instance_summary(rows: DataFrame) -> DataFrame:
    """Share of correct rows among all, mean accuracy of the evaluated ones, and accuracy over all relations."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), ratio(F.count_if("correct"), n).alias("accuracy"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average_instance_accuracy"), ratio(F.sum("correct_count"), F.sum("total")).alias("relation_accuracy"))


def skips(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """P10: results with their dataset row and skipped, why they are not evaluated; null if they are. Nothing is read or parsed for it."""
    return joined(results, dataset).withColumn("skipped", E.skip_reason(F.col("error"), F.col("answer"), F.col("in_dataset"), F.col("grid")))


def consistency_rows(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """(test_id, skipped, consistent, ascii_ok, answer_ok, accuracy, bucket, kind) of (test_id, error, answer, grid) and
    (id, question, label, description): tasks E and G. A skipped row has nulls after its reason."""
    blank = lambda c: F.when(F.col("skipped").isNull(), c)
    wanted = skips(results, dataset).select("test_id", "skipped", *(blank(F.col(c)).alias(c) for c in ("question", "description", "grid", "answer", "label")))
    own = held(read(wanted), __asked=X.parse_query(F.col("question")))
    asked, model = F.col("__asked"), F.col("__model")
    verdict = F.struct(
        E.query_correct(model, asked, F.col("answer")).alias("consistent"),
        E.query_correct(model, asked, F.col("label")).alias("ascii_ok"),
        E.label_correct(F.col("answer"), F.col("label")).alias("answer_ok"),
        E.verify(F.col("__stated"), model)["accuracy"].alias("accuracy"),
    )
    seen = held(own.select("test_id", "skipped", "__stated", "__model", "__asked", "answer", "label"), __v=blank(verdict)).select("test_id", "skipped", "__v.*")
    return seen.select(*seen.columns, blank(E.bucket(F.col("accuracy"))).alias("bucket"), blank(E.error_kind(F.col("ascii_ok"), F.col("answer_ok"))).alias("kind"))


def consistency_summary(rows: DataFrame) -> DataFrame:
    """Rates over the evaluated rows, and how many were skipped."""
    seen = F.col("skipped").isNull()
    n = F.count_if(seen)
    share = lambda c: ratio(F.count_if(seen & F.col(c)), n)
    return rows.agg(n.alias("evaluated"), F.count_if(~seen).alias("skipped"), share("consistent").alias("consistency"), share("answer_ok").alias("answer_accuracy"), share("ascii_ok").alias("ascii_accuracy"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("mean_accuracy"))


#: A task's letter and its scorer; E and G are scored alike, as are C, D, F and H.
SCORERS = {"A": layout_rows, "B": description_rows, "C": direction_rows, "D": direction_rows, "E": consistency_rows, "F": direction_rows, "G": consistency_rows, "H": direction_rows}


def scorer(task: str):
    if task.upper() not in SCORERS:
        raise ValueError(f"unknown task: {task}")
    return SCORERS[task.upper()]
