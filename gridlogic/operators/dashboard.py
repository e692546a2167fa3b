"""Summaries across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlogic.functions.text import display_name
from gridlogic.operators.metrics import ratio


def run_summary(rows: DataFrame) -> DataFrame:
    """(run, task, n, correct, accuracy) of (run, task, correct)."""
    n = F.count(F.lit(1))
    return rows.groupBy("run", "task").agg(n.alias("n"), F.count_if("correct").alias("correct"), ratio(F.count_if("correct"), n).alias("accuracy"))


def dashboard(summary: DataFrame) -> DataFrame:
    """A row for each run: its shown name, sorted tasks, mean accuracy, and its metrics as JSON."""
    entry = F.struct("task", "n", "accuracy")
    grouped = summary.groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("metrics"), F.avg("accuracy").alias("mean_accuracy"))
    return grouped.select("run", display_name(F.col("run")).alias("name"), F.array_join(F.transform("metrics", lambda m: m["task"]), ",").alias("tasks"), "mean_accuracy", F.to_json("metrics").alias("metrics"))


def base_vs_tuned(summary: DataFrame, base: str, tuned: str) -> DataFrame:
    """A metric of two runs side by side; a missing one is 0."""
    of = lambda run, name: summary.where(F.col("run") == run).select("task", F.col("accuracy").alias(name))
    return of(base, "base").join(of(tuned, "tuned"), "task", "full").na.fill(0.0).withColumn("gain", F.col("tuned") - F.col("base"))


def merged_evaluations(files: DataFrame) -> DataFrame:
    """Per task the rows of all its files together (task, path, n, correct), with totals over all instead of the first file's accuracy."""
    return files.groupBy("task").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"), F.sum("correct").alias("correct"), ratio(F.sum("correct"), F.sum("n")).alias("accuracy"))
