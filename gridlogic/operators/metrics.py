"""Classification metrics, factor accuracies, buckets and summaries as grouped aggregations in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlogic.functions.score import BUCKETS, ERRORS


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pairs: DataFrame, *keys: str) -> DataFrame:
    """A2: (keys, truth, predicted, n); rows whose prediction is null or empty are not counted."""
    return pairs.where("truth is not null and coalesce(predicted, '') <> ''").groupBy(*keys, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_levels(pairs: DataFrame, key: str) -> DataFrame:
    """A2: confusion by key and over all ('all') in one pass by grouping sets."""
    counted = pairs.where("truth is not null and coalesce(predicted, '') <> ''")
    grouped = counted.groupingSets([[F.col(key), F.col("truth"), F.col("predicted")], [F.col("truth"), F.col("predicted")]], key, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"), F.grouping(key).alias("__all"))
    return grouped.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(key).cast("string")).alias(key), "truth", "predicted", "n")


def class_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """A3: per label of either side (and keys): tp, fp, fn, precision, recall, f1, support, of a confusion(). One shuffle by label."""
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("said_n"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("said_n"), F.lit(0).cast("long").alias("tp"))))
    summed = counts.select(*keys, sides.alias("s")).select(*keys, "s.*").groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("true_n", "said_n", "tp")))
    precision, recall = ratio(F.col("tp"), F.col("said_n")), ratio(F.col("tp"), F.col("true_n"))
    scored = summed.select(*keys, "label", "tp", (F.col("said_n") - F.col("tp")).alias("fp"), (F.col("true_n") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), F.col("true_n").alias("support"))
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(per_class: DataFrame, *keys: str) -> DataFrame:
    """By keys, macro (classes with support), micro and weighted averages, all zero for an empty input."""
    seen = F.col("support") > 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    out = (per_class.groupBy(*keys) if keys else per_class).agg(
        *(zero(F.avg(F.when(seen, F.col(c)))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        ratio(tp, tp + fp).alias("micro_precision"),
        ratio(tp, tp + fn).alias("micro_recall"),
        zero(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double"))).alias("weighted_f1"),
    )
    return out.withColumn("micro_f1", ratio(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))


def group_accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """A1: (keys, correct, total, accuracy)."""
    correct = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return rows.groupBy(*keys).agg(correct.alias("correct"), F.count(F.lit(1)).alias("total"), ratio(correct, F.count(F.lit(1))).alias("accuracy"))


# The factors of each category, and the categories that a task is analysed by.
FACTORS = {
    "spatial": ["num_components"],
    "query": ["query_type"],
    "description": ["terminology_used", "has_unique_layout", "ambiguous_stages", "num_relations"],
    "query+description": ["is_directly_stated"],
}
TASK_CATEGORIES = {
    "A": ["spatial", "description"], "B": ["spatial"], "C": ["query+description", "query", "description"], "D": ["spatial", "query"],
    "E": ["query+description", "query", "description"], "F": ["query+description", "query", "description", "spatial"],
    "G": ["query+description", "query", "description"], "H": ["query+description", "query", "description", "spatial"],
}


def task_factors(task: str) -> list[tuple[str, str]]:
    """(category, factor) of a task; the orders of E are analysed alike."""
    return [(c, f) for c in TASK_CATEGORIES[task.upper().split("_")[0]] for f in FACTORS[c]]


def factor_value(c: str, df: DataFrame) -> Column:
    """A factor's value as text; booleans with a capital."""
    text = F.col(c).cast("string")
    return F.initcap(text) if dict(df.dtypes)[c] == "boolean" else text


def factor_accuracy(rows: DataFrame, factors: list[tuple[str, str]], mean_of: str | None = None) -> DataFrame:
    """(category, factor, value, correct, total, accuracy) for all factors by one unpivot and one group-by; rows in which a
    factor is null are left out of it. With mean_of, accuracy is that column's mean instead of the share of correct rows."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(f).alias("factor"), factor_value(f, rows).alias("value")) for c, f in factors)))
    long = rows.select("correct", *([F.col(mean_of).alias("__score")] if mean_of else []), stacked.alias("f")).select("*", "f.*").where("value is not null")
    correct = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    accuracy = F.coalesce(F.avg("__score"), F.lit(0.0)) if mean_of else ratio(correct, F.count(F.lit(1)))
    return long.groupBy("category", "factor", "value").agg(correct.alias("correct"), F.count(F.lit(1)).alias("total"), accuracy.alias("accuracy"))


def factor_rows(results: DataFrame, dataset: DataFrame) -> DataFrame:
    """Results (test_id, correct, ...) with their dataset row; those without one are dropped."""
    return results.join(dataset, results["test_id"] == dataset["id"])


def factor_members(rows: DataFrame, factors: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """A10: (category, factor, value, id, correct): who is in each group of factor_accuracy(); rows instead of a list, as a group has no bound."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(f).alias("factor"), factor_value(f, rows).alias("value")) for c, f in factors)))
    return rows.select(F.col(key).alias("id"), F.coalesce(F.col("correct"), F.lit(False)).alias("correct"), stacked.alias("f")).select("f.*", "id", "correct").where("value is not null")


def numeric_summary(rows: DataFrame, *columns: str) -> DataFrame:
    """(factor, n, least, most, mean) of numeric columns in one pass; nulls are not counted."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in columns)))
    return rows.select(stacked.alias("f")).select("f.*").where("value is not null").groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def complete(counts: DataFrame, key: str, names: tuple[str, ...], zeros: dict) -> DataFrame:
    """Every name of a fixed dimension, with zeros where it has no row."""
    dimension = counts.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    return dimension.join(counts, key, "left").na.fill(zeros)


def bucket_summary(rows: DataFrame) -> DataFrame:
    """Per accuracy bucket of (bucket, consistent, answer_ok, accuracy): counts and rates, empty buckets as zeros."""
    n = F.count(F.lit(1))
    grouped = rows.groupBy("bucket").agg(n.alias("total"), F.count_if("consistent").alias("consistent"), F.count_if("answer_ok").alias("answer_correct"), F.avg("accuracy").alias("mean_accuracy"), ratio(F.count_if("consistent"), n).alias("consistency_rate"))
    return complete(grouped, "bucket", BUCKETS, {"total": 0, "consistent": 0, "answer_correct": 0, "mean_accuracy": 0.0, "consistency_rate": 0.0})


def error_summary(rows: DataFrame) -> DataFrame:
    """Counts of the four combinations, all present."""
    return complete(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", ERRORS, {"n": 0})


def scored_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of full, half and wrong scores, their mean, and the share of full ones."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("total"), F.count_if(F.col("score") == 1).alias("full"), F.count_if(F.col("score") == 0.5).alias("half"), F.count_if(F.col("score") == 0).alias("wrong"), F.avg("score").alias("average"), ratio(F.count_if(F.col("score") == 1), n).alias("exact"))


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """(factor, value, n, percent) of columns in one pass."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), factor_value(c, rows).alias("value")) for c in columns)))
    counts = rows.select(stacked.alias("f")).select("f.*").groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("factor").agg(F.sum("n").alias("all"))
    return counts.join(totals, "factor").select("factor", "value", "n", ratio(100 * F.col("n"), F.col("all")).alias("percent"))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Direct, unique and relation counts by number of components and over all (-1), in one pass."""
    return rows.withColumn("num_components", F.coalesce("num_components", F.lit(0))).rollup("num_components").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_directly_stated").alias("direct"), F.count_if("has_unique_layout").alias("unique_layout"), F.avg("num_relations").alias("mean_relations"), F.min("num_relations").alias("min_relations"), F.max("num_relations").alias("max_relations")).na.fill(-1, ["num_components"])
