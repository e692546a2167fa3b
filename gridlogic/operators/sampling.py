"""Order, selection, splits and quotas; random order is the order of a hash, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER, MODULUS = 2654435761, 4294967296


def shuffled(key: Column, seed: int) -> Column:
    """A number of a key and a seed, of integer arithmetic alone."""
    return F.pmod((F.pmod(key.cast("long"), F.lit(MODULUS // 2)) + seed) * F.lit(MULTIPLIER), F.lit(MODULUS))


def keep_last(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of rows with one key the last."""
    w = Window.partitionBy(key).orderBy(*(c.desc() for c in order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def first_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of rows with one key the first. Ranks are cut before the shuffle, so a frequent key stays small."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def first_per_label(rows: DataFrame, label: str, n: int, *order: Column) -> DataFrame:
    """The first row of each label, then the first n of them, one at least."""
    return first_per(rows, label, *order).orderBy(*order).limit(max(n, 1))


def select_cases(rows: DataFrame, n: int, *order: Column, without: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The first n rows, one at least, that are not in without."""
    left = rows.join(without.select(key), key, "left_anti") if without is not None else rows
    return left.orderBy(*order).limit(max(n, 1))


def split_rows(rows: DataFrame, key: str, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """Rows with split: train, val or test. Of n rows the first int(n * fraction) by hash go to train, then to val, the rest to test.

    Ranks come from counts per hash range and a rank within it, so no task holds all rows.
    """
    total = sum(fractions)
    train, val = fractions[0] / total, fractions[1] / total
    ranked = global_rank(rows.withColumn("__h", shuffled(F.col(key), seed)), "__h", key)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * F.lit(train))
    cut2 = cut + F.floor(F.col("__n") * F.lit(val))
    return ranked.join(F.broadcast(n)).withColumn("split", F.when(F.col("__rank") <= cut, "train").when(F.col("__rank") <= cut2, "val").otherwise("test")).drop("__h", "__rank", "__n")


def global_rank(rows: DataFrame, uniform: str, key: str, buckets: int = 256) -> DataFrame:
    """rows with __rank, 1 on, by (uniform, key), uniform being spread over [0, 2^32)."""
    cut = rows.withColumn("__b", F.floor(F.col(uniform) * buckets / MODULUS).cast("int"))
    before = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = before.select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a bucket
    own = F.row_number().over(Window.partitionBy("__b").orderBy(uniform, key))
    return cut.join(F.broadcast(before), "__b").withColumn("__rank", F.col("__before") + own).drop("__b", "__before")


def batches(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Rows with batch, from 0, each of size rows but the last, in an order by hash; ranked within hash ranges, so no task holds all rows."""
    ranked = global_rank(rows.withColumn("__h", shuffled(F.col(key), seed)), "__h", key)
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__h", "__rank")


def mixed_half(a: DataFrame, b: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """N // 2 rows of each by hash, in one shuffled order."""
    half = n // 2
    both = [d.orderBy(shuffled(F.col(key), seed + i + 1), key).limit(half) for i, d in enumerate((a, b))]
    return both[0].unionByName(both[1]).orderBy(shuffled(F.col(key), seed), key)


def random_view(key: Column, seed: int) -> Column:
    """One of the three styles."""
    return F.element_at(F.array(F.lit("simple"), F.lit("grid"), F.lit("panel")), (F.pmod(F.floor(shuffled(key, seed) / 7), F.lit(3)) + 1).cast("int"))


def quota_selection(candidates: DataFrame, stratum: str, quotas: dict, key: str, seed: int) -> DataFrame:
    """Of each stratum as many candidates as its quota, by hash; strata without a quota get none. A bounded table of quotas is broadcast."""
    table = candidates.sparkSession.createDataFrame([(k, int(v)) for k, v in quotas.items()], f"{stratum} {dict(candidates.dtypes)[stratum]}, __quota long")
    ranked = candidates.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key))).where(F.col("__k") <= max(quotas.values(), default=0))  # cut before the shuffle
    return ranked.join(F.broadcast(table), stratum).where("__k <= __quota").drop("__k", "__quota")


def even_selection(candidates: DataFrame, stratum: str, quotas: dict, cells: list[str], key: str, seed: int) -> DataFrame:
    """As quota_selection(), but the cells of a stratum (equal values of those columns) take turns, by hash, until the quota is full; so they are
    even, and where one runs out, the others fill its place. __k is the turn, 1 on. No cell keeps more rows than the quota before turns are taken."""
    table = candidates.sparkSession.createDataFrame([(k, int(v)) for k, v in quotas.items()], f"{stratum} {dict(candidates.dtypes)[stratum]}, __quota long")
    order = [shuffled(F.col(key), seed), F.col(key)]
    ranked = candidates.join(F.broadcast(table), stratum).withColumn("__turn", F.row_number().over(Window.partitionBy(stratum, *cells).orderBy(*order))).where((F.col("__turn") <= max(quotas.values(), default=0)) & (F.col("__turn") <= F.col("__quota")))
    return ranked.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy("__turn", *order))).where("__k <= __quota").drop("__turn", "__quota")


def numeric_order(values: Column) -> list[Column]:
    """O2: numbers by value, then other text."""
    return [F.when(values.try_cast("double").isNull(), 1).otherwise(0), values.try_cast("double"), values]


def pending(cases: DataFrame, done: DataFrame, key: str = "test_id") -> DataFrame:
    """The cases that have no result yet."""
    return cases.join(done.select(key), key, "left_anti")
