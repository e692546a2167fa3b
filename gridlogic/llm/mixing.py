"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its weight's share of the target mass, divided by the mass that it has. A document's number of copies
is drawn from the Poisson distribution of that mean by inversion: a uniform number is read off a hash of seed, doc_id and text, and the copies are the number
of cumulative probabilities below it. A mean over PART is drawn as the sum of equal parts of at most PART, each by its own hash, which has the same
distribution; so no table of probabilities and no row's expansion is longer than a few hundred. Copies are then put in the order of another hash, which is a global
shuffle. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, quoted, shuffle_partitions, table, unused

#: Production weights of the query and the pipeline: three named sources; all others share the rest as one.
WEIGHTS, OTHER_WEIGHT = {"src0": 0.25, "src1": 0.1, "src2": 0.1}, 0.55
SEED = 42
#: Mean of one draw at most; copies of part p are numbered from p * STRIDE.
PART, STRIDE = 100.0, 1 << 20
#: Named weights at most, which bounds what is broadcast.
MOST_WEIGHTS = 10_000


def uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float], other_weight: float, epochs: float = 1.0) -> DataFrame:
    """(__class, rate, parts, cdf), a row for each named source that has text and one ('') for all others together: len(weights) + 1 rows at most.

    Mass is counted in characters over all documents. Weights are taken relative to their sum over the classes that have mass; the target mass
    is epochs times the whole mass.
    """
    mass = docs.groupBy(source_class(weights).alias("__class")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("mass")).where("mass > 0")
    spark = docs.sparkSession
    given = spark.createDataFrame([*({"c": f"={k}", "w": float(w)} for k, w in weights.items()), {"c": "", "w": float(other_weight)}], "c string, w double")
    both = mass.join(F.broadcast(given), F.col("__class") == F.col("c"))
    total = both.agg(F.sum("mass").alias("all_mass"), F.sum("w").alias("all_w"))
    rated = both.join(F.broadcast(total)).select("__class", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_mass") * F.lit(float(epochs)) / F.col("mass")).otherwise(0.0).alias("rate"))
    parted = rated.withColumn("parts", F.ceil(F.col("rate") / F.lit(PART)))
    return parted.withColumn("cdf", F.when(F.col("rate") > 0, poisson_cdf(F.col("rate") / F.col("parts"))).otherwise(F.array(F.lit(1.0))))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) of a rate up to PART, for k from 0 to where nothing is left in doubles."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def add(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add)["cdf"]


def source_class(weights: dict[str, float]) -> Column:
    """'=' and the name of a source that has a weight of its own; '' for any other, null included."""
    return F.when(F.col("source").isin(*weights), F.concat(F.lit("="), F.col("source"))).otherwise("") if weights else F.lit("")


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float, seed: int = SEED, epochs: float = 1.0, trace: bool = False) -> DataFrame:
    """Each document as often as drawn, in shuffled order; with trace, also copy (from 0) and mix_key (the order), which docs must not have (ValueError).

    Null and unnamed sources are one class with other_weight. A class without any character gets no copies. Rows with equal doc_id and
    text draw alike; an empty table gives no rows. Columns stay, whatever their names. The class table (len(weights) + 1 rows, at most MOST_WEIGHTS + 1) is
    broadcast, so a hot source meets its rate without a shuffle; rows are dealt by uniform hash keys. Where a rate is over PART, a document's parts are dealt
    over tasks before they become copies, so that a document of a great many copies is not one task's.
    """
    if len(weights) > MOST_WEIGHTS or min([*weights.values(), other_weight]) < 0:
        raise ValueError(f"at most {MOST_WEIGHTS} weights, none negative")
    if trace and {"copy", "mix_key"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column copy or mix_key")
    n = max(1, shuffle_partitions(docs.sparkSession))
    kind, own, u, part, copy, key, c, cdf, parts = (unused(docs, x) for x in ("class", "own", "u", "part", "copy", "key", "c", "cdf", "parts"))
    names = [F.col(quoted(x)) for x in docs.columns]
    identity = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")))
    table_of_rates = checkpointed(rates(docs, weights, other_weight, epochs).select(F.col("__class").alias(c), F.col("cdf").alias(cdf), F.col("parts").alias(parts)))
    classed = docs.select(*names, source_class(weights).alias(kind), identity.alias(own))
    joined = classed.join(F.broadcast(table_of_rates), F.col(kind) == F.col(c)).where(F.col(parts) > 0)
    parted = joined.select(*names, own, cdf, F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)).alias(part))
    if (table_of_rates.agg(F.max(parts)).first()[0] or 0) > 1:
        parted = parted.repartition(n, F.xxhash64(own, part))
    drawn = parted.withColumn(u, uniform(F.lit(f"{seed} draw"), F.col(part).cast("string"), F.col(own)))
    copies = F.size(F.filter(cdf, lambda x: x < F.col(u)))
    spread = drawn.select(*names, own, part, F.posexplode(F.array_repeat(F.lit(0), copies)).alias(copy, c))
    numbered = spread.withColumn(copy, F.col(part).cast("long") * STRIDE + F.col(copy))
    keyed = numbered.withColumn(key, uniform(F.lit(f"{seed} order"), F.col(copy).cast("string"), F.col(own)))
    placed = keyed.repartitionById(n, F.floor(F.col(key) * n).cast("int")).sortWithinPartitions(key)
    return placed.select(*names, *([F.col(copy).alias("copy"), F.col(key).alias("mix_key")] if trace else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all of `documents`, mixed."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, OTHER_WEIGHT, trace=True)


def oracle(docs: str = "documents", weights: dict[str, float] = WEIGHTS, other_weight: float = OTHER_WEIGHT, seed: int = SEED) -> str:
    named = ", ".join(f"('={k}', {w!r}::DOUBLE)" for k, w in weights.items())
    names = ", ".join(f"'{k}'" for k in weights)
    return f"""
WITH RECURSIVE given(c, w) AS (VALUES {named}, ('', {other_weight!r}::DOUBLE)
), own AS (
  SELECT *, CASE WHEN source IN ({names}) THEN '=' || source ELSE '' END AS c,
         coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null') AS own
  FROM {docs}
), mass AS (
  SELECT c, sum(coalesce(length(text), 0))::DOUBLE AS mass FROM own GROUP BY c HAVING mass > 0
), rated AS (
  SELECT c, w / sum(w) OVER () * sum(mass) OVER () * 1.0::DOUBLE / mass AS rate FROM mass JOIN given USING (c)
), parted AS (
  SELECT c, ceil(rate / {PART!r})::BIGINT AS parts, rate / ceil(rate / {PART!r}) AS rate FROM rated WHERE rate > 0
), terms(c, rate, k, log, total) AS (
  SELECT c, rate, 0, -rate, exp(-rate) FROM parted
  UNION ALL
  SELECT c, rate, k + 1, log + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log + ln(rate) - ln((k + 1)::DOUBLE))
  FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), cdfs AS (
  SELECT c, list(total ORDER BY k) AS cdf FROM terms GROUP BY c
), dealt AS (
  SELECT own.*, cdf, unnest(range(0, parts)) AS part FROM own JOIN cdfs USING (c) JOIN parted USING (c)
), drawn AS (
  SELECT *, len(list_filter(cdf, lambda x: x < ('0x' || substr(md5('{seed} draw|' || part || '|' || own), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)) AS copies
  FROM dealt
), spread AS (
  SELECT *, part * {STRIDE} + unnest(range(0, copies)) AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy,
       ('0x' || substr(md5('{seed} order|' || copy || '|' || own), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS mix_key
FROM spread
"""


ORACLE_SQL = oracle()
