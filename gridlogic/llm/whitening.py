"""Whitening of embeddings: exact sums, the Gramian of centred rows, eigenvectors of it, and a projection of every row.

Entries become whole numbers first, so that sums over any number of rows, and each row's distance from the mean, are exact. With S = q * n + r a centred entry
is (x - q) - r / n, which loses nothing to a large mean. The Gramian of the centred rows is a tree of partial sums (RowMatrix); what reaches the driver is one matrix
of dims x dims. Its eigenvectors are sent to the workers, which project their rows. The whitened rows are written once; how far their covariance is from the identity is
measured on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import checkpointed, quoted, ready, table

if TYPE_CHECKING:
    import pandas as pd

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are kept.
COMPONENTS = 32
#: Dimensions at most: the matrix that the driver decomposes has this many rows and columns (512 MB), and workers get COMPONENTS of them.
MOST_DIMS = 8_192
#: Entries beyond this in size, which no long could hold in 64ths, count as this.
MOST = float(1 << 55)
#: Components whose eigenvalue is a smaller share of the largest than this times dims carry rounding errors alone, and are left out.
NOTHING = 1e-13


def whole_entries(vector: Column) -> Column:
    """array<long> of an array of numbers."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * F.least(F.greatest(c.cast("double"), F.lit(-MOST)), F.lit(MOST))) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Neither null nor empty, no entry null or not finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


@dataclass
class Whitening:
    """n rows with these sums; eigenvalues fall, components[:, k] belongs to eigenvalues[k]."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def covariance(rows: DataFrame, vector: str, dims: int, n: int) -> np.ndarray:
    """Of centred rows (array<double>): the Gramian over n."""
    from pyspark.ml.functions import array_to_vector  # these modules are large, and other queries do not need them
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(vector)).alias("v")), "v")
    return RowMatrix(vectors, 0, dims).computeGramianMatrix().toArray() / n


def entry_sums(rows: DataFrame, vector: str, kind: str) -> dict[int, object]:
    """By dimension; each task adds its own rows up first."""
    found = rows.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(kind)).alias("s")).collect()
    return {r.at: r.s for r in found}


def centred(vector: str, sums: list[int], n: int) -> Column:
    """Of array<long>: less the mean, as doubles; whole parts are taken off as whole numbers."""
    parts = F.array(*(F.struct(F.lit(s // n).cast("long").alias("q"), F.lit((s % n) / n).alias("r")) for s in sums))
    return F.zip_with(vector, parts, lambda x, m: (x - m["q"]).cast("double") - m["r"])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: (x), array<long> of one length in all rows. None without rows."""
    n = rows.count()
    if not n:
        return None
    totals = entry_sums(rows, "x", "decimal(20,0)")
    sums = [int(totals[i]) for i in range(len(totals))]
    v = covariance(rows.select(centred("x", sums, n).alias("x")), "x", len(sums), n)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, len(values))]
    values, vectors = values[order], vectors[:, order]
    real = values > max(values[0], 0.0) * NOTHING * len(sums)
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(values) else np.ones(0)
    return Whitening(n, sums, values, vectors * signs, float(np.trace(v)))


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """Of rows of whole numbers: the whitened rows, and the exact sums of (n * x - S)^2."""
    quotients = np.array([s // model.n for s in model.sums], np.int64)
    rests = [s % model.n for s in model.sums]
    less = x - quotients
    white = (less - np.array(rests, float) / model.n) @ (model.components / np.sqrt(model.eigenvalues))
    largest = int(np.abs(less).max(initial=0)) * model.n + max(rests, default=0)
    exact = np.int64 if largest * largest * max(len(rests), 1) < 1 << 63 else object
    apart = less.astype(exact) * model.n - np.array(rests, exact)
    return white, [int(s) for s in (apart * apart).sum(axis=1)]


def _whiten(model: Whitening, vector: str, white: str, deviation: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows, sums = project(np.stack(batch[vector].to_numpy()), model)
                yield batch.drop(columns=vector).assign(**{white: list(rows), deviation: [Decimal(s) if s < 10**38 else None for s in sums]})

    return run


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, white: str = "whitened", deviation: str = "deviation") -> tuple[DataFrame, Whitening | None]:
    """df with whitened (array<double>, by component) and deviation (decimal: the sum over dimensions of (n * x - S)^2, exact; null beyond 38 digits) in place of the vector, and the model.

    Rows whose vector is null or empty, or has an entry that is null or not finite, are left out, and so are rows of another length than most (ties: the longer one). Repeated
    rows count, and come out, as often as they are there. Components without variance are left out, so that equal vectors give empty arrays. Without rows the model
    is None. All other columns stay; whitened and deviation must not be among them (ValueError), nor may there be more than MOST_DIMS entries.
    """
    names = [c for c in df.columns if c != vector]
    if {white.lower(), deviation.lower()} & {c.lower() for c in names}:
        raise ValueError(f"there is a column {white} or {deviation}")
    ready(df.sparkSession)
    schema = ", ".join([*(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in names), f"{quoted(white)} array<double>", f"{quoted(deviation)} decimal(38,0)"])
    good = df.where(usable(F.col(quoted(vector))))
    lengths = good.groupBy(F.size(quoted(vector)).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = lengths[0].d if lengths else 0
    if dims > MOST_DIMS:
        raise ValueError(f"more than {MOST_DIMS} dimensions")
    rows = good.where(F.size(quoted(vector)) == dims).withColumn(vector, whole_entries(F.col(quoted(vector))))
    model = fit(rows.select(F.col(quoted(vector)).alias("x")), components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema), None
    return checkpointed(rows.mapInPandas(_whiten(model, vector, white, deviation), schema)), model


def identity_error(whitened: DataFrame, model: Whitening, white: str = "whitened") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on the rows."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    totals = entry_sums(whitened, white, "double")
    means = F.array(*(F.lit(totals[i] / model.n) for i in range(k)))
    v = covariance(whitened.select(F.zip_with(white, means, lambda x, m: x - m).alias(white)), white, k, model.n)
    return float(np.abs(v - np.eye(k)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all vectors of `embeddings`, whitened. A deviation that no long can hold is null there."""
    rows, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if model is None:
        return rows.selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    error, explained = identity_error(rows, model), F.array(*map(F.lit, model.explained)) if len(model.eigenvalues) else F.array().cast("array<double>")
    found = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
