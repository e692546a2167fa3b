"""Results that are appended as they come, each test once, over restarts and over writers with checkpoints of their own.

A target holds rows by commit, the keys of each commit by bucket of the key's hash, and a marker for each commit, written last: rows and keys of a commit without
a marker are not there. A batch reads the keys of the buckets that its own keys fall into and nothing else; a commit that is run again replaces itself.
One writer at a time.

    target/rows/commit=<id>/...json   target/keys/commit=<id>/bucket=<n>/...parquet   target/commits/<id>
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridlogic.session import checkpointed
from gridlogic.sources import files as S

#: Buckets of a new target; a target keeps its own number.
BUCKETS = 256


def read_stream(spark: SparkSession, path: str, schema: str = S.RESULT) -> DataFrame:
    """Result files as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(path)


def commits(spark: SparkSession, target: str) -> dict[str, list[str]]:
    """The commits that were ended; and of each that only merged others' keys, which ones these are."""
    found = S.listed(spark, f"{S.globless(target)}/commits/*")
    return {p.rsplit("/", 1)[1]: json.loads(S.read_file(spark, p)) for p in found if p.rsplit("/", 1)[1].startswith("merged-")} | {p.rsplit("/", 1)[1]: [] for p in found if not p.rsplit("/", 1)[1].startswith("merged-")}


def read_target(spark: SparkSession, target: str, schema: str = S.RESULT) -> DataFrame:
    """All rows that were appended, with their commit."""
    ended = [c for c in commits(spark, target) if not c.startswith("merged-")]
    paths = [f"{S.globless(target)}/rows/commit={c}" for c in ended]
    if not paths:
        return spark.createDataFrame([], StructType.fromDDL(schema).add("commit", "string"))
    return spark.read.schema(f"{schema}, commit string").option("basePath", f"{target}/rows").json(paths)


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def layout(spark: SparkSession, target: str) -> int:
    """The target's number of buckets, which it gets with its first commit."""
    path = f"{target}/layout.json"
    if not S.exists(spark, path):
        S.write_file(spark, path, json.dumps({"buckets": BUCKETS}))
    return json.loads(S.read_file(spark, path))["buckets"]


def known_keys(spark: SparkSession, target: str, key: str, kind: str, buckets: list[int], without: str = "") -> DataFrame:
    """(key): those of ended commits that fall into the buckets. The folders of other buckets are not opened."""
    ended = commits(spark, target)
    replaced = {c for own in ended.values() for c in own}
    paths = [f"{target}/keys/commit={c}" for c in ended if c not in replaced and c != without and S.exists(spark, f"{target}/keys/commit={c}")]
    name = "`" + key.replace("`", "``") + "`"
    if not paths:
        return spark.createDataFrame([], f"{name} {kind}")
    read = spark.read.schema(f"{name} {kind}, commit string, bucket int").option("basePath", f"{target}/keys").parquet(*map(S.globless, paths))
    return read.where(F.col("bucket").isin(buckets)).select(name)


def append_rows(rows: DataFrame, target: str, commit: str, key: str = "test_id", order: tuple[str, ...] = ()) -> int:
    """Appends the rows whose key the target doesn't hold, of those with one key the first by order (by all columns without one); how many there were.

    A null key is a key like any other. Other columns stay as they are; a target's rows must have one schema. Without rows nothing is written.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    if S.exists(spark, f"{target}/commits/{commit}"):
        return 0
    quoted = "`" + key.replace("`", "``") + "`"
    n = layout(spark, target)
    names = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    by = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in order), *names)
    first = checkpointed(rows.groupBy(F.col(quoted).alias("k")).agg(F.min_by(F.struct(*names), by).alias("r")).withColumn("b", bucket(F.col("k"), n)))
    touched = [r.b for r in first.select("b").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return 0
    known = known_keys(spark, target, key, kind, touched, commit).select(F.col(quoted).alias("known"))
    fresh = first.join(known, first["k"].eqNullSafe(known["known"]), "left_anti")
    fresh.select("r.*").write.mode("overwrite").json(f"{target}/rows/commit={commit}")
    written = spark.read.schema(rows.schema).json(f"{S.globless(target)}/rows/commit={commit}")
    keys = written.select(quoted, bucket(F.col(quoted), n).alias("bucket"))
    keys.repartition("bucket").sortWithinPartitions("bucket", quoted).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/keys/commit={commit}")
    S.write_file(spark, f"{target}/commits/{commit}", "[]")
    return written.count()


def merge_keys(spark: SparkSession, target: str, key: str = "test_id", kind: str = "string") -> None:
    """The keys of all ended commits as one set of files, a file a bucket; batches read that instead. Rows stay where they are."""
    ended = commits(spark, target)
    n = layout(spark, target)
    quoted = "`" + key.replace("`", "``") + "`"
    keys = known_keys(spark, target, key, kind, list(range(n))).select(quoted, bucket(F.col(quoted), n).alias("bucket"))
    name = f"merged-{uuid.uuid4().hex}"
    keys.repartition("bucket").sortWithinPartitions("bucket", quoted).write.partitionBy("bucket").parquet(f"{target}/keys/commit={name}")
    S.write_file(spark, f"{target}/commits/{name}", json.dumps(sorted(ended)))


def append_once(results: DataFrame, target: str, checkpoint: str, key: str = "test_id", once: bool = True, order: tuple[str, ...] = ()) -> StreamingQuery:
    """append_rows() for each batch of a stream. A commit is named by the checkpoint's own id and the batch's number, so that a batch that is run again is the same commit, and
    another checkpoint's batches are others. With once, what is there now is taken and the query ends."""
    spark = results.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        writer = json.loads(S.read_file(spark, f"{checkpoint}/metadata"))["id"]
        append_rows(batch, target, f"{writer}-{number}", key, order)

    writer = results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
