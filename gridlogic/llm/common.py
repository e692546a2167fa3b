"""What the operators of this subpackage share: tables, the shared folder, checkpoints, bounded sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.session import ship_package

#: Bytes of a batch between Spark and Python, so that many long texts do not come at once; Spark's own default is 64 MB.
ARROW_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Executors can import this package, and Arrow batches are small unless the session says otherwise."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", f"{64 << 20}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"__{name}").lower() in taken:
        pass
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and executors are threads of this process (tests), a temporary one."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if (set_already := spark.sparkContext.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridlogic-"))
        set_already = spark.sparkContext.getCheckpointDir()
    return str(set_already).rstrip("/")


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = re.sub("^file:/+", "/", path)
    _made.append(f"file://{path}" if path.startswith("/") else path)
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of work_path() that no result is still to be read from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all work folders of this process; results that were not written elsewhere can't be read after it."""
    for path in list(_made):
        remove(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Keys that are dealt over several tasks: those with more than a HOT_KEYS-th of all rows, of which there are fewer than HOT_KEYS; and with HOT_ROWS at least.
HOT_KEYS, HOT_ROWS = 10_000, 2_000


def join_dealt(rows: DataFrame, few: DataFrame, keys: list[str], total: int, by: list[str], how: str = "inner", n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """rows joined (inner or left) with few, which has for each key, in n, how many of the total rows have it at most.

    The rows of a hot key are dealt by a hash of by and their partition over as many tasks as its count asks for, and its rows of few are repeated for each. Hot
    keys are fewer than HOT_KEYS at any size, and are broadcast. n and the columns of few stay. Rows with a null key find no partner.
    """
    most = max(hot_rows or HOT_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = few.where(F.col(n) > most).select(*keys, salts.alias("__salts")).distinct()
    place = F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.coalesce("__salts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", place).drop("__salts")
    copied = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
