"""Session defaults and table access shared by the queries."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster, use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where executors are threads of this process."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    atexit.register(shutil.rmtree, folder := tempfile.mkdtemp(prefix="gridlogic-"), ignore_errors=True)
    return f"file://{folder}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage in the shared folder, so that what follows does not make them again, and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder, which takes a fraction of a checkpoint's disk where columns repeat themselves."""
    df.write.parquet(path := scratch(df.sparkSession, "stored"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it by their PYTHONPATH; once per application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    on_path = root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if on_path or _shipped.get("to") == context.applicationId:
        return
    path = os.path.join(folder := tempfile.mkdtemp(prefix="gridlogic-"), "gridlogic.zip")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "gridlogic")):
            for n in names:
                if n.endswith(".py"):
                    z.write(full := os.path.join(at, n), os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped["to"] = context.applicationId


_shipped: dict[str, str] = {}
