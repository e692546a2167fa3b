import pytest
from pyspark.sql import functions as F

from gridlogic.llm import common as C


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 301).alias("k"), (F.col("id") % 10).alias("x"))
    few = rows.where("k is not null and k % 5 <> 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"))
    for how in ("inner", "left"):
        got = C.join_dealt(rows, few, ["k"], 4000, ["x"], how, hot_rows=100)
        assert sorted(map(str, got.select("k", "x", "n", "least").collect())) == sorted(map(str, rows.join(few, "k", how).select("k", "x", "n", "least").collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        places = C.join_dealt(rows, few, ["k"], 4000, ["x"], hot_rows=100).where("k = 7").groupBy(F.spark_partition_id()).count()
        assert places.count() > 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`__pred` int, `__x` int")
    assert C.unused(df, "pred") == "____pred" and C.unused(df, "y") == "__y" and C.quoted("a`b") == "`a``b`"


def test_work_folders_can_be_deleted(spark, tmp_path):
    path = C.work_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path in C._made
    C.clean_up(spark)
    assert C._made == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        C.shared_dir(Session())
