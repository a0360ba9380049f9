"""Intermediate tables in the cluster's shared folder (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from its checkout."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where none is set on a single machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written now: read several times without being computed again, whichever executor is lost.

    Spark removes shuffle files once the driver's JVM has collected the plan that made them, so that is asked for before each step;
    else all steps' files add up until its heap happens to be full.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for _ in range(2):  # once for the plan, once for what it held
        df.sparkSession._jvm.System.gc()
        time.sleep(0.3)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with its rows' positions (from 0) in the order of `by`, whose values differ.

    Ranges are sorted and numbered apart; only a count a range is summed up over all.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + own - 1).drop("_part", "_start")
