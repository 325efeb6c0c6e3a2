"""Written intermediate tables, which end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="kindred-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many tasks as shuffles have: rows of a small file are one task's otherwise, however much each of them costs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def merging(df: DataFrame) -> DataFrame:
    """df for a join by sorting: compressed tables look small, and broadcasting one sends all its rows through the driver."""
    return df.hint("merge")


#: Whether Spark deletes a statement's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back; what the write has shuffled is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept_counting(df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """As kept, and how many rows `what` holds for, counted as they are written."""
    told = Observation()
    out = kept(df.observe(told, F.count_if(what).alias("n")), name)
    return out, told.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables that kept has written, when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
