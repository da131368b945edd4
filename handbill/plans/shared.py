"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """df by its keys in a named number of parts, at most that many, so that costly rows are spread however few bytes they have."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts if most is None else min(parts, most), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df, of which a join neither broadcasts nor hashes the whole: before they run, plans take exploded rows for as few as their sources."""
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, or to a folder of its own where a local session names none."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new empty folder where driver and executors both see it; it goes when the driver ends."""
    checkpointed(spark.range(0))
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    name = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name
