"""Cut lineage: write an intermediate result to the folder the cluster shares, and read it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.chronofold.scratch", "")
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        spark.conf.set("spark.chronofold.scratch", where)
    return where


#: Spark then deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a path and read back. Its shuffles leave the executors' disks with the write: nothing
    reads them again."""
    spark, schema = df.sparkSession, df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def stage(df: DataFrame) -> DataFrame:
    """df as a written table: later plans start from it, and lost executors cost no recomputation."""
    return written(df, f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}")
