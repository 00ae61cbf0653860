"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """A folder that all executors share: in ``spark.checkpoint.dir``, or, in local mode only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.gettempdir()
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: the cluster's machines need a shared folder for intermediate tables")
    return f"{folder.rstrip('/')}/octaray-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
