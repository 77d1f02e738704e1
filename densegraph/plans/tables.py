"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="densegraph-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/densegraph-{context.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """The table written and read again: its lineage is cut and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that the application has written; results that were not written elsewhere can't be read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
