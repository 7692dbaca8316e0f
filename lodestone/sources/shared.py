"""The folder that driver and executors share, for what an application writes on its way."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, deleted when the application ends; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        _LOCAL[spark.sparkContext.applicationId] = named
    path = f"{named.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
