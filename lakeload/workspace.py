"""Where intermediate tables are written so that every executor can read them.

Lineage is cut by writing Parquet to a shared folder and reading it back. A lost executor then costs a re-read, not a
re-computation, and Catalyst sees the true file size of what was written, so its own threshold decides on a broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="lakeload-")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only when Spark runs on this machine alone."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, for one staged table or one set of outputs.

    All paths of one application lie in one folder. Nothing is deleted here, for a result that is still to be read may need
    it; the owner of the shared folder can expire the whole folder once the application has ended.
    """
    return f"{shared_root(spark)}/lakeload/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
