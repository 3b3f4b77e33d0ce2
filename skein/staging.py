"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode alone a temporary folder does where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="skein-shared-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: The temporary folder of each local application.
_OWN: dict[str, str] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage: what follows survives the loss of any executor and never computes df again."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
