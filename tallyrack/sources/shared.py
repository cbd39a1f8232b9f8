"""Tables that cut lineage, in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of this machine only where it is unset and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyrack.local.shared", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tallyrack-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("tallyrack.local.shared", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
