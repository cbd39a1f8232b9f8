"""What both jobs share: the command line, the config file and the log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(name: str, given: str | None = None) -> dict:
    """The config file beside the job, with the values of the ``given`` file (of the driver's machine) over it."""
    found = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    return found | (json.loads(Path(given).read_text()) if given else {})


def command(name: str, job: Callable[..., dict], about: str) -> None:
    """``job(spark, input, output, config)``; only here a session starts and stops."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    parser.add_argument("input", help="folder or file of the Parquet table to read")
    parser.add_argument("output", help="folder to write below")
    parser.add_argument("--config", help="JSON file whose values replace those of the file beside the job")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, args.input, args.output, settings(name, args.config))
    finally:
        spark.stop()


def ready(spark: SparkSession, path: str, schema: str, *partitions: str) -> DataFrame:
    """The table at ``path``; where there is none yet, an empty one."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)
    return spark.read.schema(schema).parquet(path)
