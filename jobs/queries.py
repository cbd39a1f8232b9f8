"""The jobs as queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import split_audit, word_index
from tallyrack.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "word-index")
    for _ in range(2):
        word_index.run(spark, f"{sf_dir}/documents.parquet", output)
    return word_index.index(spark, output).drop("upto")


def job2_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "split-audit")
    for _ in range(2):
        split_audit.run(spark, f"{sf_dir}/documents.parquet", output)
    return split_audit.read(spark, output)


QUERIES = {"job1_word_index": job1_word_index, "job2_split_audit": job2_split_audit}
SQL = {"job1_word_index": word_index.SQL, "job2_split_audit": split_audit.SQL}
