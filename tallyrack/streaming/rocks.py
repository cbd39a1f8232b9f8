"""Settings that keyed state of arbitrary size needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    _ = spark.streams.active  # batch runs need the state coordinator too
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def in_order(frames) -> pd.DataFrame:
    """All rows of a key in a trigger by seq (null first): they come in several frames, in any order."""
    return pd.concat(list(frames)).sort_values("seq", kind="stable", na_position="first")


def known(value):
    """None for every kind of missing value that pandas has."""
    return None if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value) else value
