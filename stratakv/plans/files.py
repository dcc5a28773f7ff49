"""Steps kept as files, so that what follows doesn't run what came before again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import KVError


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; on one machine a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise KVError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{tempfile.mkdtemp(prefix=name)}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read from its files."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
