"""Text in and out: a line for each key, dumps with a rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, scalar
from ..operators import scan
from ..plans import files


def load(spark: SparkSession, path: str, value_is_key: bool = False) -> DataFrame:
    """Puts (key, value, tomb) from lines; empty lines are no keys."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.col("value").alias("key"), (F.col("value") if value_is_key else F.lit(None).cast("string")).alias("value"), F.lit(False).alias("tomb"))


def dump(live: DataFrame) -> DataFrame:
    """(rank, line): key, and its value after ` ::: ` unless it is nil."""
    return scan.ascend(live).select("rank", F.concat_ws(" ::: ", "key", "value").alias("line"))


def dump_keys(live: DataFrame) -> DataFrame:
    """(rank, key, n_bytes, digest). The values are read once: what is ranked is kept as files without them."""
    rows = live.select("key", F.coalesce(scalar.n_bytes(F.col("value")), F.lit(0)).alias("n_bytes"), scalar.digest(F.coalesce("value", F.lit(""))).alias("digest"))
    return scan.ascend(files.kept(rows, "keys")).select("rank", "key", "n_bytes", "digest")


def dump_times(live: DataFrame) -> DataFrame:
    return scan.ascend(live).select("rank", "key", clock.to_timestamp(F.col("hlc")).alias("at"), "hlc")


def trailer(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("n"), F.coalesce(F.sum(scalar.n_bytes(F.col("key"))), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(scalar.n_bytes(F.col("value"))), F.lit(0)).alias("value_bytes"))
