"""Large values beside the log: content-addressed, written once, joined only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with references in place of large values, values by digest)."""
    large = scalar.is_large(F.col("value"))
    ref = F.when(large, scalar.digest(F.col("value")))
    slim = log.withColumn("vref", ref).withColumn("value", F.when(~large, F.col("value")))
    store = log.where(large).select(scalar.digest(F.col("value")).alias("vref"), "value").groupBy("vref").agg(F.first("value").alias("value"))
    return slim, store.withColumn("n_bytes", scalar.n_bytes(F.col("value")))


def resolve(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows with their whole values; a reference that is not in the store gives null."""
    v = store.select("vref", F.col("value").alias("_large"))
    return rows.join(v, "vref", "left").withColumn("value", F.coalesce("value", "_large")).drop("_large", "vref")


def rewrites(log: DataFrame) -> DataFrame:
    """Large writes with `reused`: the key's previous operation had the same large value, so its pointer stays."""
    w = Window.partitionBy("key").orderBy("hlc", "seq")
    digest = F.when(scalar.is_large(F.col("value")), scalar.digest(F.col("value")))
    rows = log.withColumn("vref", digest).withColumn("_before", F.lag("vref").over(w))
    return rows.where("vref is not null").withColumn("reused", F.coalesce(F.col("vref") == F.col("_before"), F.lit(False))).drop("_before")


def vacuum(store: DataFrame, live: DataFrame) -> DataFrame:
    """The values that a visible row refers to; live has vref."""
    return store.join(live.where("vref is not null").select("vref").distinct(), "vref", "left_semi")


def vacuum_stats(store: DataFrame, live: DataFrame) -> DataFrame:
    used = live.where("vref is not null").select("vref").distinct().withColumn("_used", F.lit(True))
    rows = store.join(used, "vref", "left")
    kept = F.col("_used").isNotNull()
    size = F.col("n_bytes") + 56
    return rows.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("old_bytes"),
        F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("new_bytes"),
        F.coalesce(F.sum(F.when(~kept, size)), F.lit(0)).alias("reclaimed_bytes"),
        F.count_if(kept).alias("entries_kept"),
        F.count_if(~kept).alias("entries_dropped"),
    )
