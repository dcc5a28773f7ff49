"""Counts, storage metrics, histograms and integrity checks: aggregations over the log, the files and the extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import BLOCK_BYTES


def length(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("n"))


def big_small(live: DataFrame) -> DataFrame:
    large = scalar.is_large(F.col("value"))
    return live.agg(F.count_if(large).alias("big"), F.count_if(~large).alias("small"))


def counters(log: DataFrame) -> DataFrame:
    """Live big and small keys from state changes alone: what each write adds to or takes from the counters."""
    w = Window.partitionBy("key").orderBy("hlc", "seq")
    big = F.when(F.col("tomb"), 0).otherwise(scalar.is_large(F.col("value")).cast("int"))
    small = F.when(F.col("tomb"), 0).otherwise((~scalar.is_large(F.col("value"))).cast("int"))
    rows = log.withColumn("_b", big).withColumn("_s", small)
    change = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    return rows.select(change("_b").alias("b"), change("_s").alias("s")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("big"), F.coalesce(F.sum("s"), F.lit(0)).alias("small"))


def key_range(live: DataFrame) -> DataFrame:
    return live.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def written(log: DataFrame) -> DataFrame:
    """Logical bytes of all writes, encoded log bytes, and their ratio (0 for an empty log)."""
    logical = scalar.n_bytes(F.col("key")) + F.coalesce(scalar.n_bytes(F.col("value")), F.lit(0))
    record = scalar.record_bytes(F.col("key"), F.col("value"), F.col("tomb"))
    values = F.when(scalar.is_large(F.col("value")), scalar.n_bytes(F.col("value")) + 56).otherwise(0)
    out = log.agg(F.count("*").alias("writes"), F.coalesce(F.sum(logical), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(record), F.lit(0)).alias("log_bytes"), F.coalesce(F.sum(values), F.lit(0)).alias("value_bytes"))
    ratio = F.when(F.col("logical_bytes") == 0, F.lit(0.0)).otherwise((F.col("log_bytes") + F.col("value_bytes")) / F.col("logical_bytes"))
    return out.withColumn("write_amp", ratio)


def compaction(log: DataFrame) -> DataFrame:
    """What a compaction would do: records and bytes before and after."""
    from ..plans import visible

    record = scalar.record_bytes(F.col("key"), F.col("value"), F.col("tomb"))
    old = log.agg(F.count("*").alias("old_records"), F.coalesce(F.sum(record), F.lit(0)).alias("old_bytes"))
    new = visible.live(log).withColumn("tomb", F.lit(False)).agg(F.count("*").alias("new_records"), F.coalesce(F.sum(record), F.lit(0)).alias("new_bytes"))
    return old.join(new).withColumn("reclaimed_bytes", F.col("old_bytes") - F.col("new_bytes"))  # one row each


def block_usage(extents: DataFrame) -> DataFrame:
    """Bytes of each block of the address space; an extent (poff, len) counts in the block where it begins."""
    return extents.groupBy(F.floor(F.col("poff") / BLOCK_BYTES).cast("long").alias("block")).agg(F.sum("len").alias("live_bytes"))


def usage_histogram(extents: DataFrame) -> DataFrame:
    return block_usage(extents).groupBy(F.floor(F.col("live_bytes") / 65536).cast("long").alias("bucket")).agg(F.count("*").alias("blocks"))


def garbage(extents: DataFrame, threshold: float = 0.5) -> DataFrame:
    used = block_usage(extents)
    return used.agg(
        F.coalesce(F.sum("live_bytes"), F.lit(0)).alias("live_bytes"),
        F.coalesce(F.sum(F.lit(BLOCK_BYTES) - F.col("live_bytes")), F.lit(0)).alias("garbage_bytes"),
        F.count("*").alias("blocks_in_use"),
        F.count_if(F.col("live_bytes") < threshold * BLOCK_BYTES).alias("blocks_under"),
    )


def gc_victims(extents: DataFrame) -> DataFrame:
    """Blocks to empty, with the round (1 to 4) that takes them: under 1/8, 1/4, 1/2, then all but full ones."""
    used = block_usage(extents)
    share = F.col("live_bytes") / BLOCK_BYTES
    full = BLOCK_BYTES - 2 * (128 << 10)
    turn = F.when(share < 1 / 8, 1).when(share < 1 / 4, 2).when(share < 1 / 2, 3).when(F.col("live_bytes") < full, 4)
    return used.withColumn("round", turn.cast("int")).where("round is not null")


def latency_cdf(micros: DataFrame, column: str, buckets: int = 10_000) -> DataFrame:
    """Counts by whole microsecond, the rest in one bucket, with the running count and share."""
    counted = micros.select(F.least(F.floor(column).cast("long"), F.lit(buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most buckets + 1 rows
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("cum", F.sum("n").over(over)).withColumn("pct", F.round(100 * F.col("cum") / total, 6))


CHECKS = ("unique_keys", "sorted_files", "no_overlap", "valid_keys", "resolved_values", "digests", "extent_bounds", "extent_total")


def integrity(snapshot: DataFrame, store: DataFrame, manifest: DataFrame | None = None, extents: DataFrame | None = None, max_loff: int | None = None) -> DataFrame:
    """Violations as (check, detail, fatal). snapshot: key, value, tomb, vref; store: vref, value; manifest: path, min_key, max_key, n."""
    say = lambda df, check, detail, fatal=False: df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"), F.lit(fatal).alias("fatal"))
    found = [
        say(snapshot.groupBy("key").count().where("count > 1"), "unique_keys", F.col("key")),
        say(snapshot.where("key is null or key = ''"), "valid_keys", F.coalesce("key", F.lit("null"))),
        say(snapshot.where("vref is not null").select("vref").distinct().join(store, "vref", "left_anti"), "resolved_values", F.col("vref"), True),
        say(store.where(scalar.digest(F.col("value")) != F.col("vref")), "digests", F.col("vref"), True),
    ]
    if manifest is not None:
        w = Window.orderBy("min_key", "max_key")  # one row for each file
        found.append(say(manifest.withColumn("_before", F.lag("max_key").over(w)).where("_before >= min_key"), "no_overlap", F.col("path")))
        found.append(say(manifest.where("min_key > max_key or n <= 0"), "sorted_files", F.col("path")))
    if extents is not None:
        bad = extents.where((F.col("len") <= 0) | (F.floor(F.col("poff") / BLOCK_BYTES) != F.floor((F.col("poff") + F.col("len") - 1) / BLOCK_BYTES)))
        found.append(say(bad, "extent_bounds", F.col("ord")))
        if max_loff is not None:
            found.append(say(extents.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("s")).where(F.col("s") != max_loff), "extent_total", F.col("s")))
    return reduce(DataFrame.unionByName, found)
