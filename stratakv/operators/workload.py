"""Benchmark workloads in bulk: a table of drawn operations, then one query for each kind of operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import generators
from . import scan, search

#: Shares of the standard mixes in hundredths.
MIXES = {"a": {"get": 50, "set": 50}, "b": {"get": 95, "set": 5}, "c": {"get": 100}, "d": {"get": 95, "set": 5}, "e": {"scan": 95, "set": 5}, "f": {"get": 50, "rmw": 50}}


def drawn(ids: DataFrame, mix: str) -> DataFrame:
    """ids (op_id, key) with the operation of each: op_id's hash falls into the mix's shares."""
    roll = F.pmod(F.col("op_id") * 7919, F.lit(100))
    out, upto = F.lit(None).cast("string"), 0
    for op, share in MIXES[mix].items():
        low, upto = upto, upto + share
        out = F.when((roll >= low) & (roll < upto), op).otherwise(out)
    return ids.withColumn("op", out)


def run_mix(live: DataFrame, ops: DataFrame, scan_rows: int = 50) -> DataFrame:
    """Counts by operation and success. Reads see the state before the mix; sets and read-modify-writes always succeed."""
    reads = search.get_many(live.select("key", "value", "hlc"), ops.where("op in ('get', 'rmw')").select("key", "op")).select("op", F.when(F.col("op") == "rmw", True).otherwise(F.col("found")).alias("ok"))
    done = reads.unionByName(ops.where("op = 'set'").select("op", F.lit(True).alias("ok")))
    starts = ops.where("op = 'scan'").select("key", "op")
    if starts.limit(1).count():
        # a scan ends in time when it starts at or below the key that so many rows stand above
        last = live.select("key").orderBy(F.col("key").desc()).limit(scan_rows + 1).agg(F.min("key"), F.count("*")).first()
        done = done.unionByName(starts.select("op", F.coalesce(F.col("key") <= last[0], F.lit(False)).alias("ok") if last[1] > scan_rows else F.lit(False).alias("ok")))
    return done.groupBy("op").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


def fill(spark, n: int, key_bytes: int, value_bytes: int) -> DataFrame:
    from ..functions import scalar

    return spark.range(n).select(scalar.hex_key(F.col("id"), key_bytes).alias("key"), scalar.letters_value(value_bytes).alias("value"))


def drawn_keys(spark, n: int, space: int, kind: str, seed: int = 1) -> DataFrame:
    """n key numbers by a distribution: seq, uniform, zipf, czipf."""
    rows = spark.range(n).withColumnRenamed("id", "op_id")
    u, v = generators.uniform(F.col("op_id"), seed), generators.uniform(F.col("op_id"), seed + 1)
    draws = {"seq": F.col("op_id") % space, "uniform": F.floor(u * space).cast("long"), "zipf": generators.zipf(u, space), "czipf": generators.clustered_zipf(u, v, space)}
    return rows.withColumn("n", draws[kind])


__all__ = ["MIXES", "drawn", "drawn_keys", "fill", "run_mix", "scan"]
