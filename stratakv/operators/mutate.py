"""Writes as log rows. Each takes what is visible and returns the operations to append (key, value, tomb)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans import workers
from ..model import KVError


def puts(rows: DataFrame) -> DataFrame:
    return rows.select("key", "value", F.lit(False).alias("tomb"))


def deletes(keys: DataFrame) -> DataFrame:
    """A tombstone for each key, whether it exists or not."""
    return keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tomb"))


def in_range(begin: str, end: str, begin_included: bool, end_included: bool, key: Column | None = None) -> Column:
    k = F.col("key") if key is None else key
    return (k >= begin if begin_included else k > begin) & (k <= end if end_included else k < end)


def delete_range(live: DataFrame, begin: str, end: str, begin_included: bool = True, end_included: bool = False, include_large: bool = True) -> DataFrame:
    """Tombstones for the visible keys in the range; large values stay unless they are included."""
    if begin > end:
        raise KVError("the range ends before it begins")
    rows = live.where(in_range(begin, end, begin_included, end_included))
    return deletes(rows if include_large else rows.where(~scalar.is_large(F.col("value"))))


def covers_all(live: DataFrame, begin: str, end: str, begin_included: bool, end_included: bool) -> bool:
    """Does the range hold every visible key? Also true of an empty database. Two numbers reach the driver."""
    low, high = live.agg(F.min("key"), F.max("key")).first()
    return low is None or ((low > begin or begin_included and low == begin) and (high < end or end_included and high == end))


def delete_ranges(live: DataFrame, ranges: DataFrame) -> DataFrame:
    """Tombstones for keys in any of many half-open ranges (begin, end), in one merge.

    A key is inside when the ranges that began at or before it outnumber those that ended.
    """
    from ..plans import ordered

    edges = ranges.where("begin < end").select(F.explode(F.array(F.struct(F.col("begin").alias("key"), F.lit(1).alias("d")), F.struct(F.col("end").alias("key"), F.lit(-1).alias("d")))).alias("e")).select("e.*").groupBy("key").agg(F.sum("d").alias("d"))
    depth = ordered.running(edges, ["key"], {"depth": ("sum", "d")}).select("key", F.struct("depth").alias("hit"))
    found = ordered.nearest(depth, live.select("key"), True, False)
    return deletes(found.where("hit.depth > 0"))


def clear(live: DataFrame, include_large: bool) -> DataFrame:
    return deletes(live if include_large else live.where(~scalar.is_large(F.col("value"))))


def merge_sum(ops: DataFrame) -> DataFrame:
    """Counters folded from operations (key, seq, amount, tomb): the sum since the last delete; keys never deleted count all.

    Associative, so it is two aggregations and no list of a key's operations.
    """
    cut = ops.where("tomb").groupBy("key").agg(F.max("seq").alias("_cut"))
    rest = ops.where("not tomb").join(cut, "key", "left").where("_cut is null or seq > _cut")
    return rest.groupBy("key").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def merge_fold(ops: DataFrame, start: Column, step) -> DataFrame:
    """A fold of each key's operations in order with a column function (acc, op) -> acc, from (key, seq, ...)."""
    rest = [c for c in ops.columns if c != "key"]
    listed = ops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"]))).alias("_ops"))
    return listed.select("key", F.aggregate("_ops", start, step).alias("acc"))


def merge_with(live: DataFrame, keys: DataFrame, function, schema: str = "key string, value string, tomb boolean") -> DataFrame:
    """Read-modify-write by a Python function (old, exists) -> (new, write, delete), once for each of keys; the log rows."""
    workers.ship(live.sparkSession)
    found = keys.select("key").distinct().join(live.select("key", "value", F.lit(True).alias("_exists")), "key", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for key, value, exists in zip(pdf["key"], pdf["value"], pdf["_exists"], strict=True):
                new, write, delete = function(None if value != value else value, exists is True or exists == 1)
                if write and delete:
                    raise KVError("a merge can't both write and delete")
                if write or delete:
                    out.append((key, None if delete else new, bool(delete)))
            yield type(pdf)(out, columns=["key", "value", "tomb"])

    return found.mapInPandas(run, schema)
