"""Point reads and searches, one key at a time and in bulk. `live` has key, value, hlc (and seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import Mode
from ..plans import ordered


def _columns(live: DataFrame, mode: Mode, values: DataFrame | None) -> DataFrame:
    if mode & Mode.SKIP_VALUES:
        return live.select("key", F.lit(None).cast("string").alias("value"), "hlc")
    if mode & Mode.LAZY_LARGE:
        large = scalar.is_large(F.col("value"))
        return live.select("key", F.when(~large, F.col("value")).alias("value"), large.alias("large"), F.when(large, scalar.digest(F.col("value"))).alias("vref"), "hlc")
    return live.select("key", "value", "hlc")


def condition(mode: Mode, key: str) -> Column:
    k = F.col("key")
    search = mode.search
    if search == Mode.EXACT:
        return (k == key) & F.lit(key != "")
    if search in (Mode.GTE, Mode.GT):
        return k >= key if search == Mode.GTE else k > key
    if key == "":
        return F.lit(True)
    return k <= key if search == Mode.LTE else k < key


def find(live: DataFrame, mode: Mode, key: str, values: DataFrame | None = None) -> DataFrame:
    """At most one row with `exact`. The range filter reaches the scan; the rest is a limit of one in key order."""
    hit = _columns(live.where(condition(mode, key)), mode, values)
    order = F.col("key").desc() if mode.search in (Mode.LTE, Mode.LT) else F.col("key").asc()
    return hit.orderBy(order).limit(1).withColumn("exact", F.col("key") == F.lit(key))


def get(live: DataFrame, key: str) -> DataFrame:
    return find(live, Mode.EXACT, key)


def get_many(live: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, ...) with value, hlc and found."""
    hits = live.select("key", "value", "hlc", F.lit(True).alias("found"))
    return probes.join(hits, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def find_many(live: DataFrame, probes: DataFrame, mode: Mode) -> DataFrame:
    """probes (key, ...) with hit_key, hit_value, hit_hlc, exact: the search of each probe, in one merge of both sides."""
    if mode.search == Mode.EXACT:
        hits = live.select("key", F.struct("key", "value", "hlc").alias("hit"))
        found = probes.join(hits, "key", "left")
    else:
        hits = live.select("key", F.struct("key", "value", "hlc").alias("hit"))
        found = ordered.nearest(hits, probes, mode.search in (Mode.LTE, Mode.LT), mode.search in (Mode.GT, Mode.LT))
    value = F.lit(None).cast("string") if mode & Mode.SKIP_VALUES else F.col("hit.value")
    return found.select(*probes.columns, F.col("hit.key").alias("hit_key"), value.alias("hit_value"), F.col("hit.hlc").alias("hit_hlc"), F.coalesce(F.col("hit.key") == F.col("key"), F.lit(False)).alias("exact"))


def find_iterator(live: DataFrame, mode: Mode, key: str) -> DataFrame:
    """The rows from the hit on, the hit first, in the direction of the search; empty on a miss."""
    down = mode.search in (Mode.LTE, Mode.LT)
    hit = find(live, mode, key).select(F.col("key").alias("_hit"))
    rows = live.join(F.broadcast(hit), F.col("key") <= F.col("_hit") if down else F.col("key") >= F.col("_hit")).drop("_hit")  # one row
    return rows.orderBy(F.col("key").desc() if down else "key")
