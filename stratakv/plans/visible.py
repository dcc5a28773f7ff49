"""The visible relation: the last write of each key, tombstones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The winning operation of each key, tombstones included; ties of the clock go to the larger seq.

    A two-phase aggregation: a task sends one row for each of its keys, so a key that is written all the time is no skew.
    """
    if upto is not None:
        log = log.where(F.col("seq") <= upto)
    return log.groupBy("key").agg(F.max_by(F.struct("value", "tomb", "hlc", "seq"), F.struct("hlc", "seq")).alias("x")).select("key", "x.value", "x.tomb", "x.hlc", "x.seq")


def live(log: DataFrame, upto: int | None = None) -> DataFrame:
    return latest(log, upto).where("not tomb").drop("tomb")


def merged(snapshot: DataFrame | None, delta: DataFrame | None) -> DataFrame:
    """The visible relation of a snapshot (one row a key) and a delta of later operations.

    Without a delta the snapshot is the answer and nothing is aggregated or shuffled.
    """
    if delta is None:
        return snapshot.where("not tomb").drop("tomb")
    return live(delta if snapshot is None else snapshot.unionByName(delta))


def union_by_precedence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two relations with unique keys as one; a key of both is taken from the first."""
    a, b = first.select("key", F.struct(*[c for c in first.columns if c != "key"]).alias("a")), second.select("key", F.struct(*[c for c in second.columns if c != "key"]).alias("b"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("a", "b").alias("x")).select("key", "x.*")
