"""Comparing two visible relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ordered


def full(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that differ: removed, added, changed or touched (same value, another clock)."""
    both = a.select("key", F.col("value").alias("a_value"), F.col("hlc").alias("a_hlc")).join(b.select("key", F.col("value").alias("b_value"), F.col("hlc").alias("b_hlc")), "key", "full_outer")
    kind = F.when(F.col("b_hlc").isNull(), "removed").when(F.col("a_hlc").isNull(), "added").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "changed").when(F.col("a_hlc") != F.col("b_hlc"), "touched")
    return both.withColumn("kind", kind).where("kind is not null")


def first(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first place, in key order over the shorter one's length, where key, value or clock differ; no row if none."""
    x = ordered.rank(a.select("key", "value", "hlc"), ["key"])
    y = ordered.rank(b.select("key", "value", "hlc"), ["key"])
    y = y.select("rank", F.col("key").alias("b_key"), F.col("value").alias("b_value"), F.col("hlc").alias("b_hlc"))
    both = x.join(y, "rank").withColumn("what", F.when(F.col("key") != F.col("b_key"), "key").when(~F.col("value").eqNullSafe(F.col("b_value")), "value").when(F.col("hlc") != F.col("b_hlc"), "hlc"))
    return both.where("what is not null").orderBy("rank").limit(1).select("rank", "what", F.col("key").alias("a_key"), "b_key")


def first_message(a: DataFrame, b: DataFrame) -> str:
    """The comparison as one line of text; empty when both are the same object."""
    if a is b:
        return ""
    n, m = a.count(), b.count()
    if not n or not m:
        return "" if n == m else f"one side is empty: ({n}, {m}) keys"
    row = first(a, b).first()
    if row is None:
        return f"no diff seen after {min(n, m)} keys of ({n}, {m})"
    return f"{row.what} differs at {row['rank']}: {row.a_key!r} and {row.b_key!r}"
