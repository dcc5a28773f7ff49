"""Ordered scans. Each returns rows with `rank`, their place in the order of the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ordered


def ascend(live: DataFrame, pivot: str = "") -> DataFrame:
    return ordered.rank(live.where(F.col("key") >= pivot) if pivot else live, ["key"])


def descend(live: DataFrame, pivot: str = "") -> DataFrame:
    return ordered.rank(live.where(F.col("key") <= pivot) if pivot else live, ["key"], descending=True)


def between(at_least: str, below: str) -> Column:
    low = F.col("key") >= at_least if at_least else F.lit(True)
    return low & (F.col("key") < below) if below else low


def ascend_range(live: DataFrame, at_least: str = "", below: str = "") -> DataFrame:
    return ordered.rank(live.where(between(at_least, below)), ["key"])


def descend_range(live: DataFrame, at_most: str = "", above: str = "") -> DataFrame:
    rows = live.where(F.col("key") <= at_most) if at_most else live
    return ordered.rank(rows.where(F.col("key") > above) if above else rows, ["key"], descending=True)


def first_n(live: DataFrame, n: int, pivot: str = "") -> DataFrame:
    """A top-n in key order, not a sort of everything."""
    rows = (live.where(F.col("key") >= pivot) if pivot else live).orderBy("key").limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("key")).cast("long"))  # n rows


def take_while(live: DataFrame, keep: Column) -> DataFrame:
    """Rows in key order up to the first that fails: those below the smallest failing key."""
    stop = live.where(~keep).agg(F.min("key").alias("_stop"))
    return live.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("key") < F.col("_stop"))).drop("_stop")  # one row


def neighbours(live: DataFrame) -> DataFrame:
    """Each row with the key before and after it (null at the ends)."""
    ranked = ordered.rank(live, ["key"])
    # a row and its neighbours meet under their own ranks: one aggregation instead of two joins
    near = ranked.select(F.explode(F.array(*[F.struct((F.col("rank") + d).alias("at"), F.lit(d).alias("from"), *[F.when(F.lit(d == 0), F.col(c)).alias(c) for c in ranked.columns if c != "key"], "key") for d in (-1, 0, 1)])).alias("x")).select("x.*")
    own = [c for c in ranked.columns if c != "key"]
    rows = near.groupBy("at").agg(F.max_by("key", F.when(F.col("from") == 0, 0)).alias("key"), *[F.max_by(c, F.when(F.col("from") == 0, 0)).alias(c) for c in own], F.max(F.when(F.col("from") == 1, F.col("key"))).alias("prev_key"), F.max(F.when(F.col("from") == -1, F.col("key"))).alias("next_key"))
    return rows.where("rank is not null").select(*ranked.columns, "prev_key", "next_key")


#: Rows that a block of a short scan holds at most.
SCAN_BLOCK = 64


def short_scans(live: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """For each probe (key, ...): the first n rows at or above it, by rank: the start's rank plus 0..n-1.

    live may come with its ranks. Rows are met in blocks of neighbours, so that a probe is joined with the few blocks that
    hold its rows, not with each of them.
    """
    ranked = live if "rank" in live.columns else ordered.rank(live, ["key"])
    size = min(n, SCAN_BLOCK)
    hits = ranked.select("key", F.struct("rank").alias("hit"))
    start = ordered.nearest(hits, probes, False, False).where("hit is not null")
    block = lambda rank: F.floor((rank - 1) / size).cast("long")
    rows = F.array_sort(F.collect_list(F.struct("rank", *[c for c in ranked.columns if c != "rank"]))).alias("_rows")
    blocks = ranked.groupBy(block(F.col("rank")).alias("_block")).agg(rows)
    first = F.col("hit.rank")
    asked = start.select(F.col("key").alias("probe"), *[c for c in probes.columns if c != "key"], first.alias("_start"), F.explode(F.sequence(block(first), block(first + n - 1))).alias("_block"))
    at = F.col("_start") - F.col("_block") * size  # the start's place in the block, from 1
    low, high = F.greatest(at, F.lit(1)), F.least(at + n - 1, F.lit(size))
    met = asked.join(blocks, "_block").select(*[c for c in asked.columns if c != "_block"], F.explode(F.slice("_rows", low.cast("int"), (high - low + 1).cast("int"))).alias("_row"))
    return met.select("probe", *[c for c in probes.columns if c != "key"], (F.col("_row.rank") - F.col("_start")).cast("int").alias("step"), *[f"_row.{c}" for c in ranked.columns if c != "rank"])


def cursor(df: DataFrame):
    """The cursor interface: rows of an ordered result one by one on the driver, a partition at a time."""
    columns = [c for c in df.columns if c != "rank"]
    return (tuple(r[c] for c in columns) for r in df.orderBy("rank").toLocalIterator())
