"""Op-logs over the test tables, and the probes and extents that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clock
from .plans import ordered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(prefix: str, n: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"))


def log(rows: DataFrame, micros: Column | None = None) -> DataFrame:
    """rows (seq, key, value, tomb) with the clock; without a timestamp seq counts milliseconds.

    Each millisecond is at least 15 ticks after the one before, so without a timestamp the clock is the time itself: the
    running maximum of pt_j - j is its last term, and no row has to meet another.
    """
    if micros is None:
        return rows.withColumn("hlc", clock.physical(F.col("seq") * 1000))
    return clock.stamp(rows.withColumn("pt", clock.physical(micros)), "seq", "pt").drop("pt")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """error deletes, view puts nil, the rest put props."""
    e = table(spark, folder, "events")
    rows = e.select(
        F.col("event_id").alias("seq"),
        numbered("u", F.col("user_id"), 6).alias("key"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("props")).alias("value"),
        (F.col("event_type") == "error").alias("tomb"),
        clock.physical(clock.micros(F.col("ts"))).alias("pt"),
        F.floor(F.col("value") * 100).cast("long").alias("amount"),
    )
    return clock.stamp(rows, "seq", "pt")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return log(d.select(F.col("doc_id").alias("seq"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("key"), F.col("text").alias("value"), F.lit(False).alias("tomb")))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return log(o.select(F.col("o_orderkey").alias("seq"), numbered("", F.col("o_orderkey"), 10).alias("key"), F.col("o_orderpriority").alias("value"), F.lit(False).alias("tomb")))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    return log(p.select(F.col("page_id").alias("seq"), F.col("url").alias("key"), F.col("html").alias("value"), F.lit(False).alias("tomb")))


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def line(spark: SparkSession, folder: str) -> DataFrame:
    """Batches with repeated keys: (batch_id, pos, seq, key, value, tomb)."""
    rows = ordered.rank(table(spark, folder, "lineitem").select(*LINE), LINE, out="seq")
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return rows.select((F.col("l_orderkey") % 97).alias("batch_id"), F.col("seq").alias("pos"), "seq", key.alias("key"), F.col("l_returnflag").alias("value"), F.lit(False).alias("tomb"))


def extents(spark: SparkSession, folder: str, placed: bool = True) -> DataFrame:
    """Extents in the order of the lines; ord is null where their places are not asked for."""
    rows = table(spark, folder, "lineitem").select(*LINE)
    rows = ordered.rank(rows, LINE, out="ord") if placed else rows.withColumn("ord", F.lit(None).cast("long"))
    return rows.select("ord", F.col("l_quantity").cast("long").alias("len"), (F.col("l_partkey") * 4096).alias("poff"), F.lit(0).alias("tag"))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(numbered("u", F.col("c_custkey"), 6).alias("key"))
