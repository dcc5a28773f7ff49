"""The hybrid logical clock in closed form.

A clock value has 48 bits of physical time (nanoseconds, rounded up to 2^16) above a 16-bit counter. The local rule
h' = max(pt, h + 1) over an ordered log is i + max over j <= i of (pt_j - j), a running maximum; receiving a foreign
value m only raises pt_j to m + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered

COUNTER = (1 << 16) - 1


def physical(micros: Column) -> Column:
    return (micros * 1000 + COUNTER).bitwiseAND(F.lit(~COUNTER))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def counter(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit(COUNTER))


def logical_time(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit(~COUNTER))


def assemble(time: Column, count: Column) -> Column:
    return logical_time(time) + counter(count)


def to_timestamp(hlc: Column, with_counter: bool = True) -> Column:
    value = hlc if with_counter else logical_time(hlc)
    return F.timestamp_micros(F.call_function("div", value, F.lit(1000).cast("long")))


def stamp(df: DataFrame, order: str, pt: str, received: str | None = None, start: int | None = None, out: str = "hlc") -> DataFrame:
    """Adds the clock value of each event, in the order of a unique column. start: the clock before the first event."""
    df = ordered.rank(df, [order], out="_i")
    floor = F.col(pt) if received is None else F.greatest(F.col(pt), F.coalesce(F.col(received) + 1, F.col(pt)))
    df = df.withColumn("_x", floor - F.col("_i"))
    df = ordered.running(df, [order], {"_m": ("max", "_x")})
    best = F.col("_m") if start is None else F.greatest(F.col("_m"), F.lit(start))
    return df.withColumn(out, F.col("_i") + best).drop("_i", "_x", "_m")
