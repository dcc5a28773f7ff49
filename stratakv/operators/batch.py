"""Atomic batches: order inside a batch, sub-batches, clock intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..plans import files, ordered, workers
from ..model import KVError, check_key


class Batch:
    """An ordered buffer of puts and deletes."""

    def __init__(self):
        self.ops: list[tuple[str, str | None, bool]] = []

    def set(self, key: str, value: str | None) -> Batch:
        self.ops.append((check_key(key), value, False))
        return self

    def delete(self, key: str) -> Batch:
        self.ops.append((check_key(key), None, True))
        return self

    def reset(self) -> None:
        self.ops = []

    def __len__(self) -> int:
        return len(self.ops)


def starts(ops: DataFrame) -> DataFrame:
    """Where sub-batches begin after a batch's first one: (batch_id, pos, sub_batch).

    One begins at the first operation whose key has been in the batch since the last begin. Only operations that repeat a
    key are walked, each as its place and the place before it; of a batch the walk holds the last begin and nothing else.
    """
    workers.ship(ops.sparkSession)
    before = F.lag("pos").over(Window.partitionBy("batch_id", "key").orderBy("pos"))
    repeats = ops.select("batch_id", "pos", before.alias("before")).where("before is not null").select("batch_id", "pos", "before")
    schema = T.StructType([*ops.select("batch_id", "pos").schema.fields, T.StructField("sub_batch", T.LongType())])

    def walk(batches):
        batch, begin, number = None, None, 0
        for pdf in batches:
            out = []
            for b, pos, last in zip(pdf["batch_id"].tolist(), pdf["pos"].tolist(), pdf["before"].tolist(), strict=True):
                if b != batch:
                    batch, begin, number = b, None, 0
                if begin is None or last >= begin:
                    begin, number = pos, number + 1
                    out.append((b, pos, number))
            yield pd.DataFrame(out, columns=["batch_id", "pos", "sub_batch"])

    return repeats.repartition("batch_id").sortWithinPartitions("batch_id", "pos").mapInPandas(walk, schema)


def sub_batches(ops: DataFrame) -> DataFrame:
    """Adds sub_batch (from 0) to operations (batch_id, pos, key, ...), batch_id an integer: a key that repeats starts a new one.

    Begins are kept as files and merged with the operations in order, in which batches and their numbers only grow.
    """
    base = F.col("batch_id").cast("long") * (1 << 32)
    marks = files.kept(starts(ops), "starts").select("batch_id", "pos", (base + F.col("sub_batch")).alias("_at"), F.lit(0).alias("_op"))
    both = ops.withColumn("_at", base).withColumn("_op", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    numbered = ordered.running(both, ["batch_id", "pos", "_op"], {"_upto": ("max", "_at")}, split=2)
    return numbered.where("_op = 1").select(*ops.columns, (F.col("_upto") - base).alias("sub_batch"))


def last_wins(ops: DataFrame) -> DataFrame:
    """The operation of each key that a batch leaves: the one with the largest pos."""
    return ops.groupBy("batch_id", "key").agg(F.max_by(F.struct("value", "tomb", "pos"), "pos").alias("x")).select("batch_id", "key", "x.value", "x.tomb", "x.pos")


def stamped(ops: DataFrame, pt: str, start: int = 0) -> DataFrame:
    """Adds sub_batch and hlc: one tick for each sub-batch, batches in the order of batch_id; pt is a column of ops."""
    ops = sub_batches(ops)
    return ops.join(ticks(ops, pt, start), ["batch_id", "sub_batch"])


def ticks(ops: DataFrame, pt: str, start: int = 0) -> DataFrame:
    """The tick of each sub-batch of operations that have theirs: (batch_id, sub_batch, hlc)."""
    found = ops.groupBy("batch_id", "sub_batch").agg(F.max(pt).alias("_pt"))
    found = files.kept(found.withColumn("_at", F.col("batch_id") * (1 << 32) + F.col("sub_batch")), "ticks")
    return clock.stamp(found, "_at", "_pt", start=start).select("batch_id", "sub_batch", "hlc")


def intervals(stamped_ops: DataFrame) -> DataFrame:
    """The half-open clock interval of each batch, from its operations or its ticks."""
    return stamped_ops.groupBy("batch_id").agg(F.min("hlc").alias("begin"), (F.max("hlc") + 1).alias("endx"))


def check(ops: DataFrame) -> None:
    if ops.where((F.col("key") == "") | F.col("key").isNull()).limit(1).count():
        raise KVError("the empty key can't be written")


def numbered(rows: DataFrame, by: list[str], batch: str) -> DataFrame:
    """Adds pos, the place of each row in its batch in the order of `by`."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(batch).orderBy(*by)).cast("long"))
