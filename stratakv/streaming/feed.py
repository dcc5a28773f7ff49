"""The op-log as a stream: upserts into the latest state, with late writes losing to newer ones."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans import workers
from ..model import LOG


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Log files as they arrive; the path is any that Spark opens."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upserts(log: DataFrame) -> DataFrame:
    """Each key's winning operation whenever it changes; a lower clock than the state's is late and changes nothing."""

    workers.ship(log.sparkSession)
    def step(key, pdfs, state):
        best = state.get if state.exists else None
        old = best
        for pdf in pdfs:
            for r in pdf.itertuples():
                if best is None or (r.hlc, r.seq) > (best[2], best[3]):
                    best = (None if pd.isna(r.value) else r.value, bool(r.tomb), int(r.hlc), int(r.seq))
        if best is not None and best != old:
            state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", "value", "tomb", "hlc", "seq"])

    schema = "key string, value string, tomb boolean, hlc long, seq long"
    return log.groupBy("key").applyInPandasWithState(step, schema, "value string, tomb boolean, hlc long, seq long", "update", GroupStateTimeout.NoTimeout)


def into_store(log: DataFrame, db, checkpoint: str, seconds: int = 5):
    """Appends each micro-batch to a store as one version, every few seconds; a batch that runs again is committed once.

    Operations keep their clocks, so a late row loses to what the store already has.
    """

    def commit(df: DataFrame, batch_id: int) -> None:
        base = db.manifest()
        if batch_id in base.commits:
            return
        ops = df.select("key", "value", "tomb", df["seq"].alias("pos"), "hlc")
        db.apply(ops, replace(base, commits=(*base.commits[-100:], batch_id)))

    return log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def into_table(log: DataFrame, table: str, checkpoint: str):
    """Drains what is there into a memory table of upserts."""
    return upserts(log).writeStream.outputMode("update").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
