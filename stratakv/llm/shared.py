"""What the corpus operators share: the folder for cut lineage, worker paths, and safe reading of input columns."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package; on a cluster without a shared file system install it or use --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset (tests on one machine), a temporary folder that is set there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="stratakv-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Spark deletes a job's shuffle files as soon as it ends; waiting for the driver's garbage collection kept them on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a `cut` that nothing reads any more."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)


def settle(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def once(value: Column) -> Column:
    """value, computed once for a row: the optimizer copies no such column into the expressions and filters that use it.

    Without this a column used inside a lambda can be put there whole, and then runs for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def constant(values, kind: str) -> Column:
    """An array column of one fixed-size table of numbers; the optimizer folds it into a single literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
