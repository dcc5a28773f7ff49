"""The versioned store.

A database is a folder of immutable Parquet files and a folder of manifests. A commit writes its files under a new name,
then creates manifest v{N+1} exclusively: whoever comes second fails with ConflictError, and a writer that dies before its
manifest leaves nothing visible. Readers pin a version. Large values lie in files of their own, by digest. A manifest
names the snapshot (compacted, sorted by key in key ranges) and the log files after it.

Paths are URIs that both Spark and pyarrow open, or local paths.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..model import Config, ConflictError, KVError, Mode, check_key
from ..operators import batch, diff, metrics, mutate, scan, search, values
from ..plans import ordered, visible

STORED = T.StructType([T.StructField(n, t) for n, t in (("seq", T.LongType()), ("key", T.StringType()), ("value", T.StringType()), ("tomb", T.BooleanType()), ("hlc", T.LongType()), ("vref", T.StringType()))])
VALUES = T.StructType([T.StructField("vref", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n_bytes", T.LongType())])


#: Schemes of stores besides local ones whose create is exclusive.
EXCLUSIVE = ("hdfs", "viewfs", "file")


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    hlc: int = 0
    seq: int = 0
    snapshot: str | None = None
    logs: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    logical_bytes: int = 0
    live_tombs: bool = False
    commits: tuple[int, ...] = field(default=())


class Database:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.store, self.root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        self.store.create_dir(f"{self.root}/_manifest", recursive=True)
        self.closed = False
        self.staged: Manifest | None = None  # what an atomic block has written so far
        self.start: Manifest | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config()) -> Database:
        return cls(spark, path, config)

    # manifests

    def versions(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/_manifest"))
        return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None and self.staged is not None:
            return self.staged
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        with self.store.open_input_file(f"{self.root}/_manifest/v{version}.json") as f:
            raw = json.loads(f.read())
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def _commit(self, new: Manifest) -> Manifest:
        if self.staged is not None:
            self.staged = replace(new, version=self.start.version + 1)
            return self.staged
        return self._publish(new)

    def _publish(self, new: Manifest) -> Manifest:
        path = f"{self.root}/_manifest/v{new.version}.json"
        draft = f"{self.root}/_manifest/.{uuid.uuid4().hex}"
        body = json.dumps(new.__dict__).encode()
        if isinstance(self.store, fs.LocalFileSystem):
            import os

            with self.store.open_output_stream(draft) as f:
                f.write(body)
            try:
                os.link(draft, path)  # fails if the name is taken, and shows the whole file or none
            except FileExistsError:
                raise ConflictError(f"version {new.version} is taken") from None
            finally:
                os.unlink(draft)
        else:
            self._create_exclusively(path, body)
        return new

    def _create_exclusively(self, path: str, body: bytes) -> None:
        """Through Hadoop's file system, whose create(overwrite = false) fails if the file is there (HDFS; a rename would not)."""
        jvm = self.spark._jvm
        name = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{path.rpartition('/')[2]}")
        if name.toUri().getScheme() not in EXCLUSIVE:
            raise KVError(f"a store on {name.toUri().getScheme()}:// can't create a manifest exclusively; open it for reading only")
        try:
            out = name.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(name, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"{path} is taken") from None
            raise
        out.write(bytearray(body))
        out.close()

    # writing

    def _uri(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def apply(self, ops: DataFrame, base: Manifest | None = None) -> Manifest:
        """Commits operations (key, value, tomb[, pos][, hlc]) as one version; they get one clock tick unless they carry theirs.

        An operation that carries an older clock than its key's last write is late: it is logged and never seen.
        """
        base = base or self.manifest()
        batch.check(ops)
        tick = max((time.time_ns() + 65535) & ~65535, base.hlc + 1)
        order = ["pos"] if "pos" in ops.columns else ["key"]
        ops = ordered.rank(ops, order, out="_r") if "pos" in ops.columns else ops.withColumn("_r", F.lit(1).cast("long"))
        clock = F.lit(tick) + F.col("_r") - 1 if "pos" in ops.columns else F.lit(tick)
        clock = F.coalesce(F.col("hlc"), clock) if "hlc" in ops.columns else clock
        stamped = ops.select((F.lit(base.seq) + F.col("_r")).alias("seq"), "key", "value", "tomb", clock.alias("hlc"))
        slim, large = values.split(stamped) if self.config.large_values else (stamped.withColumn("vref", F.lit(None).cast("string")), None)
        log = self._uri("log")
        slim.select(*STORED.names).write.parquet(log)
        written = self.spark.read.schema(STORED).parquet(log)
        stats = written.agg(F.count("*"), F.max("hlc"), F.max("seq"), F.count_if(F.col("vref").isNotNull()), F.coalesce(F.sum(scalar.n_bytes(F.col("key")) + F.coalesce(scalar.n_bytes(F.col("value")), F.lit(0))), F.lit(0))).first()
        if not stats[0]:
            return base
        kept = base.values
        if large is not None and stats[3]:
            folder = self._uri("values")
            large.select(*VALUES.names).write.parquet(folder)
            kept = (*kept, folder)
        return self._commit(replace(base, version=base.version + 1, hlc=max(base.hlc, stats[1]), seq=stats[2], logs=(*base.logs, log), values=kept, logical_bytes=base.logical_bytes + stats[4]))

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "pos long, key string, value string, tomb boolean")

    def put(self, key: str, value: str | None) -> Manifest:
        return self.apply(self._rows([(0, check_key(key), value, False)]))

    def delete(self, key: str) -> Manifest:
        return self.apply(self._rows([(0, check_key(key), None, True)]))

    def put_all(self, rows: DataFrame) -> Manifest:
        """Rows (key, value) with unique keys."""
        return self.apply(mutate.puts(rows))

    def commit(self, ops: batch.Batch) -> tuple[int, int]:
        """All of a batch or nothing; its half-open clock interval. The batch is empty afterwards."""
        if not len(ops):
            return (0, 0)
        before = self.manifest()
        after = self.apply(self._rows([(i, *op) for i, op in enumerate(ops.ops)]), before)
        ops.reset()
        low = self.spark.read.schema(STORED).parquet(after.logs[-1]).agg(F.min("hlc")).first()[0]
        return (low, after.hlc + 1)

    def delete_range(self, begin: str, end: str, begin_included: bool = True, end_included: bool = False, include_large: bool = True) -> tuple[int, bool]:
        if begin > end:
            raise KVError("the range ends before it begins")
        base = self.manifest()
        now = self.at()
        if include_large and mutate.covers_all(now.live, begin, end, begin_included, end_included):
            self._wipe(base)
            return (0, True)
        ops = mutate.delete_range(now.full(), begin, end, begin_included, end_included, include_large)
        n = ops.count()
        if n:
            self.apply(ops, base)
        return (n, False)

    def clear(self, include_large: bool = True) -> bool:
        base = self.manifest()
        if include_large:
            self._wipe(base)
            return True
        ops = mutate.clear(self.at().full(), False)
        if ops.limit(1).count():
            self.apply(ops, base)
        return False

    def _wipe(self, base: Manifest) -> None:
        self._commit(Manifest(version=base.version + 1, hlc=base.hlc, seq=base.seq))

    def merge(self, key: str, function) -> Manifest:
        check_key(key)
        base = self.manifest()
        row = self.at().get(key)
        new, write, delete = function(None if row is None else row.value, row is not None)
        if write and delete:
            raise KVError("a merge can't both write and delete")
        return self.apply(self._rows([(0, key, None if delete else new, bool(delete))]), base) if write or delete else base

    def sync(self) -> Manifest:
        """Compacts the log into a snapshot in key ranges, each sorted; tombstones and overwritten rows go."""
        base = self.manifest()
        if not base.logs:
            return base
        rows = self.at().slim.withColumn("tomb", F.lit(False))
        n = self.config.files or ordered.ranges(rows)
        folder = self._uri("snap")
        rows.select(*STORED.names).repartitionByRange(n, "key").sortWithinPartitions("key").write.parquet(folder)
        return self._commit(replace(base, version=base.version + 1, snapshot=folder, logs=()))

    def vacuum_values(self) -> dict:
        """Rewrites the referenced large values only."""
        if not self.config.large_values:
            raise KVError("large values are not kept apart")
        base, now = self.manifest(), self.at()
        stats = values.vacuum_stats(now.values, now.slim).first().asDict()
        if base.values:
            folder = self._uri("values")
            values.vacuum(now.values, now.slim).select(*VALUES.names).write.parquet(folder)
            self._commit(replace(base, version=base.version + 1, values=(folder,)))
        return stats

    def vacuum(self) -> dict:
        """Values first, then keys."""
        old = self.disk_bytes()
        stats = self.vacuum_values() if self.config.large_values else {}
        self.sync()
        return stats | {"old_disk_bytes": old, "new_disk_bytes": self.disk_bytes()}

    def disk_bytes(self) -> int:
        m = self.manifest()
        folders = [*([m.snapshot] if m.snapshot else []), *m.logs, *m.values]
        total = 0
        for f in folders:
            path = f if "://" not in f else fs.FileSystem.from_uri(f)[1]
            total += sum(x.size or 0 for x in self.store.get_file_info(fs.FileSelector(path)) if x.is_file)
        return total

    # reading

    def at(self, version: int | None = None) -> View:
        return View(self, self.manifest(version))

    @contextmanager
    def view(self):
        yield self.at()

    @contextmanager
    def update(self, atomic: bool = False):
        """Writes of the block are seen by its own reads; without atomic, those before an error stay.

        An atomic block stages its writes and publishes them as one version after the one that it began with. An error
        publishes nothing; a version that another writer published meanwhile makes it fail with ConflictError.
        """
        if not atomic:
            yield Update(self)
            return
        own = Database(self.spark, self.path, self.config)
        own.start = own.staged = own.manifest()
        yield Update(own)
        if own.staged != own.start:
            own._publish(own.staged)

    def metrics(self) -> dict:
        m, now = self.manifest(), self.at()
        big, small = metrics.big_small(now.full()).first()
        disk = self.disk_bytes()
        return {"version": m.version, "live": big + small, "big": big, "small": small, "logical_bytes": m.logical_bytes, "disk_bytes": disk, "space_amp": disk / m.logical_bytes if m.logical_bytes else 0.0, "hlc": m.hlc}

    def file_ranges(self) -> DataFrame:
        """(path, min_key, max_key, n) of the snapshot's files: the sparse index."""
        m = self.manifest()
        if not m.snapshot:
            return self.spark.createDataFrame([], "path string, min_key string, max_key string, n long")
        rows = self.spark.read.schema(STORED).parquet(m.snapshot).select("key", F.col("_metadata.file_path").alias("path"))
        return rows.groupBy("path").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"))

    def integrity(self) -> DataFrame:
        now = self.at()
        rows = now.slim.withColumn("tomb", F.lit(False))
        return metrics.integrity(rows, now.values, self.file_ranges())

    def diff(self, other: Database) -> str:
        return "" if other is self or other.path == self.path else diff.first_message(self.at().full(), other.at().full())

    def close(self) -> dict | None:
        if self.closed:
            return None
        self.closed = True
        return self.metrics()


class View:
    """The database at one version."""

    def __init__(self, db: Database, manifest: Manifest):
        self.db, self.m = db, manifest
        read = db.spark.read.schema(STORED)
        snapshot = read.parquet(manifest.snapshot) if manifest.snapshot else None
        delta = read.parquet(*manifest.logs) if manifest.logs else None
        if snapshot is None and delta is None:
            self.slim = db.spark.createDataFrame([], STORED).drop("tomb")
        elif delta is None:
            self.slim = snapshot.where("not tomb").drop("tomb")
        else:
            both = delta if snapshot is None else snapshot.unionByName(delta)
            won = both.groupBy("key").agg(F.max_by(F.struct("seq", "value", "tomb", "hlc", "vref"), F.struct("hlc", "seq")).alias("x"))
            self.slim = won.select("x.seq", "key", "x.value", "x.tomb", "x.hlc", "x.vref").where("not tomb").drop("tomb")
        self.values = db.spark.read.schema(VALUES).parquet(*manifest.values).dropDuplicates(["vref"]) if manifest.values else db.spark.createDataFrame([], VALUES)

    @property
    def live(self) -> DataFrame:
        """Keys and inline values; large ones are references."""
        return self.slim

    def full(self) -> DataFrame:
        """With large values joined in; the join is left out where there are none."""
        return values.resolve(self.slim, self.values) if self.m.values else self.slim.drop("vref")

    def get(self, key: str):
        rows = search.get(self.full(), key).collect()
        return rows[0] if rows else None

    def find(self, mode: Mode, key: str):
        live = self.full() if not mode & (Mode.SKIP_VALUES | Mode.LAZY_LARGE) else self.slim.withColumn("large", F.col("vref").isNotNull())
        order = F.col("key").desc() if mode.search in (Mode.LTE, Mode.LT) else F.col("key")
        rows = live.where(search.condition(mode, key)).orderBy(order).limit(1).withColumn("exact", F.col("key") == key).collect()
        return rows[0] if rows else None

    def fetch(self, row) -> str | None:
        """The value of a row that was found lazily."""
        if row.vref is None:
            return row.value
        return self.values.where(F.col("vref") == row.vref).first().value

    def ascend(self, pivot: str = "") -> DataFrame:
        return scan.ascend(self.full(), pivot)

    def descend(self, pivot: str = "") -> DataFrame:
        return scan.descend(self.full(), pivot)

    def ascend_range(self, at_least: str = "", below: str = "") -> DataFrame:
        return scan.ascend_range(self.full(), at_least, below)

    def descend_range(self, at_most: str = "", above: str = "") -> DataFrame:
        return scan.descend_range(self.full(), at_most, above)

    def __len__(self) -> int:
        return self.slim.count()


class Update:
    """Writes and reads of one update block; each write is a version of its own, made by this writer only."""

    def __init__(self, db: Database):
        self.db = db

    def __getattr__(self, name: str):
        return getattr(self.db if hasattr(self.db, name) and name in {"put", "delete", "put_all", "commit", "delete_range", "clear", "merge", "sync", "apply"} else self.db.at(), name)

    def __len__(self) -> int:
        return len(self.db.at())
