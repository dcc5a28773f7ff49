"""The data model: records, search modes, limits, errors and options."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntFlag

from pyspark.sql import types as T


class Mode(IntFlag):
    """Search modes and value flags; the numbers are part of the interface."""

    EXACT = 0
    GTE = 1
    LTE = 2
    GT = 3
    LT = 4
    SKIP_VALUES = 16
    LAZY_SMALL = 32
    LAZY_LARGE = 64
    LAZY = 96

    @property
    def search(self) -> Mode:
        return Mode(self & 7)


#: Values of more bytes than this are large and lie beside the log.
LARGE_BYTES = 64
#: A key and its overhead stay under a page.
MAX_KEY_BYTES = 4096 - 16
#: Extents end within blocks of this many bytes.
BLOCK_BYTES = 4 << 20
MAX_EXTENT_BYTES = 128 << 10

#: The append-only log of operations; a tombstone is never encoded as a null value.
LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
        T.StructField("tomb", T.BooleanType(), False),
        T.StructField("hlc", T.LongType(), False),
    ]
)
EXTENTS = T.StructType([T.StructField("ord", T.LongType()), T.StructField("len", T.LongType()), T.StructField("poff", T.LongType()), T.StructField("tag", T.IntegerType())])


class KVError(ValueError):
    """An operation that the contract forbids."""


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


def check_key(key: str) -> str:
    if key == "":
        raise KVError("the empty key can't be written")
    if len(key.encode()) >= MAX_KEY_BYTES:
        raise KVError(f"a key has fewer than {MAX_KEY_BYTES} bytes")
    return key


@dataclass(frozen=True)
class Config:
    """Options. The caching and syncing ones are accepted and have no effect: files are immutable and Spark caches."""

    large_values: bool = True
    files: int | None = None
    compact_after: int = 64
    cache_mb: int = 32
    redo_log: bool = True
    fsync: bool = True
    gc_threshold: float = 0.50
