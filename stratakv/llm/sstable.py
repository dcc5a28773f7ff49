"""Token ids in sorted-string-table shards, keyed by document.

A shard holds the documents of one key range in ascending order. Its entries lie in blocks; within a block a key is
written as the length it shares with the key before and the bytes that differ, followed by the ids. After the blocks
come a sparse index (each block's first key, place and size), a Bloom filter over the keys, and a footer of fixed size
that says where both are. A lookup asks the filter, then searches the index by halves, and reads a single block.

Keys are doc_ids as eight big-endian bytes with the sign bit turned, so that bytes sort as numbers; a null doc_id has the
empty key and comes first. Equal keys stay side by side. A null text is empty: its end id alone. Shards are written under
a name of their own attempt and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, shared, words

MAGIC = b"STRATAS1"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, size; filter at, size; documents; ids; magic


@dataclass(frozen=True)
class Params:
    tokenizer: str
    end_id: int = 2
    block_bytes: int = 64 << 10
    bits_per_key: int = 10
    partition_bytes: int = 24 << 20
    fold: bool = False


def key_of(doc) -> bytes:
    return b"" if doc is None else struct.pack(">Q", (doc + (1 << 63)) & (2**64 - 1))


def doc_of(key: bytes):
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    HASHES = 7

    def __init__(self, bits: bytearray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int) -> Bloom:
        out = cls(bytearray((max(64, len(keys) * bits_per_key) + 7) // 8))
        for k in keys:
            for p in out._places(k):
                out.bits[p >> 3] |= 1 << (p & 7)
        return out

    def _places(self, key: bytes):
        h = words.hash_one(key) if key else 1
        a, b, n = h & 0xFFFFFFFF, h >> 32 | 1, len(self.bits) * 8
        return ((a + i * b) % n for i in range(self.HASHES))

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    def __init__(self, sink, params: Params):
        self.sink, self.p, self.at = sink, params, 0
        self.block, self.last, self.first = bytearray(), b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(self.block) >= self.p.block_bytes:
            self._flush()
        if self.first is None:
            self.first, self.last = key, b""
        shared_length = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        self.block += varint(shared_length) + varint(len(key) - shared_length) + varint(len(ids) << 1 | wide) + key[shared_length:]
        self.block += ids.astype("<u4" if wide else "<u2").tobytes()
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)

    def _flush(self) -> None:
        if self.first is None:
            return
        packed = struct.pack("<Q", len(self.block)) + pa.compress(bytes(self.block), codec="zstd", asbytes=True)
        self.sink.write(packed)
        self.index.append((self.first, self.at, len(packed)))
        self.at += len(packed)
        self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(size) for k, at, size in self.index)
        bloom = bytes(Bloom.of(self.keys, self.p.bits_per_key).bits)
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids, MAGIC))


class Reader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        i_at, i_size, b_at, b_size, self.documents, self.ids, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format, or not whole")
        data, at = source.read_at(i_size, i_at), 0
        self.index = []
        while at < i_size:
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, place, length))
        self.bloom = Bloom(bytearray(source.read_at(b_size, b_at)))

    def block(self, i: int):
        _, place, length = self.index[i]
        raw = self.source.read_at(length, place)
        data = pa.decompress(raw[8:], struct.unpack("<Q", raw[:8])[0], codec="zstd", asbytes=True)
        at, key = 0, b""
        while at < len(data):
            same, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key, at = key[:same] + data[at : at + rest], at + rest
            width = 4 if n & 1 else 2
            n >>= 1
            yield key, np.frombuffer(data, "<u4" if width == 4 else "<u2", n, at).astype(np.uint32)
            at += n * width

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(doc)
        if not self.bloom.may_hold(key):
            return []
        out = []
        i = max(0, bisect_left(self.index, key, key=lambda x: x[0]) - 1)
        while i < len(self.index) and self.index[i][0] <= key:
            out += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return out


def write(docs: DataFrame, folder: str, params: Params) -> DataFrame:
    """Write shards to folder (any file system that pyarrow opens); one row for each: path, first document, documents, ids."""
    shared.ship(docs.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        encoder = bpe.encoder(params.tokenizer, params.fold)
        end = np.array([params.end_id], np.uint32)
        part = TaskContext.get().partitionId()
        draft, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:06d}.sst"
        sink = writer = None
        for batch in batches:
            if writer is None:
                sink = store.open_output_stream(draft)
                writer = Writer(sink, params)
            names = batch.column("doc_id").to_pylist()
            for a, ids, bounds in encoder.encode(batch.column("text")):
                for i in range(len(bounds) - 1):
                    writer.add(key_of(names[a + i]), np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
        if writer is None or not writer.keys:
            return
        writer.close()
        sink.close()
        store.move(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x]) for x in (path, len(writer.keys), writer.ids))], ["part", "path", "documents", "ids"])

    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    # shards of about partition_bytes each, whatever the size of the table
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_plan_bytes(docs) // params.partition_bytes))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return shared.cut(ordered.mapInArrow(run, "part int, path string, documents long, ids long"), "shards")


def _plan_bytes(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 50)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of the shards in manifest: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                with store.open_input_file(path) as source:
                    for key, ids in Reader(source):
                        rows.append((doc_of(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each shard, a few bytes; the running sum over shards is small whatever the number of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    spread = based.select("path", "base").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, params: Params) -> DataFrame:
    """Write docs to the shared folder and return what the files hold."""
    where = shared.shared_dir(docs.sparkSession)
    folder = f"{where if '://' in where else 'file://' + where.removeprefix('file:')}/sst-{uuid.uuid4().hex}"
    return read(write(docs, folder, params), folder)
