"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and grouping.

Signature. Every element (a hashed word shingle) draws a random permutation of the slots one step at a time; its step k
offers slot p[k] the value k + u. A slot keeps its smallest offer. Later steps offer larger values only, so a document
is finished as soon as every slot has an offer: large documents after a step or two, small ones later. Ranks of one
element differ in all slots, which lowers the variance against independent permutations.

Grouping. Documents with one set are one class, held by its smallest id. Classes that share a band are candidates:
first every class is compared with the smallest class of each of its buckets, on the full sets, and linked classes are
joined; then, in buckets that still hold classes of several components, every class outside the bucket's largest
component is compared with all classes of other components. A bitmap of each set tells, without error, most pairs that
can't be similar enough: every bit that one set has and the other lacks is an element that isn't shared. No bucket is capped and pairs inside one component are
never made, so large groups of copies cost a comparison per member and band, not per pair.

Nulls, empty texts: the empty set, linked with nothing. Fewer words than the shingle: the whole sequence is one shingle.
Repeated rows (equal doc_id) give repeated rows; ids stand for one text, so rows with one id should not differ in text.
A null doc_id is in no group. An empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

U = np.uint64
MAX = U(2**64 - 1)
#: Bits of a shingle's hash; the bits above number the texts of a slice.
HASH_BITS = 53
GOLD = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """similarity in hundredths. bands x rows slots: at 0.85, 24 x 5 miss a pair with probability 8e-7."""

    similarity: int = 85
    shingle: int = 5
    bands: int = 24
    rows: int = 5
    bloom_bits: int = 1 << 26
    sketch_longs: int = 32
    block: int = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Per slice of texts: (first text, sorted distinct hashes of all its texts, where each text's begin)."""
    for a, b in _small_slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        h, counts = words.hashed_words(data[offsets[a] : offsets[b]], at)
        ends = np.cumsum(counts)
        text = np.repeat(np.arange(b - a), counts)
        n = len(h)
        combined = np.zeros(n, U)
        if n >= k:
            s = h[: n - k + 1].copy()
            for i in range(1, k):
                s = (s ^ (s >> U(29))) * U(0xFF51AFD7ED558CCD) + h[i : n - k + 1 + i]
            combined[: n - k + 1] = words.mix(s)
        whole = np.arange(n) + k <= ends[text] if n else np.zeros(0, bool)
        for t in np.flatnonzero((counts > 0) & (counts < k)):  # a short text is one shingle
            first = int(ends[t] - counts[t])
            s = U(int(counts[t]))
            with np.errstate(over="ignore"):
                for x in h[first : int(ends[t])]:
                    s = (s ^ (s >> U(31))) * U(0xC4CEB9FE1A85EC53) + x
            combined[first], whole[first] = words.mix(np.array([s]))[0], True
        keys = np.sort((text[whole].astype(U) << U(HASH_BITS)) | (combined[whole] >> U(64 - HASH_BITS)))
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        starts = np.searchsorted(keys, np.arange(b - a + 1, dtype=U) << U(HASH_BITS))
        yield a, keys & U((1 << HASH_BITS) - 1), starts


def _small_slices(offsets: np.ndarray):
    for a, b in words.slices(offsets):
        for x in range(a, b, 1 << (64 - HASH_BITS)):
            yield x, min(b, x + (1 << (64 - HASH_BITS)))


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set: a row of slots for each; rank in the high half of a value, fraction in the low one."""
    n = len(starts) - 1
    out = np.full(n * slots, MAX, U)
    owner = np.repeat(np.arange(n), np.diff(starts))
    seed = words.mix(elements + GOLD)
    z = words.mix(seed + GOLD)
    j = ((z >> U(32)) * U(slots) >> U(32)).astype(np.int64)
    np.minimum.at(out, owner * slots + j, z & U(0xFFFFFFFF))
    open_ = (out.reshape(n, slots) == MAX).any(axis=1) & (np.diff(starts) > 0)
    keep = open_[owner]
    owner, seed, j = owner[keep], seed[keep], j[keep]
    for lo in range(0, len(owner), 1 << 17):  # permutations take slots x 2 bytes an element
        hi = min(len(owner), lo + (1 << 17))
        _later_steps(out, owner[lo:hi], seed[lo:hi], j[lo:hi], slots)
    return out.reshape(n, slots)


def _later_steps(out, owner, seed, j, slots) -> None:
    table = out.reshape(-1, slots)
    perm = np.tile(np.arange(slots, dtype=np.int16), (len(owner), 1))
    rows = np.arange(len(owner))
    perm[rows, j], perm[rows, 0] = 0, j
    for k in range(1, slots):
        z = words.mix(seed + U((k + 1) * int(GOLD) % 2**64))
        j = k + ((z >> U(32)) * U(slots - k) >> U(32)).astype(np.int64)
        slot = perm[rows, j]
        perm[rows, j] = perm[rows, k]
        np.minimum.at(out, owner * slots + slot, (z & U(0xFFFFFFFF)) | U(k << 32))
        # a text split over two calls may stop in each only when this call's own steps can't lower a slot any more
        done = (table[owner] < U((k + 1) << 32)).all(axis=1) if k < 4 or k % 4 == 0 else None
        if done is not None and done.mean() > 0.2:
            keep = ~done
            owner, seed, perm = owner[keep], seed[keep], perm[keep]
            rows = np.arange(len(owner))
        if not len(owner):
            break


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signature_batches(params: Params):
    slots = params.bands * params.rows

    def run(batches):
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            n = batch.num_rows
            sizes, fp = np.zeros(n, np.int64), np.zeros((n, 2), U)
            bands = np.zeros((n, params.bands), U)
            sketch = np.zeros((n, params.sketch_longs), U)
            for a, elements, starts in shingle_sets(data, offsets, params.shingle):
                own = np.diff(starts)
                b = a + len(own)
                sizes[a:b] = own
                has = np.flatnonzero(own > 0)
                if not len(has):
                    continue
                at = starts[:-1][has]
                fp[a + has, 0] = np.add.reduceat(words.mix(elements + U(1)), at)
                fp[a + has, 1] = np.bitwise_xor.reduceat(words.mix(elements ^ GOLD), at)
                sig = signatures(elements, starts, slots).reshape(len(own), params.bands, params.rows)
                s = np.broadcast_to(np.arange(1, params.bands + 1, dtype=U) * GOLD, (len(own), params.bands)).copy()
                for r in range(params.rows):
                    s = words.mix(s + sig[:, :, r])
                bands[a:b] = s
                bit = words.mix(elements + U(7)) % U(params.sketch_longs * 64)
                cell = (a + np.repeat(np.arange(len(own)), own)) * params.sketch_longs + (bit >> U(6)).astype(np.int64)
                np.bitwise_or.at(sketch.reshape(-1), cell, U(1) << (bit & U(63)))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(_signed(x).reshape(-1))) for x in (bands, sketch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(_signed(fp[:, 0])), pa.array(_signed(fp[:, 1])), *lists],
                ["doc_id", "n_shingles", "fp_a", "fp_b", "bands", "sketch"],
            )

    return run


def _set_batches(params: Params, bloom):
    def run(batches):
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            cell = words.mix(ids.astype(np.int64).view(U)) & U(params.bloom_bits - 1)
            hit = (bits[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8)) & 1
            chosen = batch.filter(pa.array(hit.astype(bool)))
            data, offsets = words.buffers(chosen.column("text"))
            for a, elements, starts in shingle_sets(data, offsets, params.shingle):
                own = np.diff(starts)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(elements)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([chosen.column("doc_id").slice(a, len(own)), pa.array(own.astype(np.int64)), packed], ["doc_id", "n", "elements"])

    return run


def _verify_batches(similarity: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(v[i].as_buffer(), U) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _bloom(ids: DataFrame, params: Params):
    """A bit array of fixed size over the ids; the driver gets at most bloom_bits / 64 rows however many ids there are."""

    def cells(batches):
        for batch in batches:
            v = words.mix(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(U)) & U(params.bloom_bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((v >> U(6)).astype(np.int64)), pa.array(_signed(U(1) << (v & U(63))))], ["word", "bits"])

    got = ids.mapInArrow(cells, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(params.bloom_bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.tobytes())


def _verified(pairs: DataFrame, docs: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sets are made again for documents in pairs only."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bloom = _bloom(ids, params)
    sets = docs.where("doc_id is not null").mapInArrow(_set_batches(params, bloom), "doc_id long, n long, elements binary")
    sets = sets.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = shared.cut(sets, "sets")
    sets = sets.groupBy("doc_id").agg(F.first("elements").alias("elements"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("set_b")), "b")
    return shared.cut(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify_batches(params.similarity), "a long, b long"), "links")


def _crossing(own: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that their bitmaps allow, each from its first shared band.

    A bucket is dealt into blocks of about `block` members against blocks of about `block` members outside its largest
    component, so a task never holds a whole bucket; comparisons are in numpy, and only what is left becomes rows.
    """
    blocks = F.ceil(F.col("size") / params.block).cast("int")
    own = own.withColumn("_n", blocks).withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    row = "concat(transform(sequence(0, _n - 1), i -> struct(i as i, _k as j, false as minor)), if(component <> largest, transform(sequence(0, _n - 1), j -> struct(_k as i, j as j, true as minor)), array()))"
    dealt = own.withColumn("_at", F.explode(F.expr(row))).select("band", "bucket", "_at.i", "_at.j", "_at.minor", "id", "n", "component", "head", "bands", "sketch")
    key = ["band", "bucket", "i", "j"]
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = params.similarity

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([table[k].to_numpy().astype(np.int64) for k in key])
            cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)), [table.num_rows]])
            yield from groups(table, cuts[:-1])
            rest = table.slice(int(cuts[-2])) if len(cuts) > 1 else None
        if rest is not None and rest.num_rows:
            yield from groups(rest, np.array([0, rest.num_rows]))

    def groups(table, cuts):
        if len(cuts) < 2:
            return
        ids, sizes, component, head, band = (table[k].to_numpy() for k in ("id", "n", "component", "head", "band"))
        minor = table["minor"].to_numpy()
        bands, sketch = (table[k].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for k in ("bands", "sketch"))
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            o = lo + np.flatnonzero(~minor[lo:hi])
            for m in (lo + np.flatnonzero(minor[lo:hi])).tolist():
                c = o[(component[o] != component[m]) & (head[o] != ids[o]) & (head[o] != ids[m]) & (100 * np.minimum(sizes[o], sizes[m]) >= s * np.maximum(sizes[o], sizes[m]))]
                if len(c):
                    x, y = sketch[c], sketch[m]
                    most = np.minimum(sizes[c] - np.bitwise_count(x & ~y).sum(axis=1), sizes[m] - np.bitwise_count(y & ~x).sum(axis=1))
                    c = c[(100 + s) * most >= s * (sizes[c] + sizes[m])]
                if len(c):
                    c = c[(bands[c] == bands[m]).argmax(axis=1) == band[m]]
                    a.append(np.minimum(ids[c], ids[m]))
                    b.append(np.maximum(ids[c], ids[m]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = dealt.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id reachable. Labels jump along links and labels.

    A round takes, for each id, the smallest label among its neighbours and itself, then the label of that label; it
    ends when no label moves. Rounds grow with the logarithm of a group's width, and each is written down.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = shared.cut(edges, "edges")
    labels = shared.cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        # the label of each label: a label is an id of its own group
        step = labels.join(near, "id").select("id", "component", F.least("near", "component").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jumped"))
        step = shared.cut(step.join(jump, "next").select("id", "component", F.least("next", "jumped").alias("next")), "labels")
        moved = step.where("next <> component").limit(1).count()
        labels = step.select("id", F.col("next").alias("component"))
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs (doc_id, text)."""
    shared.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    sig = shared.cut(docs.mapInArrow(_signature_batches(params), "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>, sketch array<long>"), "signatures")
    classes = shared.cut(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("fp_a", "fp_b", "n_shingles").agg(F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("x")).select("fp_a", "fp_b", F.col("n_shingles").alias("n"), F.col("x.doc_id").alias("id"), F.col("x.bands").alias("bands"), F.col("x.sketch").alias("sketch")),
        "classes",
    )
    banded = classes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = banded.groupBy("band", "bucket").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = shared.cut(banded.join(heads, ["band", "bucket"]).select("id", "n", "band", "bucket", "head"), "buckets")
    s = params.similarity
    first = members.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(shared.cut(first, "pairs"), docs, params)
    found = components(links)
    own = members.join(found, "id", "left").select("id", "n", "band", "bucket", "head", F.coalesce("component", "id").alias("component"))
    mixed = own.groupBy("band", "bucket", "component").agg(F.count("*").alias("c")).groupBy("band", "bucket").agg(F.max_by("component", "c").alias("largest"), F.count("*").alias("parts"), F.sum("c").alias("size")).where("parts > 1").drop("parts")
    own = own.join(mixed, ["band", "bucket"]).join(classes.select("id", "bands", "sketch"), "id")
    second = shared.cut(_crossing(own, params), "pairs")
    if second.limit(1).count():
        links = shared.cut(links.union(_verified(second, docs, params)), "links")
        found = components(links)
    owners = classes.select("fp_a", "fp_b", F.col("n").alias("n_shingles"), "id").join(found, "id", "left").select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "id").alias("owner"))
    out = sig.drop("bands", "sketch").join(owners, ["fp_a", "fp_b", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("owner", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, params: Params = Params(similarity=80, bands=32)) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; all columns stay as they are."""
    drop = near_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("_near_copy")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_near_copy"], "left_anti")
