"""The extent algebra: an ordered partition of a logical byte space.

Extents are rows (ord, len, poff, tag); where one begins, loff, is the running sum of the lengths before it and is never
stored. A single operation is a rewrite of the table by column expressions; `apply` runs a sequence of operations on one
tree in memory, because each depends on the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_EXTENT_BYTES, KVError
from ..plans import ordered, workers

HOLE = 1 << 47
ADDRESS = HOLE - 1


@dataclass(frozen=True)
class Layout:
    """Where ranges of extents are cut, and what lies before each range: bytes, extents that have any, rows."""

    cuts: list
    bytes: list[int]
    ranks: list[int]
    first: int
    last: int
    rows: int

    @property
    def total(self) -> int:
        return self.bytes[-1]

    @property
    def dense(self) -> bool:
        """Are the ordinals 1, 2, 3, ... and no extent empty?"""
        return not self.rows or (self.first == 1 and self.last == self.rows == self.ranks[-1])

    def reached(self, low: int, high: int) -> list[int]:
        """The ranges that hold bytes of [low, high)."""
        return [r for r in range(len(self.cuts) + 1) if self.bytes[r] < high and self.bytes[r + 1] > low]


def layout(extents: DataFrame) -> Layout:
    cuts = ordered.bounds(extents, "ord")
    held = ordered.dealt(extents, "ord", cuts).groupBy("_range").agg(F.sum("len"), F.count_if(F.col("len") > 0), F.min("ord"), F.max("ord"), F.count("*")).collect()  # a row for each range
    sums = [[x or 0 for x in b] for b in ordered.before([r[:3] for r in held], ["sum", "sum"], len(cuts) + 1)]
    return Layout(cuts, [b[0] for b in sums], [b[1] for b in sums], min((r[3] for r in held), default=0), max((r[4] for r in held), default=0), sum(r[5] for r in held))


def _ranged(extents: DataFrame, at: Layout, low: int | None = None, high: int | None = None) -> DataFrame:
    """Adds loff and _rank, the place among extents with bytes, and the range; only ranges that hold bytes of [low, high) where these are given."""
    if low is not None:
        reached = at.reached(low, high)
        if not reached:
            extents = extents.limit(0)
        if reached and reached[0]:
            extents = extents.where(F.col("ord") >= at.cuts[reached[0] - 1])
        if reached and reached[-1] < len(at.cuts):
            extents = extents.where(F.col("ord") < at.cuts[reached[-1]])
    upto = Window.partitionBy("_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.parted(ordered.dealt(extents, "ord", at.cuts), at.cuts)
    rows = rows.withColumn("_end", F.sum("len").over(upto)).withColumn("_rank", F.sum((F.col("len") > 0).cast("long")).over(upto))
    begin = F.col("_end") - F.col("len") + ordered.carry(at.bytes[:-1], "long")
    return rows.withColumn("loff", begin).withColumn("_rank", F.col("_rank") + ordered.carry(at.ranks[:-1], "long")).drop("_end")


def placed(extents: DataFrame) -> DataFrame:
    """Adds loff."""
    return _ranged(extents, layout(extents)).select(*extents.columns, "loff")


def size(extents: DataFrame) -> int:
    return extents.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]


def _covering(extents: DataFrame, at: Layout, loff: int):
    """The extent that holds the byte at loff, or None; from the range it lies in."""
    rows = _ranged(extents, at, loff, loff + 1).where((F.col("loff") <= loff) & (F.col("loff") + F.col("len") > loff)).collect()  # one at most
    return rows[0] if rows else None


def _later(poff: int, n: int) -> int:
    """Where an extent's bytes from the n-th on lie; a hole has no place."""
    return poff if poff >= HOLE else poff + n


def _spliced(extents: DataFrame, at: Layout, first: int | None, last: int | None, place: int, new: list[tuple], gone: int) -> DataFrame:
    """Extents with those from ordinal `first` to `last` (None: the end) replaced by a few new ones (len, poff, tag), numbered anew.

    place is the first new one's ordinal, gone the number of those replaced. Where ordinals are places already, no row has
    to meet another.
    """
    rows = extents.select("ord", "len", "poff", "tag").where("len > 0")
    number = F.col("ord")
    if not at.dense:
        rows = _ranged(extents, at).where("len > 0").select("ord", "len", "poff", "tag", "_rank")
        number = F.col("_rank")
    if first is not None:
        behind = F.lit(False) if last is None else F.col("ord") > last
        rows = rows.where((F.col("ord") < first) | behind)
        number = number + F.when(behind, len(new) - gone).otherwise(0)
    rows = rows.select(number.cast("long").alias("ord"), "len", "poff", "tag")
    if not new:
        return rows
    return rows.union(extents.sparkSession.createDataFrame([(place + i, *e) for i, e in enumerate(new)], "ord long, len long, poff long, tag int"))


def insert(extents: DataFrame, loff: int, poff: int, length: int, tag: int = 0, max_extent: int = MAX_EXTENT_BYTES) -> DataFrame:
    """Puts an extent at loff: the one that covers loff is split, later ones move right; beyond the end a hole fills the gap."""
    if length > max_extent or length < 0:
        raise KVError("the extent is too long")
    if length == 0:
        return extents
    at = layout(extents)
    if loff >= at.total:
        gap, rows, n = loff - at.total, [], 0
        while gap > 0:
            n += 1
            rows.append((at.last + n, min(gap, max_extent), HOLE, 0))
            gap -= max_extent
        rows.append((at.last + n + 1, length, poff, tag))
        return extents.select("ord", "len", "poff", "tag").union(extents.sparkSession.createDataFrame(rows, "ord long, len long, poff long, tag int"))
    c = _covering(extents, at, loff)
    head = loff - c.loff
    left = [(head, c.poff, c.tag)] if head else []
    right = (c.len - head, _later(c.poff, head), 0 if head else c.tag)
    return _spliced(extents, at, c.ord, c.ord, c._rank, [*left, (length, poff, tag), right], 1)


def delete(extents: DataFrame, loff: int, length: int) -> DataFrame:
    """Removes [loff, loff + length); what follows moves left. An extent trimmed at its front loses its tag."""
    at = layout(extents)
    end = loff + length
    if loff < 0 or length < 0 or end > at.total:
        raise KVError("the range is outside the space")
    a, b = _covering(extents, at, loff), _covering(extents, at, end)
    if a is None:
        return _spliced(extents, at, None, None, 0, [], 0)
    left = [(loff - a.loff, a.poff, a.tag)] if loff > a.loff else []
    right = [(b.loff + b.len - end, _later(b.poff, end - b.loff), 0 if end > b.loff else b.tag)] if b else []
    return _spliced(extents, at, a.ord, b.ord if b else None, a._rank, [*left, *right], b._rank - a._rank + 1 if b else 0)


def delete_byte(extents: DataFrame, loff: int) -> DataFrame:
    return delete(extents, loff, 1)


def query(extents: DataFrame, loff: int, length: int) -> DataFrame:
    """The physical pieces of [loff, loff + length) in order; no rows when it is out of range."""
    at = layout(extents)
    end = loff + length
    rows = _ranged(extents, at, loff, max(end, loff + 1)).where((F.col("loff") < end) & (F.col("loff") + F.col("len") > loff))
    from_ = F.greatest(F.col("loff"), F.lit(loff))
    to = F.least(F.col("loff") + F.col("len"), F.lit(end))
    out = rows.select("ord", (F.col("poff") + from_ - F.col("loff")).alias("poff"), (to - from_).alias("len"))
    return out if end <= at.total else out.limit(0)


def _found(extents: DataFrame, at: Layout, probes: DataFrame) -> DataFrame:
    """probes (key, ...) with the extent (loff, len, poff, rank) that begins at or before the byte `key`.

    Extents tile the space, so each range of them begins with an extent at the range's first byte, and a byte's extent lies
    in the byte's range.
    """
    hits = _ranged(extents, at).where("len > 0").select(F.col("loff").alias("key"), F.struct("loff", "len", "poff", F.col("_rank").alias("rank")).alias("hit"))
    return ordered.nearest(hits, probes, True, False, sorted({b for b in at.bytes[1:-1] if 0 < b < at.total}))


def locate(extents: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (loff) with poff of that byte, -1 outside: a backward nearest search over extent starts."""
    found = _found(extents, layout(extents), probes.withColumn("key", F.col("loff").cast("long")))
    inside = F.col("loff") < F.col("hit.loff") + F.col("hit.len")
    return found.select("loff", F.when(inside, F.col("hit.poff") + F.col("loff") - F.col("hit.loff")).otherwise(-1).alias("poff"))


def set_tag(extents: DataFrame, loff: int, tag: int) -> DataFrame:
    """Tags the extent that begins at loff, splitting the one that covers it."""
    at = layout(extents)
    c = _covering(extents, at, loff)
    if c is None:
        return _spliced(extents, at, None, None, 0, [], 0)
    head = loff - c.loff
    left = [(head, c.poff, c.tag)] if head else []
    return _spliced(extents, at, c.ord, c.ord, c._rank, [*left, (c.len - head, _later(c.poff, head), tag)], 1)


def get_tag(extents: DataFrame, loff: int) -> DataFrame:
    return _ranged(extents, layout(extents), loff, loff + 1).where((F.col("loff") == loff) & (F.col("tag") != 0)).select("tag")


def merged(extents: DataFrame, max_extent: int = MAX_EXTENT_BYTES) -> DataFrame:
    """Runs of neighbours that continue each other in both spaces, untagged, as (ord, len, poff, tag, parts).

    A run is cut into groups that a maximal extent can hold: by where its bytes fall from the run's begin.
    """
    at = layout(extents)
    n = len(at.cuts) + 1
    ends = {r[0]: r[1] for r in ordered.dealt(extents, "ord", at.cuts).groupBy("_range").agg(F.max_by(F.col("poff") + F.col("len"), "ord")).collect()}  # a row for each range
    last = [None]
    for r in range(n - 1):
        last.append(ends.get(r, last[-1]))
    inside = Window.partitionBy("_part").orderBy("ord")
    rows = _ranged(extents, at).withColumn("_end", F.col("poff") + F.col("len"))
    previous = F.coalesce(F.lag("_end").over(inside), ordered.carry(last, "long"))
    joins = F.coalesce((F.col("tag") == 0) & (F.col("poff") < HOLE) & (previous == F.col("poff")), F.lit(False))
    rows = rows.withColumn("_new", F.when(joins, 0).otherwise(1).cast("long")).withColumn("_begin", F.when(F.col("_new") == 1, F.col("loff")))
    held = ordered.before(rows.groupBy("_range").agg(F.sum("_new"), F.max("_begin")).collect(), ["sum", "max"], n)[:-1]  # a row for each range
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_run", F.sum("_new").over(upto) + ordered.carry([b[0] or 0 for b in held], "long"))
    runs = runs.withColumn("_start", F.greatest(F.max("_begin").over(upto), ordered.carry([b[1] for b in held], "long")))
    runs = runs.withColumn("_group", F.floor((F.col("loff") + F.col("len") - F.col("_start") - 1) / max_extent))
    return runs.groupBy("_run", "_group").agg(F.min("ord").alias("ord"), F.sum("len").alias("len"), F.min_by("poff", "ord").alias("poff"), F.min_by("tag", "ord").alias("tag"), F.count("*").alias("parts")).drop("_run", "_group")


def fragments(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (id, loff, length) with the number of pieces and bytes each reads: from the ranks of its first and last extent."""
    at = layout(extents)
    inside = ranges.where((F.col("loff") >= 0) & (F.col("length") > 0) & (F.col("loff") + F.col("length") <= at.total))
    ends = F.explode(F.array(F.col("loff").cast("long"), (F.col("loff") + F.col("length") - 1).cast("long"))).alias("key")
    found = _found(extents, at, inside.select("id", "length", ends))
    pieces = (F.max("hit.rank") - F.min("hit.rank") + 1).alias("pieces")
    return found.groupBy("id").agg(pieces, F.max("length").alias("bytes"))


@dataclass
class Tree:
    """A list of extents [len, poff, tag] on which operations act in order: the reading of the rules, for sequences."""

    extents: list[list[int]]
    max_extent: int = MAX_EXTENT_BYTES

    @property
    def total(self) -> int:
        return sum(e[0] for e in self.extents)

    def _cut(self, loff: int) -> int:
        """Makes an extent begin at loff; its index."""
        at = 0
        for i, (n, poff, tag) in enumerate(self.extents):
            if at == loff:
                return i
            if at < loff < at + n:
                k = loff - at
                self.extents[i : i + 1] = [[k, poff, tag], [n - k, poff if poff >= HOLE else poff + k, 0]]
                return i + 1
            at += n
        return len(self.extents)

    def insert(self, loff: int, poff: int, n: int, tag: int = 0) -> int:
        if n > self.max_extent:
            return -1
        if n == 0:
            return 0
        while self.total < loff:
            self.extents.append([min(self.max_extent, loff - self.total), HOLE, 0])
        i = self._cut(loff)
        before = self.extents[i - 1] if i else None
        if tag == 0 and before and before[1] < HOLE and before[1] + before[0] == poff and before[0] + n <= self.max_extent:
            before[0] += n
        else:
            self.extents.insert(i, [n, poff, tag])
        return 0

    def delete(self, loff: int, n: int) -> int:
        if loff + n > self.total:
            return -1
        i, j = self._cut(loff), self._cut(loff + n)
        i = self._cut(loff)
        del self.extents[i:j]
        return 0

    def set_tag(self, loff: int, tag: int) -> int:
        if loff >= self.total:
            return -1
        self.extents[self._cut(loff)][2] = tag
        return 0

    def locate(self, loff: int) -> int:
        for n, poff, _ in self.extents:
            if loff < n:
                return poff + loff
            loff -= n
        return -1


def apply(ops: DataFrame, max_extent: int = MAX_EXTENT_BYTES) -> DataFrame:
    """Runs operations (tree, pos, op, loff, poff, len, tag) of many trees, each in order; the final extents of each."""

    workers.ship(ops.sparkSession)
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree([], max_extent)
        for r in pdf.sort_values("pos").itertuples():
            if r.op == "insert":
                tree.insert(int(r.loff), int(r.poff), int(r.len), int(r.tag))
            elif r.op == "delete":
                tree.delete(int(r.loff), int(r.len))
            elif r.op == "tag":
                tree.set_tag(int(r.loff), int(r.tag))
        return pd.DataFrame([(pdf["tree"].iloc[0], i + 1, *e) for i, e in enumerate(tree.extents)], columns=["tree", "ord", "len", "poff", "tag"])

    return ops.groupBy("tree").applyInPandas(run, "tree long, ord long, len long, poff long, tag int")
