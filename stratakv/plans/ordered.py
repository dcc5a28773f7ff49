"""Ordering without one task: ranks, running values and nearest rows over range buckets.

A window without partitions moves every row to one task. Here rows are dealt into key ranges; windows run inside a range,
and what the ranges before it contribute is carried in from one row for each range. Range bounds come from a bounded
sample of keys, the ones whose hash is smallest, so the same data gives the same ranges. A row's range is found by bisection,
one compiled step a halving; ranges are named so that Spark's hash deals each to a partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 64


def ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounds(df: DataFrame, columns: str | list[str], n: int | None = None) -> list:
    """At most n - 1 key values that part df into ranges of similar size; tuples where several columns are the key."""
    n = n or ranges(df)
    if n == 1:
        return []
    names = [columns] if isinstance(columns, str) else columns
    keys = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]).dropna()
    sample = sorted(tuple(r) for r in keys.orderBy(F.xxhash64(*keys.columns)).limit(n * SAMPLE_PER_RANGE).collect())  # a fixed number
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    return [c[0] for c in cuts] if isinstance(columns, str) else cuts


def dealt(df: DataFrame, columns: str | list[str], cuts: list, out: str = "_range") -> DataFrame:
    """Adds how many cuts are not above the row's key; nulls in the first range."""
    df = df.withColumn(out, F.lit(0))
    if not cuts:
        return df
    keys = [(columns, F.lit(list(cuts)))] if isinstance(columns, str) else [(c, F.lit([cut[i] for cut in cuts])) for i, c in enumerate(columns)]
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        at, below = F.col(out) + (step - 1), None
        for c, values in reversed(keys):
            cut = F.get(values, at)  # null behind the last cut
            below = cut <= F.col(c) if below is None else (cut < F.col(c)) | ((cut == F.col(c)) & below)
        df = df.withColumn(out, F.col(out) + F.when(below, step).otherwise(0))
        step >>= 1
    return df


def _murmur3(i: int) -> int:
    """Spark's hash of an int."""
    word = 0xFFFFFFFF
    k = i * 0xCC9E2D51 & word
    k = ((k << 15 | k >> 17) & word) * 0x1B873593 & word
    h = 42 ^ k
    h = (((h << 13 | h >> 19) & word) * 5 + 0xE6546B64 & word) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & word
    h = (h ^ h >> 13) * 0xC2B2AE35 & word
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _names(count: int, partitions: int) -> list[int]:
    """A number for each range, such that hash partitioning deals the ranges evenly; they grow, so that sorted rows stay in order."""
    found: list[list[int]] = [[] for _ in range(partitions)]
    rounds, i = -(-count // partitions), 0
    while sum(min(len(f), rounds) for f in found) < rounds * partitions:
        found[_murmur3(i) % partitions].append(i)
        i += 1
    return sorted(found[r % partitions][r // partitions] for r in range(count))


def parted(df: DataFrame, cuts: list) -> DataFrame:
    """Adds _part, by which windows of a range are partitioned, to rows with _range."""
    return df.withColumn("_part", F.get(F.lit(_names(len(cuts) + 1, ranges(df))), F.col("_range")))


def before(rows: list, kinds: list[str], n: int) -> list[tuple]:
    """What the ranges before each of n ranges add up to (and, last, all of them), from rows (_range, value, ...) of those that have any."""
    found, so_far, out = {r[0]: r[1:] for r in rows}, [None] * len(kinds), []
    for at in range(n):
        out.append(tuple(so_far))
        for i, t in enumerate(found.get(at, ())):
            old = so_far[i]
            so_far[i] = old if t is None else t if old is None else old + t if kinds[i] == "sum" else max(old, t)
    return [*out, tuple(so_far)]


def carry(values: list, kind: str, place: Column | None = None) -> Column:
    """The value of the row's range."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_range") if place is None else place)


def rank(df: DataFrame, order: list[str], out: str = "rank", descending: bool = False) -> DataFrame:
    """Adds 1, 2, 3, ... in the order of the columns, which must make rows distinct."""
    n = F.lit(1).cast("long")
    return running(df.withColumn("_one", n), order, {out: ("sum", "_one")}, descending).drop("_one")


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, str]], descending: bool = False, split: int = 1) -> DataFrame:
    """Adds running sums or maxima ({out: (sum | max, column)}) in the order of the columns; the first `split` of them cut ranges.

    What each range adds, one number for each range, goes over the driver into the expression: the plan reads df once.
    """
    key = order[0] if split == 1 else order[:split]
    cuts = bounds(df, key)
    names = list(values)
    rows = dealt(df, key, cuts)
    if descending:
        rows = rows.withColumn("_range", len(cuts) - F.col("_range"))
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    upto = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": F.sum, "max": F.max}
    out = parted(rows, cuts).select("*", *[kinds[kind](c).over(upto).alias(f"_in_{name}") for name, (kind, c) in values.items()])
    if not cuts:
        return out.select(*df.columns, *[F.col(f"_in_{name}").alias(name) for name in values])
    totals = rows.groupBy("_range").agg(*[kinds[kind](c) for kind, c in values.values()]).collect()  # a row for each range
    earlier = before(totals, [kind for kind, _ in values.values()], len(cuts) + 1)[:-1]
    kind_of = dict(out.dtypes)
    final = {}
    for i, (name, (kind, _)) in enumerate(values.items()):
        own, held = F.col(f"_in_{name}"), carry([e[i] for e in earlier], kind_of[f"_in_{name}"])
        final[name] = own + F.coalesce(held, F.lit(0).cast(kind_of[f"_in_{name}"])) if kind == "sum" else F.greatest(own, held)
    return out.select(*df.columns, *[final[name].alias(name) for name in names])


def nearest(live: DataFrame, probes: DataFrame, backward: bool, strict: bool, cuts: list | None = None) -> DataFrame:
    """probes (key, ...) with the struct `hit` of the nearest row of live (key, hit): at or below the key, or at or above.

    The empty probe stands above all keys when searching backward and below all of them forward. Rows of both sides are
    merged in key order; no pair of rows is compared. cuts: keys of live, by which rows of both sides are dealt, for a
    search backward in which nothing lies before the first of them; else they come from a sample of both sides.
    """
    tiled = cuts is not None
    if not tiled:
        cuts = bounds(live.select("key").union(probes.select("key")), "key")
    extra = [c for c in probes.columns if c != "key"]
    live_first = backward != strict  # at equal keys, is the live row seen before the probe in key order
    topped = backward and dict(probes.dtypes)["key"] == "string"
    left = live.select("key", F.lit(False).alias("_top"), F.lit(0 if live_first else 1).alias("_side"), F.lit(False).alias("_probe"), "hit", *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    top = (F.col("key") == "") if topped else F.lit(False)
    right = probes.select("key", top.alias("_top"), F.lit(1 if live_first else 0).alias("_side"), F.lit(True).alias("_probe"), F.lit(None).cast(live.schema["hit"].dataType).alias("hit"), *extra)
    both = dealt(left.unionByName(right), "key", cuts)
    if topped:
        both = both.withColumn("_range", F.when(F.col("_top"), len(cuts)).otherwise(F.col("_range")))
    # forward is backward in the mirrored order: a frame that grows, row by row
    by = [F.col(c) if backward else F.col(c).desc() for c in (("_top", "key", "_side") if topped else ("key", "_side"))]
    span = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    found = parted(both, cuts).withColumn("_near", F.last("hit", ignorenulls=True).over(span)).where("_probe")
    if tiled or not cuts:
        return found.select("key", *extra, F.col("_near").alias("hit"))
    edge = dealt(live, "key", cuts).groupBy("_range").agg((F.max_by if backward else F.min_by)("hit", "key").alias("_edge"))
    spine = live.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_range"))
    edge = spine.join(edge, "_range", "left")
    over = Window.orderBy(F.col("_range") if backward else F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select("_range", F.last("_edge", ignorenulls=True).over(over).alias("_carried"))
    return found.join(F.broadcast(carried), "_range").select("key", *extra, F.coalesce("_near", "_carried").alias("hit"))
