"""Lines that are near copies of earlier lines, by an exact set-similarity join.

A line is the set of its words. Lines without a word are left alone. Lines with one set are a class, placed where it first
occurs (doc_id, then line number). Two classes are linked when 100 * |both| >= similarity * |either|. A line goes if its
class occurred before, or if an earlier class is linked with its class.

The join. Words get one global order, rare ones first: by the count of their hash bucket over all texts, then by hash; any
order is exact, and the buckets are a table of fixed size. In that order similar sets share a word among their first
|x| - ceil(s |x|) + 1 (the prefix), which is the join key. Where more than `heavy` classes have a word (by cells of a table
of fixed size) in their prefix, the key is that word with the one that both sets have next: it is among the words up to one
place behind the prefix. So tests in a key's group don't grow with the square of the corpus, as single words' do. The length filter, the positional filter (what can still be
shared after the places of the common word) and parities (how many words of a set have a bit, even or odd: each that
differs is a word that only one side has) refuse pairs without error. A set of fewer than s / (100 - s) words is linked with none.

Groups. The links of a group of near copies are as many as the square of its size, so no pair of it becomes a row. A
semi-join tells which classes have a candidate at all; a table of `filter_bits` bits keeps most other lines from being
read a second time (where it is full, all lines' texts are shuffled once). These classes are compared with `heads` classes
drawn by hash of each of their prefix words, then with candidates in other groups only, so that every two candidates are
of one group (`_groups`). A group is dealt into blocks
of `block` classes; a row holds two blocks, whose sets, made again from the texts, are compared inside the row. Counting
a group's links is still work in the square of its size, spread over tasks; memory is that of two blocks.
Classes, not lines, are joined, so a line that a third of all documents hold is one row; Spark may split any key.

Built-in functions only. A null text has no lines. Repeated rows (equal doc_id) count as later copies of each other's
lines by line number. Ties: of different sets that first occur at one place (repeated ids) none is earlier. A
null doc_id sorts first. Very long texts and lines are split and joined whole. An empty table gives no rows. Other columns
may have any name and are kept by `drop_repeats`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash, shared


@dataclass(frozen=True)
class Params:
    similarity: int = 80
    buckets: int = 1 << 14
    block: int = 256
    heads: int = 8
    filter_bits: int = 1 << 20
    heavy: int = 3000
    heavy_cells: int = 1 << 19


def _words(text: Column) -> Column:
    """The words of a text; single blanks split without a regular expression."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def _cells(rows: DataFrame, cell: Column, value: Column, size: int) -> np.ndarray:
    """A table of fixed size from one aggregated row for each cell."""
    got = rows.groupBy(cell.cast("int").alias("cell")).agg(value.alias("value")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def _ranks(docs: DataFrame, params: Params) -> np.ndarray:
    """The place of each hash bucket by its words over all texts."""
    words = docs.select(F.explode(_words(F.col("_text"))).alias("w"))
    counts = _cells(words, F.xxhash64("w").bitwiseAND(F.lit(params.buckets - 1)), F.count("*"), params.buckets)
    ranks = np.empty(params.buckets, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(params.buckets)
    return ranks


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("_text", "\n", -1)).alias("line", "_line"))


def _tokens(line: Column, ranks: np.ndarray, params: Params) -> Column:
    """A line's distinct words in the global order: each the rank of its bucket above the rest of its hash."""
    bits = params.buckets.bit_length() - 1
    table = shared.constant(ranks.tolist(), "bigint")

    def number(h: Column) -> Column:
        rank = F.coalesce(F.get(table, h.bitwiseAND(F.lit(params.buckets - 1)).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(rank, 63 - bits).bitwiseOR(F.shiftrightunsigned(h, bits + 1))

    return F.sort_array(F.array_distinct(F.transform(F.transform(_words(line), lambda w: F.xxhash64(w)), number)))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("_text"))


#: Sets of more words also have parities in four parts, by two more bits of a word's hash.
LONG = 64
PARTS = ("part0", "part1", "part2")


def _parities() -> list[Column]:
    flip = "aggregate(tokens, 0L, (a, t) -> {})"
    bit = "a ^ shiftleft(1L, cast(t & 63 as int))"
    parts = [F.expr(f"if(size(tokens) > {LONG}, {flip.format(f'if((t & 192) = {64 * i}, {bit}, a)')}, 0L)").alias(p) for i, p in enumerate(PARTS)]
    return [F.expr(flip.format(bit)).alias("parity"), *parts]


#: What names a class: where it first occurs, and the hash of its set.
CLASS = ("doc", "line", "id")


def _candidates(x: str, y: str, params: Params) -> Column:
    """May the classes of two prefix entries be linked?"""
    s = params.similarity
    c = lambda side, name: F.col(f"{side}.{name}")
    need = s * (c(x, "n") + c(y, "n"))
    return (
        (100 * F.least(c(x, "n"), c(y, "n")) >= s * F.greatest(c(x, "n"), c(y, "n")))
        & ((100 + s) * F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= need)
        & ((100 + s) * (c(x, "n") + c(y, "n") - F.bit_count(c(x, "parity").bitwiseXOR(c(y, "parity")))) >= 2 * need)
        & ((100 + s) * (c(x, "n") + c(y, "n") - _apart(lambda name: c(x, name), lambda name: c(y, name))) >= 2 * need)
    )


def _apart(x, y) -> Column:
    """Differing bits of the 256 parities of two long sets; the parity of all words is that of the four parts together."""
    parts = [F.bit_count(x(p).bitwiseXOR(y(p))) for p in PARTS]
    rest = [side("parity").bitwiseXOR(side("part0")).bitwiseXOR(side("part1")).bitwiseXOR(side("part2")) for side in (x, y)]
    return F.when((x("n") > LONG) & (y("n") > LONG), sum(parts, F.bit_count(rest[0].bitwiseXOR(rest[1])))).otherwise(0)


def _reach(n: Column, params: Params) -> Column:
    """How many words of a set of n are its prefix."""
    return (n - F.ceil(n * params.similarity / 100) + 1).cast("int")


def _folded(h: Column) -> Column:
    return h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _entries(classes: DataFrame, params: Params) -> DataFrame:
    """(id, n, parity, parts, pos, token): the join keys of each class; pos: so many words before what both may share, but one."""
    own = ("id", "n", "parity", *PARTS)
    single = F.slice("prefix", 1, _reach(F.col("n"), params))
    cell = F.xxhash64("word").bitwiseAND(F.lit(params.heavy_cells - 1))
    words = classes.select(F.explode(single).alias("word"))
    counts = words.groupBy(F.shiftright(cell, 6).cast("int").alias("at"), cell.bitwiseAND(F.lit(63)).cast("int").alias("bit")).agg(F.count("*").alias("c"))
    many = F.col("c") > params.heavy if params.similarity >= 67 else F.lit(False)  # from 67 on, linked sets share two words
    wanted = _cells(counts.where(many), F.col("at"), F.bit_or(F.expr("shiftleft(1L, bit)")), params.heavy_cells >> 6)
    bit = F.expr("shiftleft(1L, cast(xxhash64(word) & 63 as int))")
    heavy = F.get(shared.constant(wanted.tolist(), "bigint"), F.shiftright(cell, 6).cast("int")).bitwiseAND(bit) != 0
    light = classes.select(*own, F.posexplode(single).alias("pos", "word")).where(~heavy).select(*own, "pos", _folded(F.col("word")).alias("token"))
    pairs = classes.select(*own, "prefix", F.posexplode(single).alias("i", "word")).where(heavy)
    pairs = pairs.select(*own, "word", "i", F.posexplode(F.expr("slice(prefix, i + 2, size(prefix))")).alias("k", "next"))
    pairs = pairs.select(*own, (F.col("i") + F.col("k")).alias("pos"), _folded(F.xxhash64("word", "next")).alias("token"))
    # computed once: else the optimizer would join each side of the union by itself, and shuffle all twice
    return light.union(pairs).withColumn("token", shared.once(F.col("token")))


def _groups(entries: DataFrame, params: Params) -> tuple[DataFrame, list[DataFrame]]:
    """(id, component) of the classes that have a candidate; two candidates are in one component. Also the steps it reads.

    Here id alone names a class: two classes with one hash come into one group, where they are told apart again.
    """
    met = entries.alias("x").join(entries.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") != F.col("y.id")) & _candidates("x", "y", params), "left_semi")
    met = shared.cut(met, "contested")
    entry = F.struct("id", "n", "pos", "parity", *PARTS)
    drawn = met.groupBy("token").agg(F.array_distinct(F.array(*[F.min_by(entry, F.xxhash64("id", F.lit(k))) for k in range(params.heads)])).alias("hs"))
    heads = drawn.select("token", F.inline("hs"))
    near = met.alias("x").join(heads.alias("y"), "token").where((F.col("x.id") != F.col("y.id")) & _candidates("x", "y", params))
    links = shared.cut(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "near")
    found = minhash.components(links)
    own = met.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    own = shared.cut(own.join(mixed, "token", "left_semi"), "mixed")
    across = own.alias("x").join(own.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & _candidates("x", "y", params))
    across = shared.cut(across.select(F.col("x.component").alias("a"), F.col("y.component").alias("b")).distinct(), "across")
    if across.limit(1).count():
        found = minhash.components(links.union(across))
    return met.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), [met, links, own, across]


def _counted(members: DataFrame, params: Params) -> DataFrame:
    """(doc, line, id, links, late) of members (doc, line, id, component, tokens): links inside the components."""
    s = params.similarity
    size = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    dealt = members.join(size, "component").withColumn("blocks", F.ceil(F.col("size") / params.block).cast("int"))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    item = F.struct(*CLASS, F.size("tokens").alias("n"), *_parities(), "tokens")
    blocks = shared.cut(dealt.groupBy("component", "blocks", "k").agg(F.collect_list(item).alias("items")), "blocks")
    left = blocks.select("component", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    both = left.alias("x").join(blocks.alias("y"), ["component", "k"]).select(F.col("x.items").alias("xs"), F.col("y.items").alias("ys"))

    def linked(x, y):
        n = x.n + y.n
        close = 100 * F.least(x.n, y.n) >= s * F.greatest(x.n, y.n)
        possible = (100 + s) * (n - F.bit_count(x.parity.bitwiseXOR(y.parity))) >= 2 * s * n
        possible &= (100 + s) * (n - _apart(lambda c: x[c], lambda c: y[c])) >= 2 * s * n
        return close & possible & ((100 + s) * F.size(F.array_intersect(x.tokens, y.tokens)) >= s * n) & ((x.id != y.id) | (x.doc != y.doc) | (x.line != y.line))

    def counts(x):
        hits = F.transform(F.filter("ys", lambda y: linked(x, y)), lambda y: (y.doc < x.doc) | ((y.doc == x.doc) & (y.line < x.line)))
        return F.struct(*[x[c].alias(c) for c in CLASS], hits.alias("hits"))

    rows = both.select(F.inline(F.transform("xs", counts)))
    linked_ = shared.cut(rows.groupBy(*CLASS).agg(F.sum(F.size("hits")).alias("links"), F.bool_or(F.array_contains("hits", True)).alias("late")), "links")
    shared.discard(blocks)
    return linked_


def repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, line, class_id, n_links, removed) of every line with a word; n_links counts the linked classes."""
    docs = _prepared(docs)
    ranks = _ranks(docs, params)
    s = params.similarity
    table = _lines(docs).withColumn("tokens", shared.once(_tokens(F.col("_line"), ranks, params))).where(F.size("tokens") > 0)
    n = F.size("tokens")
    prefix = F.when(n >= s // (100 - s), F.slice("tokens", 1, _reach(n, params) + 1))  # and one word more
    table = table.select("doc_id", "line", F.xxhash64("tokens").alias("id"), F.hash("tokens").alias("check"), n.alias("n"), prefix.alias("prefix"), *_parities())
    table = shared.cut(table, "lines")
    key = ["id", "check", "n"]
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "line")
    classes = table.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("prefix", "parity", *PARTS)])
    classes = shared.cut(classes.select(*key, "first.*", "size", "prefix", "parity", *PARTS), "classes")
    shared.settle(docs.sparkSession)
    entries = _entries(classes, params)
    groups, steps = _groups(entries, params)
    grouped = shared.cut(classes.select("doc", "line", "id").join(groups, "id").select(*CLASS, "component"), "groups")
    for used in steps:
        shared.discard(used)
    shared.settle(docs.sparkSession)
    cell = F.xxhash64("doc", "line").bitwiseAND(F.lit(params.filter_bits - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(doc, line) & 63 as int))")
    wanted = _cells(grouped, F.shiftright(cell, 6), F.bit_or(bit), params.filter_bits >> 6)
    hit = F.get(shared.constant(wanted.tolist(), "bigint"), F.shiftright(cell, 6).cast("int")).bitwiseAND(bit) != 0
    some = _lines(docs).withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63)))).where(hit).drop("doc_id")
    some = some.join(grouped.withColumnRenamed("id", "_id"), ["doc", "line"])  # a line's text, before it is more than that
    some = some.select("doc", "line", "_id", "component", shared.once(_tokens(F.col("_line"), ranks, params)).alias("tokens")).withColumn("id", F.xxhash64("tokens"))
    sets = some.where("id = _id").groupBy(*CLASS, "component").agg(F.first("tokens").alias("tokens"))
    linked = _counted(sets, params)
    shared.discard(grouped)
    shared.settle(docs.sparkSession)
    notable = classes.select(*CLASS, "check", "n", "size").join(linked, list(CLASS), "left").where("size > 1 or links is not null")  # the other classes' lines stay
    notable = notable.select(*key, F.struct("doc", "line").alias("first"), "links", "late")
    out = table.select("doc_id", "line", *key).join(notable, key, "left")
    gone = F.coalesce("late", F.lit(False)) | F.coalesce(place != F.col("first"), F.lit(False))
    return out.select("doc_id", "line", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), gone.alias("removed"))


def by_document(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each document: its lines, how many go, their numbers, and the links of its lines' classes."""
    found = repeats(docs, params).where("removed or n_links > 0").groupBy("doc_id").agg(
        F.count_if("removed").alias("n_removed"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line")))), lambda x: x.cast("string")), ",").alias("removed_lines"),
        F.sum("n_links").alias("n_links"),
    )
    n_lines = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    rows = _prepared(docs).groupBy("doc_id").agg(F.sum(n_lines).cast("long").alias("n_lines"))
    joined = rows.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return joined.select("d.doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with the repeated lines cut out of text (n_chars follows); a document left without any word goes."""
    gone = repeats(docs, params).where("removed").groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    rows = docs.alias("d").join(gone.select(F.col("doc_id").alias("_id"), "_gone"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    rows = rows.withColumn("text", shared.once(F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))).drop("_gone")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
