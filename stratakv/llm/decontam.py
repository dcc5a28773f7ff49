"""Benchmark phrases in documents, found with an FM-index for each shard of documents.

A phrase is a window of 8 consecutive item words (an item of fewer words is one phrase). A shard is a run of documents
of one input partition, about a million indexed symbols. Words become symbols of the benchmark's own vocabulary; a word
outside it can be in no occurrence, so the indexed text keeps the runs of known words that are as long as the shortest
phrase, with separators between. That leaves out nothing that could match.

The index: a suffix array by prefix doubling gives the Burrows-Wheeler transform; a wavelet matrix over it gives ranks;
suffix positions are kept at run starts and every 16th position. Phrases are searched backwards, all at once; rows of
the found intervals walk left to a kept position. Their words are merged into spans.

The benchmark is read in blocks, and every shard is searched for each block. All blocks are made by the driver and
broadcast, so the benchmark has to fit into the driver and an executor; the documents don't. Nulls and empty texts have no words. Items with a null id or no words match nothing. Repeated rows
give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

U = np.uint64


@dataclass(frozen=True)
class Params:
    window: int = 8
    min_items: int = 2
    shard_bytes: int = 24 << 20
    shard_symbols: int = 1 << 20
    block_bytes: int = 16 << 20
    sample: int = 16


class FMIndex:
    """Over symbols 0..sigma-1, 0 separating runs; text begins and ends with 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(bwt, sigma)
        kept = (sa % sample == 0) | (bwt == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        self.positions = sa[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of symbols, the interval of suffixes that begin with them."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            live = np.flatnonzero(lo < hi)
            lo[live], hi[live] = (self.first[c[live]] + self.wavelet.rank(c[live], x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            at = rows[todo]
            kept = self.kept_before[at + 1] > self.kept_before[at]
            out[todo[kept]] = self.positions[self.kept_before[at[kept]]] + steps
            todo, at = todo[~kept], at[~kept]
            c = self.wavelet.access(at)
            rows[todo] = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class WaveletMatrix:
    """Bits of the symbols from the highest, each level stably parted by the one before; ones counted before each place."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.shifts = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.ones, self.zeros = [], []
        for s in self.shifts:
            bit = ((values >> s) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol stands before place upto."""
        begin, end = np.zeros(len(upto), np.int64), upto.astype(np.int64)
        for s, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            one = (symbol >> s) & 1 == 1
            b1, e1 = ones[begin], ones[end]
            begin = np.where(one, zeros + b1, begin - b1)
            end = np.where(one, zeros + e1, end - e1)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for s, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            before = ones[at]
            one = ones[at + 1] > before
            out |= one.astype(np.int64) << s
            at = np.where(one, zeros + before, at - before)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; separators (0) differ by place, so a suffix is settled at its run's end at the latest.

    Only groups of suffixes that are still equal are sorted again.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(zeros)
    key[zeros] = np.arange(len(zeros))
    sa = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)

    def settle(places: np.ndarray, slots: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give places (in order, at slots) the slot of their group's first; returns what is still tied."""
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[places] = head
        last = np.concatenate([new[1:], [True]])
        tied = ~(new & last)
        return places[tied], slots[tied]

    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    places, slots = settle(sa, np.arange(n), new)
    k = 1
    while len(places):
        one, two = rank[places], rank[places + k]
        order = np.lexsort((two, one))
        places, one, two = places[order], one[order], two[order]
        sa[slots] = places
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        places, slots = settle(places, slots, new)
        k *= 2
    return sa


class Block:
    """Phrases of some items: their words' hashes, and by phrase length the distinct phrases with their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        h, counts = words.hashed_words(*words.buffers(texts), words.ALNUM)
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(h)
        symbols = np.searchsorted(self.vocabulary, h) + 1
        by_length: dict[int, list[tuple[tuple, int]]] = {}
        at = 0
        for item, c in enumerate(counts):
            own = symbols[at : at + c].tolist()
            at += c
            for w in range(max(1, c - window + 1)) if c else ():
                p = tuple(own[w : w + window])
                by_length.setdefault(len(p), []).append((p, item))
        self.phrases = []
        for length, found in sorted(by_length.items()):
            number, of, item = {}, [], []
            for p, i in dict.fromkeys(found):
                of.append(number.setdefault(p, len(number)))
                item.append(i)
            order = np.argsort(of, kind="stable")
            of, item = np.array(of)[order], np.array(item)[order]
            self.phrases.append((length, np.array(list(number), np.int64), np.searchsorted(of, np.arange(len(number) + 1)), item))
        self.shortest = min(by_length, default=0)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary >> U(48)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.likely[(h >> U(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == h[maybe]
        out[maybe[known]] = at[known] + 1
        return out

    def occurrences(self, h: np.ndarray, text_of: np.ndarray, sample: int, limit: int):
        """Yields (starts in words, length, item pairs) for all occurrences in these words."""
        if not self.shortest or not len(h):
            return
        sym = self.symbols(h)
        known = sym > 0
        edge = np.concatenate([[True], text_of[1:] != text_of[:-1]])
        start = known & (edge | np.concatenate([[True], ~known[:-1]]))
        end = known & np.concatenate([edge[1:] | ~known[1:], [True]])
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        long = e - s >= self.shortest
        s, e = s[long], e[long]
        at = 0
        while at < len(s):  # an index over about limit symbols; one longer run makes one larger index
            sizes = np.cumsum(e[at:] - s[at:] + 1)
            upto = at + max(1, int(np.searchsorted(sizes, limit, "right")))
            yield from self._indexed(sym, s[at:upto], e[at:upto], sample)
            at = upto

    def _indexed(self, sym, s, e, sample):
        lengths = e - s
        begin = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.zeros(int(lengths.sum() + len(s) + 1), np.int64)
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where, word = np.repeat(begin, lengths) + inner, np.repeat(s, lengths) + inner
        text[where] = sym[word]
        word_at = np.zeros(len(text), np.int64)
        word_at[where] = word
        index = FMIndex(text, len(self.vocabulary) + 1, sample)
        for length, phrases, item_at, items in self.phrases:
            lo, hi = index.search(phrases)
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            rows = np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts, phrase = word_at[index.locate(rows)], np.repeat(hit, n)
            yield starts, length, phrase, item_at, items


def blocks_of(benchmark: DataFrame, params: Params) -> list[Block]:
    """The benchmark in blocks of at most block_bytes of text (a longer item makes a longer block)."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    out, items, size = [], [], 0
    for i, t in rows.toLocalIterator():
        if items and size + len(t) > params.block_bytes:
            out.append(Block(items, params.window))
            items, size = [], 0
        items.append((i, t))
        size += len(t)
    return [*out, Block(items, params.window)] if items else out


def _shard(batch_ids, texts, blocks, params: Params) -> pa.RecordBatch:
    data, offsets = words.buffers(texts)
    h, counts = words.hashed_words(data, offsets, words.ALNUM)
    n = len(counts)
    text_of = np.repeat(np.arange(n), counts)
    cover = np.zeros(len(h) + 1, np.int64)
    found: list[set] = [set() for _ in range(n)]
    full = np.zeros(n, bool)
    for block in blocks:
        block = block.value
        for starts, length, phrase, item_at, items in block.occurrences(h, text_of, params.sample, params.shard_symbols):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            pairs = np.unique(np.stack([text_of[starts], phrase]), axis=1) if len(starts) else np.zeros((2, 0), np.int64)
            for t, p in pairs.T.tolist():
                found[t].update(block.ids[i] for i in items[item_at[p] : item_at[p + 1]].tolist())
                full[t] |= length >= params.window
    hit = np.cumsum(cover)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(hit)])
    ends = np.cumsum(counts)
    n_hit = before[ends] - before[ends - counts]
    spans = [[] for _ in range(n)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for s, e in edges.reshape(-1, 2).tolist():
        while s < e:  # a stretch may go on into the next text
            t = int(text_of[s])
            stop = min(e, int(ends[t]))
            first = int(ends[t] - counts[t])
            spans[t].append([s - first, stop - first])
            s = stop
    lists = [sorted(x) for x in found]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
    size = np.array([len(x) for x in lists], np.int64)
    return pa.RecordBatch.from_arrays(
        [batch_ids, pa.array(counts), pa.array(n_hit), pa.array(size), pa.array(digest), pa.array(size >= params.min_items), pa.array(full), pa.array(lists, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "has_window", "items", "spans"],
    )


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, has_window boolean, items array<string>, spans array<array<long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """One row for each row of docs: counts, the found items and the word spans [from, to) to remove."""
    spark = docs.sparkSession
    shared.ship(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, params)]

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            texts.append(batch.column("text"))
            size += texts[-1].nbytes
            if size >= params.shard_bytes:
                yield _shard(pa.chunked_array(ids).combine_chunks(), pa.chunked_array(texts), blocks, params)
                ids, texts, size = [], [], 0
        if ids:
            yield _shard(pa.chunked_array(ids).combine_chunks(), pa.chunked_array(texts), blocks, params)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """docs without those that hold a whole phrase of `window` words of some item, or phrases of min_items items."""
    drop = contamination(docs, benchmark, params).where("has_window or contaminated").select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_leak"], "left_anti")
