"""A hierarchical Pitman-Yor language model, trained on and applied to all documents.

Restaurants. The root serves words; its base is uniform over the vocabulary and one unknown word. Every previous word has
a restaurant of its own whose parent is the root. A customer (c) of a context who opens a table (t) is a customer of the
root. With discount d and strength s, P(w|u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u), the root likewise.

Seating is sampled by Gibbs. A sweep seats each dish anew, all its customers at once and given all other dishes: who sits
where is summed out, and k tables have the probability ~ (weight of a new table)^k S(c, k), with generalized Stirling numbers
S. The root is seated likewise; its customers are the tables of the contexts. Dishes with more than `exact` (a power of two)
customers are seated in growing blocks, each with a binomial draw of new tables.

Distribution. A dish is a pair of a previous word and a word. All dishes of one word lie in one part (by the word's hash),
so the root's share of a word is local. What a part can't see, the restaurants' totals, stays as it was while a pass
samples; each pass takes the totals from the samples of the one before. The probability of a sample takes all its counts
and totals from that one sample, summed up after the pass, so every context's probabilities add up to 1; they are averaged
over the samples. Passes are written before they are used, so none is drawn twice.

Space. Pairs travel packed: a row holds the pairs of one chunk of documents for one part, words by their place in a list;
runs of a value and rising values are packed as such. To be scored, a chunk's documents are numbered; what a part gives to
them goes back as one row for the chunk, whose documents are summed up together. Documents are scored in `rounds`, each
with its own shuffles, so that what is on disk at once is a share of the texts' pairs. So do a part's contexts travel packed: a home, which some contexts have by hash,
gets a row from each part that has any of them, sums them up and sends each part the sums alone, in the order of the part's
own list. No row is empty, so there are never more rows than pairs. Texts are
split into words twice, for the model and for scoring, which is less than keeping them. A part's dishes are held by one
task, texts are not: to be scored they stream past the dishes, and a part with much more of them than others (a word that
a third of all tokens are) is dealt over several tasks, each with that part's dishes.

A null text is empty: one end token. A null doc_id belongs to the training side. Repeated rows count and score each.
Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, words

U = np.uint64
END = int(np.array([words.hash_one(b"\n")], U).view(np.int64)[0])  # no word holds a line feed
#: Tokens that a task gathers before it sends their pairs on, and about how many characters a token has.
CHUNK, CHARS = 2_000_000, 6


@dataclass(frozen=True)
class Params:
    strength: float = 1.0
    exact: int = 256
    passes: int = 3
    sweeps: int = 4
    samples: int = 3
    part_tokens: int = 1_500_000
    rounds: int = 2
    seed: int = 20240229


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """All token hashes, the end token after each text, and tokens per text."""
    h, counts = words.hashed_words(*words.buffers(texts))
    ends = np.cumsum(counts)
    out = np.insert(h, ends, np.int64(END).view(U))
    return out, counts + 1


def _rows(docs: DataFrame) -> DataFrame:
    text = shared.whole_text()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("held_out"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))


PLAIN, RISING, RUNS = 0, 1, 2


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as one compressed cell: forms, item sizes and lengths, then each column, equal places of its bytes
    together. Long runs of one value are a value and a length (the next column), rising values are differences."""
    coded = []
    for c in columns:
        starts = _starts(c)
        runs = 2 * len(starts) <= len(c) and len(c) > 0
        values = c[starts] if runs else c
        rising = len(values) > 1 and bool((values[1:] >= values[:-1]).all())
        coded.append((RUNS * runs + RISING * rising, np.diff(values, prepend=values.dtype.type(0)) if rising else values))
        if runs:
            coded.append((PLAIN, np.diff(starts, append=len(c)).astype(np.int32)))
    head = np.array([len(coded), *(x for form, c in coded for x in (form, c.itemsize, len(c)))], np.int32)
    body = (np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for _, c in coded)
    return zstandard.compress(head.tobytes() + b"".join(body), 1)


def unpack(cell: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(cell)
    n = int(np.frombuffer(data, np.int32, 1)[0])
    out, at, waits = [], 4 + 12 * n, False
    for form, size, length in np.frombuffer(data, np.int32, 3 * n, 4).reshape(-1, 3).tolist():
        planes = np.frombuffer(data, np.uint8, size * length, at).reshape(size, length)
        values = np.ascontiguousarray(planes.T).view(f"i{size}").reshape(-1)
        at += size * length
        if waits:
            out[-1] = np.repeat(out[-1], values)
        else:
            out.append(np.cumsum(values, dtype=values.dtype) if form & RISING else values)
        waits = bool(form & RUNS)
    return out


def _sorted(code: np.ndarray, low: np.ndarray, codes: int, lows: int) -> tuple[np.ndarray, np.ndarray]:
    """code and low, in order; both are under their bounds. One sort of plain numbers, where they fit into one."""
    bits = lows.bit_length()
    if codes << bits < 1 << 63:
        both = np.sort((code << bits) | low)
        return both >> bits, both & ((1 << bits) - 1)
    at = np.lexsort((low, code))
    return code[at], low[at]


def _chunk(w, sizes, train, keys, n_parts: int, scoring: bool):
    """(part, cell) of one chunk's tokens: of each pair of a part's words u, w and, for the model, how often it was
    seen in training, or, for scoring, how often and in which of the chunk's documents it stands. For scoring the first
    cell also has the documents' keys and sizes."""
    found = pc.dictionary_encode(pa.array(w))
    names = found.dictionary.to_numpy()
    order = np.argsort(names)
    names = names[order]
    part = (names >> 32) % n_parts
    dealt = np.argsort(part, kind="stable")  # by part, then by hash
    rank, place = np.empty_like(order), np.empty_like(order)
    rank[order] = place[dealt] = np.arange(len(order))
    word = rank[found.indices.to_numpy()]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = np.searchsorted(names, END)
    low = np.repeat(np.arange(len(sizes)) if scoring else 1 - train.astype(np.int64), sizes)
    code, low = _sorted(place[word] * len(names) + before, low, len(names) ** 2, max(2, len(sizes)))
    starts = _starts(code)
    ends = np.append(starts[1:], len(code))
    c = ends - starts if scoring else np.add.reduceat(1 - low, starts)
    code = code[starts]
    w, u = dealt[code // len(names)], code % len(names)
    cuts = _starts(part[w])
    for lo, hi in zip(cuts, [*cuts[1:], len(code)], strict=True):
        us, own = np.unique(u[lo:hi], return_inverse=True)
        columns = [names[w[lo:hi]], names[us], own.astype(np.int32), c[lo:hi].astype(np.int32)]
        if scoring:
            columns.append(low[starts[lo] : ends[hi - 1]].astype(np.int32))
            columns += [keys, sizes] if lo == 0 else []
        yield int(part[w[lo]]), pack(*columns)


def _slices(batch):
    """A batch in runs of whole documents, of about an eighth of a chunk each."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    piece = ends // (CHUNK * CHARS // 8)
    cuts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(piece)], strict=True):
        yield batch.slice(lo, hi - lo)


def _chunks(rows: DataFrame, n_parts: int, scoring: bool) -> DataFrame:
    """(part, chunk, cell): the pairs of each chunk of documents, dealt to the parts of their words. A chunk's name is made of
    its documents' keys: equal chunks have one."""

    def run(batches):
        held, size = [], 0
        for batch in (x for b in batches for x in _slices(b)):
            w, sizes = tokens(batch.column("text"))
            held.append((w.view(np.int64), sizes, ~batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)))
            size += len(w)
            if size > CHUNK:
                yield from rows_of(held)
                held, size = [], 0
        if size:
            yield from rows_of(held)

    def rows_of(held):
        w, sizes, train, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        chunk = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)
        for part, cell in _chunk(w, sizes, train, keys, n_parts, scoring):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([cell], pa.binary())], ["part", "chunk", "cell"])

    return rows.select("text", "held_out", "key").mapInArrow(run, "part int, chunk long, cell binary")


def _by_part(df: DataFrame, n_parts: int, schema: str, add, finish, by: tuple[str, ...] = ("part",)) -> DataFrame:
    """A part's rows come together, by kind: add(state, rows) may give batches, finish(part, state) ends the part."""

    def run(batches):
        state, part = {}, None
        for batch in batches:
            own = list(zip(*(batch.column(x).to_pylist() for x in by), strict=True))
            kinds = batch.column("kind").to_pylist()
            cuts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1] or kinds[i] != kinds[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if own[lo] != part:
                    if part:
                        yield from finish(part[0], state)
                    state, part = {}, own[lo]
                yield from add(state, kinds[lo], batch.slice(lo, hi - lo))
        if part:
            yield from finish(part[0], state)

    n = max(n_parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by).sortWithinPartitions(*by, "kind").mapInArrow(run, schema)


def seat_blocks(c: np.ndarray, opening: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables for dishes with many customers: seats are taken in blocks of a sixteenth of those already seated."""
    t = np.ones(len(c), np.float64)
    order = np.argsort(-c, kind="stable")
    sizes, seated = c[order], 1
    while len(sizes) and seated < sizes[0]:
        live = int(np.searchsorted(-sizes, -seated, "left"))
        block = np.minimum(max(1, seated // 16), sizes[:live] - seated)
        new = opening[order[:live]]
        t[order[:live]] += rng.binomial(block, np.clip(new / (new + seated - d * t[order[:live]]), 0, 1))
        seated += max(1, seated // 16)
    return t


@lru_cache(maxsize=4)
def stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of generalized Stirling numbers, [k, c]: how many seatings of c customers at k tables, by their weights:
    the next customer opens a table (weight 1) or sits down at one (its size less d)."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    k = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(n):
            s[:, c + 1] = np.where(k <= c, np.log(np.maximum(c - d * k, 0)) + s[:, c], -np.inf)
            s[1:, c + 1] = np.logaddexp(s[1:, c + 1], s[:-1, c])
    return s


class Seating:
    """Numbers of tables, t, of dishes with c customers: those with at most `exact` from their full conditional."""

    def __init__(self, c: np.ndarray, d: float, exact: int, rng):
        self.c, self.d, self.rng, self.numbers = c, d, rng, stirling(exact, d)
        self.t = np.minimum(c, 1).astype(np.float64)  # one customer has one table
        self.many = np.flatnonzero(c > exact)
        widths = [2**i for i in range(1, exact.bit_length())]
        self.some = [(w, np.flatnonzero((c > w // 2) & (c > 1) & (c <= w))) for w in widths]

    def sweep(self, opening: np.ndarray) -> None:
        """opening: (s + d t_u) P(w) of each dish, the weight of a new table."""
        for width, all_ in self.some:
            for lo in range(0, len(all_), max(1, 1_000_000 // width)):
                i = all_[lo : lo + max(1, 1_000_000 // width)]
                weight = self.numbers[1 : width + 1][:, self.c[i]] + np.arange(1, width + 1)[:, None] * np.log(opening[i])
                upto = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
                below = (upto <= self.rng.random(len(i)) * upto[-1]).sum(axis=0)
                self.t[i] = np.minimum(below + 1, self.c[i])
        if len(self.many):
            self.t[self.many] = seat_blocks(self.c[self.many], opening[self.many], self.d, self.rng)


class Part:
    """The dishes of one part, with their restaurants' totals, and the root's share of their words."""

    def __init__(self, w, c, tables, totals: dict, params: Params, rng):
        self.p, self.g, self.tables = params, totals, tables
        self.words, self.first, self.word = np.unique(w, return_index=True, return_inverse=True)
        self.rng = rng
        self._root(np.bincount(self.word, weights=c > 0, minlength=len(self.words)))
        self.leaf = Seating(c, totals["d1"], params.exact, rng)

    def _root(self, customers) -> None:
        """The tables of the root, whose customers are the contexts' tables."""
        g, s = self.g, self.p.strength
        base = (s + g["d0"] * g["t0"]) / (g["v"] + 1)
        self.root = Seating(customers.astype(np.int64), g["d0"], self.p.exact, self.rng)
        self.root.sweep(np.full(len(customers), base))
        self.parent = (self.root.c - g["d0"] * self.root.t + base) / (s + g["c0"])

    def _opening(self):
        return (self.p.strength + self.g["d1"] * self.tables) * self.parent[self.word]

    def sweep(self) -> None:
        self.leaf.sweep(self._opening())
        self._root(np.bincount(self.word, weights=self.leaf.t, minlength=len(self.words)))

    def sample(self) -> dict:
        """Of each dish: its tables, its word's customers and tables at the root, and these once for each word."""
        once = np.zeros(len(self.word))
        once[self.first] = 1
        c0, t0 = self.root.c[self.word].astype(np.float64), self.root.t[self.word]
        return {"t": self.leaf.t.copy(), "c0": c0, "t0": t0, "once_c0": c0 * once, "once_t0": t0 * once}


CONTEXT, CELL, TEXTS, FACT = 0, 1, 2, 10


#: A part's rows: what it has of a home's contexts (CONTEXT), packed pairs (CELL, TEXTS), and numbers to be summed up (FACT and on).
SCHEMA = "part int, kind int, home int, n long, cell binary"
COLUMNS = ["part", "kind", "home", "n", "cell"]


def _homes(n_parts: int) -> int:
    return -(-n_parts // 4)


def _by_home(us: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in the order of their homes, else as they are; the homes, and where each begins, with the end."""
    home = (us >> 16) % _homes(n_parts)
    order = np.argsort(home, kind="stable")
    home = home[order]
    cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
    return order, home[cuts], np.append(cuts, len(home))


def _batches(rows):
    """(part, kind, home, n, cell) as batches."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) == 5000 or size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), TYPES, strict=True)], COLUMNS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), TYPES, strict=True)], COLUMNS)


TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())


def _out(part: int, n_parts: int, contexts, cells, facts):
    """A part's rows as batches; contexts: u, customers and tables by sample."""

    def rows():
        order, homes, cuts = _by_home(contexts[0], n_parts)
        columns = [np.asarray(c, np.int64)[order] for c in contexts]
        for home, lo, hi in zip(homes.tolist(), cuts[:-1], cuts[1:], strict=True):
            some = [c[lo:hi] for c in columns]
            yield part, CONTEXT, home, int(some[1].sum()), pack(*some)
        for cell in cells:
            yield part, CELL, None, None, cell
        for i, fact in enumerate(facts):
            yield part, FACT + i, None, int(fact), None

    return _batches(rows())


def _facts(df: DataFrame) -> list[int]:
    found = df.where(F.col("kind") >= FACT).groupBy("kind").agg(F.sum("n").alias("x")).orderBy("kind").collect()
    return [r.x for r in found]


def _cells(w, us, u, *columns):
    """Cells of at most CHUNK pairs, sorted by word and previous word."""
    for lo in range(0, len(w), CHUNK):
        some = slice(lo, lo + CHUNK)
        yield pack(w[some], us, u[some], *(c[some] for c in columns))


def _merged(held: list) -> list:
    """(w, us, u, c) of several of these: each pair once, in order."""
    w, word = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    us, u = np.unique(np.concatenate([x[1][x[2]] for x in held]), return_inverse=True)
    code = word * len(us) + u
    at = np.argsort(code, kind="stable")
    code = code[at]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    c = np.add.reduceat(np.concatenate([x[3] for x in held])[at].astype(np.int64), starts)
    code = code[starts]
    return [w[code // len(us)], us, (code % len(us)).astype(np.int32), c]


def _dishes(rows: DataFrame, n_parts: int, samples: int) -> DataFrame:
    """Each part's dishes, what it has of each context, and the counts that discounts and bases are made of."""

    def add(state, kind, batch):
        for cell in batch.column("cell"):
            held = state.setdefault("held", [])
            held.append(unpack(cell.as_py()))
            if sum(len(x[0]) for x in held) > 2 * max(CHUNK, len(held[0][0])):
                held[:] = [_merged(held)]
        return ()

    def finish(part, state):
        w, us, u, c = _merged(state["held"])
        words_ = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        seen = np.add.reduceat(c, words_)
        customers = np.bincount(u, weights=c, minlength=len(us))
        tables = np.bincount(u, weights=c > 0, minlength=len(us))
        facts = [x for of in (seen, c) for x in (of.sum(), (of > 0).sum(), (of == 1).sum(), (of == 2).sum())]
        yield from _out(part, n_parts, [us, customers, tables * samples, *[tables] * (samples - 1)], _cells(w, us, u, c), facts)

    chunks = _chunks(rows, n_parts, False).withColumn("kind", F.lit(TEXTS))
    return _by_part(chunks, n_parts, SCHEMA, add, finish)


def _contexts(df: DataFrame, n_parts: int, names: tuple[int, ...]) -> DataFrame:
    """Every part's contexts with their sums over all parts: columns names of customers (0) and tables by sample (1 and on)."""

    def add(state, kind, batch):
        state.setdefault("parts", []).extend(batch.column("part").to_pylist())
        for cell in batch.column("cell"):
            us, *columns = unpack(cell.as_py())
            state.setdefault("held", []).append([us, *(columns[i] for i in names)])
        return ()

    def finish(home, state):
        ends = np.cumsum([len(x[0]) for x in state["held"]])
        us, *columns = (np.concatenate(x) for x in zip(*state.pop("held"), strict=True))
        at = np.argsort(us, kind="stable")
        new = np.concatenate([[True], us[at][1:] != us[at][:-1]])
        place = np.empty_like(at)
        place[at] = np.cumsum(new) - 1
        sums = [np.add.reduceat(c[at], np.flatnonzero(new)) for c in columns]
        yield from _batches((part, CONTEXT, home, None, pack(*(x[place[lo:hi]] for x in sums))) for part, lo, hi in zip(state["parts"], [0, *ends[:-1]], ends, strict=True))

    return _by_part(df.where(F.col("kind") == CONTEXT), _homes(n_parts), SCHEMA, add, finish, ("home",))


def _held(state, kind, batch) -> None:
    """Gather a part's contexts and cells."""
    cells = [unpack(x.as_py()) for x in batch.column("cell")]
    if kind == CONTEXT:
        state.setdefault("contexts", {}).update(zip(batch.column("home").to_pylist(), cells, strict=True))
    else:
        state.setdefault("cells", []).extend(cells)


def _read(state, n_parts: int) -> tuple[list, list]:
    """The part's pairs (w, us, u, other columns) in order, and the sums of each of us."""
    cells = sorted(state["cells"], key=lambda x: (x[0][0], x[1][x[2][0]]))
    us = cells[0][1]  # every cell of a part has all its contexts
    pairs = [np.concatenate([x[i] for x in cells]) for i in range(len(cells[0])) if i != 1]
    order, homes, _ = _by_home(us, n_parts)
    sums = []
    for column in zip(*(state["contexts"][home] for home in homes.tolist()), strict=True):
        sums.append(np.empty(len(us), np.int64))
        sums[-1][order] = np.concatenate(column)
    return [pairs[0], us, *pairs[1:]], sums


def _sampled(dishes: DataFrame, contexts: DataFrame, n_parts: int, totals: dict, params: Params, turn: int, last: bool) -> DataFrame:
    """A pass over the parts: contexts' customers and tables by sample, the root's as facts, in the last pass also the samples."""
    n = params.samples

    def add(state, kind, batch):
        _held(state, kind, batch)
        return ()

    def finish(part, state):
        (w, us, u, c), (tables,) = _read(state, n_parts)
        x = Part(w, c, (tables / n)[u], totals, params, np.random.default_rng([params.seed, int(part), turn]))
        for _ in range(params.sweeps):
            x.sweep()
        drawn = []
        for _ in range(n):
            x.sweep()
            drawn.append(x.sample())
        own = [np.bincount(u, weights=z, minlength=len(us)) for z in (c, *(d["t"] for d in drawn))]
        if not last:  # the next pass asks for their mean
            own = [np.zeros(len(us)), sum(own[1:]), *[np.zeros(len(us))] * (n - 1)]
        facts = [d[z].sum() for d in drawn for z in ("once_c0", "once_t0")]
        columns = [d[z].astype(np.int32) for z in ("t", "c0", "t0") for d in drawn]
        yield from _out(part, n_parts, [us, *own], _cells(w, us, u, c, *columns) if last else (), facts)

    return _by_part(contexts.union(dishes.where(F.col("kind") == CELL)), n_parts, SCHEMA, add, finish)


@dataclass(frozen=True)
class Model:
    """The last pass of a model that learnt from n tokens with v words."""

    last: DataFrame
    totals: dict
    roots: list
    n_parts: int
    params: Params
    n: int
    v: int

    def _probable(self, state):
        """(w, us, u, p, seen) of the part's pairs."""
        k, s, d0, d1 = self.params.samples, self.params.strength, self.totals["d0"], self.totals["d1"]
        (w, us, u, c, *drawn), (customers, *tables) = _read(state, self.n_parts)
        p = np.zeros(len(w))
        for i in range(k):
            t, c0, t0 = drawn[i], drawn[k + i], drawn[2 * k + i]
            parent = (c0 - d0 * t0 + (s + d0 * self.roots[i][1]) / (self.v + 1)) / (s + self.roots[i][0])
            p += (c - d1 * t + (s + d1 * tables[i])[u] * parent) / (s + customers[u])
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        seen = np.repeat(np.add.reduceat(c, starts), np.diff(np.append(starts, len(w))))
        return w, us, u, p / k, seen

    def _parts(self) -> DataFrame:
        return _contexts(self.last, self.n_parts, tuple(range(1 + self.params.samples))).union(self.last.where(F.col("kind") == CELL))

    def found(self) -> DataFrame:
        """(u, w, p, seen) of every pair of the documents."""
        me = Model(None, self.totals, self.roots, self.n_parts, self.params, self.n, self.v)

        def add(state, kind, batch):
            _held(state, kind, batch)
            return ()

        def finish(part, state):
            w, us, u, p, seen = me._probable(state)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (us[u], w, p, seen)], ["u", "w", "p", "seen"])

        return _by_part(self._parts(), self.n_parts, "u long, w long, p double, seen long", add, finish)

    def _shares(self, rows: DataFrame) -> DataFrame:
        """(chunk, cell): what each part gives to the documents of each chunk: their places, and columns of sums. A part with
        more texts than others is dealt over several tasks, each with the part's pairs."""
        me = Model(None, self.totals, self.roots, self.n_parts, self.params, self.n, self.v)

        def add(state, kind, batch):
            if kind != TEXTS:
                _held(state, kind, batch)
                return
            if "p" not in state:
                w, us, u, p, seen = me._probable(state)
                state.clear()
                names = w[_starts(w)]
                base = np.log10((seen + 0.5) / (me.n + 0.5 * (me.v + 1)))
                state |= {"names": names, "us": us, "code": np.searchsorted(names, w) * len(us) + u, "p": np.log10(p), "base": base, "known": seen > 0}
            for chunk, cell in zip(batch.column("n"), batch.column("cell"), strict=True):
                w, us, u, c, doc, *whole = unpack(cell.as_py())
                starts = _starts(w)
                code = np.repeat(np.searchsorted(state["names"], w[starts]), np.diff(starts, append=len(w))) * len(state["us"]) + np.searchsorted(state["us"], us)[u]
                found = np.searchsorted(state["code"], code)
                base, p, known = (np.bincount(doc, weights=np.repeat(state[x][found], c)) for x in ("base", "p", "known"))
                own = np.flatnonzero(np.bincount(doc))
                columns = [own.astype(np.int32), *(_rounded(x[own]).view(np.int64) for x in (base, p)), known[own].astype(np.int32), *whole]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([pack(*columns)], pa.binary())], ["chunk", "cell"])

        texts = _chunks(rows, self.n_parts, True)
        tokens_ = self.last.where(F.col("kind") == CONTEXT).groupBy("part").agg(F.sum("n").alias("n"))
        shares = tokens_.select("part", F.greatest(F.lit(1), F.floor(F.col("n") / self.params.part_tokens)).cast("int").alias("shares"))
        share = F.pmod(F.xxhash64("cell"), F.col("shares")).cast("int").alias("share")
        texts = texts.join(F.broadcast(shares), "part").select("part", F.lit(TEXTS).alias("kind"), F.lit(None).cast("int").alias("home"), F.col("chunk").alias("n"), "cell", share)
        parts = self._parts().join(F.broadcast(shares), "part")
        parts = parts.select(*COLUMNS, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        return _by_part(parts.unionByName(texts), self.n_parts, "chunk long, cell binary", add, lambda part, state: (), ("part", "share"))

    def sums(self, rows: DataFrame) -> DataFrame:
        """(key, base, model, known, size) of each document of each chunk."""

        def add(state, kind, batch):
            state.setdefault("cells", []).extend(batch.column("cell").to_pylist())
            return ()

        def finish(chunk, state):
            cells = [unpack(x) for x in state.pop("cells")]
            whole = [x[4:] for x in cells if len(x) > 4]  # of several equal chunks, one from each
            keys, sizes = whole[0]
            base, p, known = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
            for own, b, q, k, *_ in cells:
                base[own] += b.view(np.float64)
                p[own] += q.view(np.float64)
                known[own] += k
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, base, p, known, sizes * len(whole))], ["key", "base", "model", "known", "size"])

        shares = self._shares(rows).withColumn("kind", F.lit(TEXTS))
        return _by_part(shares, 1, "key long, base double, model double, known long, size long", add, finish, ("chunk",))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Sums of logarithms to 34 binary places (3e-11): their last bytes are zero and pack to nothing."""
    return np.rint(x * 2.0**34) / 2.0**34


def model(rows: DataFrame, params: Params) -> Model:
    spark, k = rows.sparkSession, params.samples
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(2, int(chars / CHARS / params.part_tokens))
    dishes = shared.cut(_dishes(rows, n_parts, k), "dishes")
    n, v, ones, twos, _, c0, singles, doubles = _facts(dishes) or [0] * 8
    discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    totals = {"v": v, "c0": float(c0), "t0": float(v), "d1": discount(singles, doubles), "d0": discount(ones, twos)}
    last = dishes
    for turn in range(params.passes):
        shared.settle(spark)
        before, last = last, shared.cut(_sampled(dishes, _contexts(last, n_parts, (1,)), n_parts, totals, params, turn, turn == params.passes - 1), "pass")
        facts = _facts(last) or [0] * (2 * k)
        if turn:
            shared.discard(before)
        roots = list(zip(facts[::2], facts[1::2], strict=True))
        if turn < params.passes - 1:
            totals = totals | {"c0": sum(c for c, _ in roots) / k, "t0": sum(t for _, t in roots) / k}
    shared.discard(dishes)
    shared.settle(spark)
    return Model(last, totals, roots, n_parts, params, n, v)


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity, a row for each row of docs."""
    shared.ship(docs.sparkSession)
    rows = _rows(docs)
    m = model(rows, params)
    n = m.n
    sums = []
    for i in range(params.rounds):
        sums.append(shared.cut(m.sums(rows.where(F.pmod("key", F.lit(params.rounds)) == i)), "sums"))
        shared.settle(docs.sparkSession)
    shared.discard(m.last)
    tails = reduce(DataFrame.union, sums).groupBy("key").agg(*[F.sum(x).alias(x) for x in ("base", "model", "known", "size")])
    heads = rows.select("key", "doc_id", "held_out")
    # equal rows share a key: what came back for the key is divided among them
    copies = heads.withColumn("copies", F.count("*").over(Window.partitionBy("key")))
    both = copies.join(tails, "key", "left")
    share = lambda c: F.col(c) / F.col("copies")
    return both.select(
        "doc_id",
        "held_out",
        share("size").cast("long").alias("n_tokens"),
        share("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        share("base").alias("base_score"),
        share("model").alias("score"),
        F.pow(F.lit(10.0), -F.col("model") / F.col("size")).alias("perplexity"),
    )
